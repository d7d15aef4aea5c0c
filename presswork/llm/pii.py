"""Personal data, and terms that reveal it, in SQL functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers.
The values found are the protected entities. The method then asks the corpus
which ordinary terms give an entity away: with p(e) the share of documents that
hold entity e, p(t) that of documents with term t outside of such values, and p(e, t) that of
both, the disclosure of e by t is

    log(p(e, t) / (p(e) p(t))) / -log p(e),

the share of the entity's information that the term carries: 1 if t is seen with
e alone, 0 if the two are independent. A term is a run of letters and digits with a letter, of any
length, in any place of the document. A pair counts only where at least `SUPPORT`
different texts show it: any rare word stands once with some address, so less tells nothing.
From `GENERALISE` on a term is generalised to its kind ([number] with a digit, [name] with
a capital, else [word]), from `REMOVE` on it is taken out, in all documents with that entity.

Counts cover all documents. Only entities of `SUPPORT` texts or more meet the terms of their texts, pairs are
added up per task before they are shuffled, and of all documents only terms in such pairs are counted.
Terms come back to documents over their text's hash; documents without a
protected entity are never shuffled, and every text is searched for values once.

Null and empty texts have no spans. Repeated rows are judged one by one and count
one by one, but not for the support. Extra columns are not read, texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TIDY, Scratch, col, documents, fresh, settings
from .native_spans import let, ordered, replaced, said, spans, where_any

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 3
GENERALISE = 0.9
REMOVE = 0.98
#: A character that stands for a separator inside a value, so that no pattern repeats a group.
INNER = "\x01"
TERM = r"[\p{L}\p{N}]+"
#: What stands for a value in a text that is handed on.
STANDS_FOR = {"email": "[email]", "ip": "[ip]", "card": "[card]", "phone": "[phone]"}

_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\x01-]))[A-Za-z0-9._%+\x01-]+@[A-Za-z0-9-]+\x01[A-Za-z0-9\x01-]+"
_IP = r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_CARD = r"[0-9][0-9\x01]+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits: Column) -> Column:
    """True if the check digit of a string of digits is right."""
    value = lambda c, i: let(c.cast("int") * (F.lit(1) + i % 2), lambda v: v - F.when(v > 9, 9).otherwise(0))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, v: a + v) % 10 == 0


def n_digits(body: Column) -> Column:
    return F.length(F.regexp_replace(body, "[^0-9]", ""))


def base_spans(text: Column) -> Column:
    """The spans of the four kinds, by kind and then start; a body is the value as it stands."""
    plain = F.translate(text, INNER, "\x02")
    dotted = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", INNER)
    emails = F.transform(
        spans(dotted, _EMAIL, "email"), lambda s: s.withField("body", F.lower(F.translate(s["body"], INNER, ".")))
    )
    ips = F.filter(spans(text, _IP, "ip"), lambda s: s["body"].rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"))
    chained = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", INNER)

    def is_card(s: Column) -> Column:
        return let(F.replace(s["body"], F.lit(INNER), F.lit("")), lambda d: F.length(d).between(13, 19) & luhn(d))

    cards = F.transform(
        F.filter(spans(chained, _CARD, "card"), is_card), lambda s: s.withField("body", F.translate(s["body"], INNER, ""))
    )
    phones = F.transform(
        F.filter(spans(text, _PHONE, "phone"), lambda s: n_digits(s["body"]).between(9, 15)),
        lambda s: s.withField("body", F.regexp_replace(s["body"], "[^0-9]", "")),
    )
    found = F.concat(
        where_any(text, text.contains("@"), emails),
        where_any(text, text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), ips),
        where_any(text, text.rlike(r"(?:[0-9][\x20-]?){12}[0-9]"), cards),
        where_any(text, text.rlike(r"\+[0-9]"), phones),
    )
    return F.when(F.size(found) == 0, found).otherwise(ordered(found, KINDS, True))


def entity(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], s["body"])


def terms(text: Column) -> Column:
    """Distinct lower-case terms."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: w.rlike(r"\p{L}")))


#: Parts of the texts that hold one entity.
SALTS = 32


def disclosures(texts: DataFrame, held: DataFrame, save: Scratch) -> DataFrame:
    """(entity, term, share) of the terms that reveal an entity by `GENERALISE` or more.

    `texts` has a column text; `held` text and spans of those with an entity.
    """
    total = texts.count()
    per = held.groupBy(F.md5("text").alias("key")).agg(F.count("*").alias("copies"), F.any_value("text").alias("text"), F.any_value("spans").alias("spans"))
    outside = terms(replaced(F.col("text"), F.col("spans"), lambda s: F.lit(" ")))
    per = per.select("copies", F.array_distinct(F.transform("spans", entity)).alias("entities"), outside.alias("terms"), terms(F.col("text")).alias("all_terms"))
    # terms that a text has in its values only
    per = save(per.withColumn("inner", F.array_except("all_terms", "terms")).drop("all_terms"))
    holders = per.select("copies", F.explode("entities").alias("entity")).groupBy("entity")
    holders = save(holders.agg(F.sum("copies").alias("n_entity"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT))
    # lists of terms go to the entities' rows in parts: an entity that very many texts hold is so many tasks
    spread = holders.select("entity", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    parts = F.expr(f"cast(pmod(monotonically_increasing_id(), {SALTS}) as int)")
    with_entity = per.select("copies", "terms", F.explode("entities").alias("entity"), parts.alias("salt")).join(spread, ["entity", "salt"])
    pairs = with_entity.select("copies", "entity", F.explode("terms").alias("term")).groupBy("entity", "term")
    pairs = pairs.agg(F.sum("copies").alias("both"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT)
    pairs = save(pairs.drop("texts"))
    asked = save(pairs.select("term").distinct())
    seen = texts.select(F.explode(terms(F.col("text"))).alias("term"), F.lit(1).cast("long").alias("n"))
    seen = seen.unionByName(per.select(F.explode("inner").alias("term"), (-F.col("copies")).alias("n")))
    seen = seen.join(asked, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_term"))
    rated = pairs.join(holders.drop("texts"), "entity").join(seen, "term")
    n = F.lit(float(max(total, 1)))
    gain = F.log(F.col("both") * n / (F.col("n_entity") * F.col("n_term")))
    share = gain / F.greatest(F.log(n / F.col("n_entity")), F.lit(1e-9))
    return rated.select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE)


def general(word: Column) -> Column:
    """The kind of a term as it stands."""
    return F.when(word.rlike(r"\p{N}"), "[number]").when(word.rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")


def scan(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, `base_spans` and `spans` (with those of revealing terms, whose body is what stands for them)."""
    with settings(df.sparkSession, TIDY), Scratch(df.sparkSession) as save:
        return _scan(df, text_col, keep, save)


def _scan(df: DataFrame, text_col: str, keep: tuple[str, ...], save: Scratch) -> DataFrame:
    names = {n: fresh(n, keep) for n in ("text_in", "base_spans", "spans", "key", "revealing")}
    source, base, every, key, found = names.values()
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    now = df.select(*[col(k) for k in keep], text.alias(source)).withColumn(base, base_spans(col(source)))
    # the texts with an entity only; what is given back rests on this table and on `of_text`
    now = save.keep(now.withColumn(source, F.when(F.size(col(base)) > 0, col(source))))
    held = now.where(F.size(col(base)) > 0)
    with_entity = held.select(col(source).alias("text"), col(base).alias("spans"))
    told = save(disclosures(df.select(text.alias("text")), with_entity, save))
    of_text = with_entity.select(F.md5("text").alias("key"), F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity"))
    of_text = of_text.distinct().join(told, "entity").groupBy("key", "term").agg(F.max("share").alias("share"))
    of_text = of_text.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias(found))
    of_text = save.keep(of_text.select(F.col("key").alias(key), col(found)))
    known = held.withColumn(key, F.md5(col(source))).join(of_text, key, "left")

    def judged(s: Column) -> Column:
        share = F.try_element_at(col(found), F.lower(s["body"]))
        return s.withField("body", F.when(share >= REMOVE, "").otherwise(general(s["body"])))

    apart = lambda s: ~F.exists(col(base), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    more = F.filter(spans(col(source), TERM, "term"), lambda s: F.map_contains_key(col(found), F.lower(s["body"])) & apart(s))
    both = F.when(col(found).isNull(), col(base)).otherwise(ordered(F.concat(col(base), F.transform(more, judged)), KINDS, True))
    shown = [col(k) for k in keep]
    clean = now.where(F.size(col(base)) == 0).select(*shown, col(base), col(base).alias(every))
    return clean.unionByName(known.select(*shown, col(base), both.alias(every)))


def sanitise(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of `df`; in the text, each value is replaced by its kind and each revealing term by what stands for it.

    Spans that overlap are one stretch, which the first of them names. A null text stays null.
    """
    every = fresh("spans", df.columns)
    found = scan(df, text_col, tuple(df.columns))
    kinds = F.create_map(*[F.lit(x) for kv in STANDS_FOR.items() for x in kv])
    text = replaced(col(text_col), col(every), lambda s: F.coalesce(F.try_element_at(kinds, s["kind"]), s["body"]))
    text = F.when(F.size(col(every)) == 0, col(text_col)).otherwise(text)
    return found.select(*[text.alias(text_col) if c == text_col else col(c) for c in df.columns])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[n(k) for k in KINDS[:4]],
        F.sha2(said(F.col("base_spans")), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )
