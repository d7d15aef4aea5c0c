"""URL filter: fixed host and path rules, then association rules mined from labels, in DataFrame functions only.

Fixed rules come first; the longest that fits decides. For other urls Spark's
FP-growth mines which combinations of url tokens go with a bad label (quality 0 or
toxic). Labels tell of the document with an id; the page with that number is taken to be where the
document came from, so `labels.doc_id` is joined with `pages.page_id`. A rule needs `MIN_ROWS`
labelled urls, and `MIN_SUPPORT` of them all, that have its tokens and the label; it needs
`MIN_CONFIDENCE`, and the lower end of the interval that the share of bad urls is in (Wilson, one-sided 95 %)
must lie above the share among all labelled urls, so that a few rows by chance make no rule. A rule
of more tokens that is no more confident than a rule it contains says nothing new and goes. Antecedents
of any length are kept. What is left is
kept in an inverted index under each rule's rarest token: a url looks up its own
tokens there and is held against the rest of the rule. A url is blocked if a
rule matches it.

Distinct urls are looked up, not rows, and only distinct token lists meet the
index, so neither a url nor a host that a third of the rows share makes a large
group. A null url, or one without "://", has an empty host and path, no tokens, and
is allowed. Without labels there are no mined rules. Rows whose url has several
labels are bad if any is. Repeated rows are kept, extra columns are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, lower_ascii, save
from .native_spans import let

#: (rule, verdict): a host, and where the path must start.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Labelled urls behind a rule, at least: so many, and this share of all.
MIN_ROWS = 10
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.75
#: Of the one-sided 95 % interval.
Z = 1.645
BAD = "label=bad"


def host_path(url: Column) -> Column:
    """struct(host, path) of a url; both empty where there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.struct(F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        made = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens: labels of the host with their place from the right, path words, keys of the query, the scheme."""
    lowered = lower_ascii(url)
    rest = F.regexp_extract(lowered, r"://(.*)$", 1)
    labels = F.reverse(F.split(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"\."))
    host = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), x))
    path = F.split(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), "/")
    path = F.transform(F.filter(path, lambda x: (x != "") & ~x.rlike("^[0-9]+$")), lambda x: F.concat(F.lit("p="), x))
    query = F.transform(
        F.filter(F.split(F.regexp_extract(rest, r"\?([^#]*)", 1), "&"), lambda x: x != ""),
        lambda x: F.concat(F.lit("q="), F.regexp_extract(x, "^([^=]*)", 1)),
    )
    scheme = F.array(F.concat(F.lit("s="), F.regexp_extract(lowered, "^(.*?)://", 1)))
    every = F.array_distinct(F.concat(scheme, host, path, query))
    return F.when(F.instr(url, "://") > 0, F.filter(every, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


#: Parts of the rows that share one list of tokens.
SALTS = 32


def lower_end(share: Column, n: Column, z: float = Z) -> Column:
    """The lower end of the Wilson interval of a share among n."""
    spread = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (share + z * z / (2 * n) - spread) / (1 + z * z / n)


def mine(
    labelled: DataFrame, min_rows: int = MIN_ROWS, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """(rule_id, items, confidence) from rows of distinct `items`, some with the bad label among them."""
    bad = F.array_contains("items", BAD)
    told = labelled.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
    if told.bad < min_rows:
        return labelled.sparkSession.createDataFrame([], "rule_id string, items array<string>, confidence double")
    share = max(min_support, min_rows / told.n)
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence).fit(labelled)
    # support is that of antecedent and consequent together
    seen = F.round(F.col("support") * told.n / F.col("confidence"))
    sure = model.associationRules.where(F.array_contains("consequent", BAD) & (lower_end(F.col("confidence"), seen) > told.bad / told.n))
    rules = save(sure.select(F.array_sort("antecedent").alias("items"), "confidence"))
    one = rules.select("items", "confidence", F.explode("items").alias("token"))
    often = one.groupBy("token").agg(F.count("*").alias("often"))
    # a rule is looked up under its rarest token among the rules
    rare = one.join(often, "token").groupBy("items", "confidence").agg(F.min(F.struct("often", "token")).alias("rare"))
    plain = rare.select(F.col("items").alias("part"), F.col("confidence").alias("c"), F.col("rare.token").alias("token"))
    inside = (F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0) & (F.col("c") >= F.col("confidence"))
    idle = one.join(plain, "token").where(inside).select("items").distinct()
    kept = rules.join(idle, "items", "left_anti")
    return kept.select(F.array_join("items", " ").alias("rule_id"), "items", "confidence")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(items, confidence) of the distinct token arrays that some rule matches, by way of the inverted index."""
    one = rules.select("rule_id", "confidence", "items", F.explode("items").alias("token"))
    lists = urls.select("items").distinct()
    seen = lists.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rare = one.join(seen, "token").groupBy("rule_id").agg(F.min(F.struct("n", "token")).alias("rare"))
    index = save(
        rules.join(rare, "rule_id").select(F.col("rare.token").alias("token"), F.col("items").alias("needed"), "confidence")
    )
    hits = lists.select("items", F.explode("items").alias("token")).join(index, "token")
    held = hits.where(F.size(F.array_except("needed", "items")) == 0)
    return held.groupBy("items").agg(F.max("confidence").alias("confidence"))


def judge(
    pages: DataFrame,
    labels: DataFrame,
    url_col: str = "url",
    id_col: str = "page_id",
    label_id: str = "doc_id",
    keep: tuple[str, ...] = ("page_id",),
) -> DataFrame:
    """`keep` columns, and `judged`: host, path, rule, verdict, confidence (of the mined rule, if one matched)."""
    names = {n: fresh(n, keep) for n in ("url_in", "items", "confidence", "judged", "salt")}
    url, items, confidence, out, salt = names.values()
    bad = labels.groupBy(col(label_id).alias("label_id")).agg(
        F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) != 0)).alias("bad")
    )
    bad = save(bad.where("label_id is not null"))
    told = pages.select(col(id_col).alias("label_id"), tokens(col(url_col)).alias("items")).join(bad, "label_id")
    told = told.where(F.size("items") > 0)
    marked = told.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    rules = save(mine(save(marked)))  # few rows: what the supports allow
    urls = pages.select(tokens(col(url_col)).alias("items")).where(F.size("items") > 0)
    hit = save(matched(urls, rules)).select(F.col("items").alias(items), F.col("confidence").alias(confidence))
    # tokens that very many pages share are dealt to so many tasks
    hit = hit.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    now = pages.select(*[col(k) for k in keep], col(url_col).alias(url)).withColumn(items, tokens(col(url)))
    now = now.withColumn(salt, F.expr(f"cast(pmod(monotonically_increasing_id(), {SALTS}) as int)"))
    now = now.join(hit, [items, salt], "left")

    def made(x: Column) -> Column:
        def ruled(r: Column) -> Column:
            method = F.when(col(confidence).isNotNull(), "block").otherwise("allow")
            return F.struct(
                x["host"].alias("host"),
                x["path"].alias("path"),
                r["rule"].alias("rule"),
                F.coalesce(r["verdict"], method).alias("verdict"),
                F.when(r.isNull(), col(confidence)).alias("confidence"),
            )

        return let(rule_of(x["host"], x["path"]), ruled)

    return now.select(*[col(k) for k in keep], let(host_path(col(url)), made).alias(out))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return judge(pages, labels).select("page_id", "judged.*")
