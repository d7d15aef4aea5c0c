"""Secret scan with a battery of randomness tests, in SQL functions only.

Base spans come from three patterns. The method adds tokens that look drawn at
random: strings of at least 20 characters of the base64 alphabets, also right behind
an equals sign, whose encoding is inferred from their characters (decimal with letters
up to f is hex, capitals and 2-7 are base32, all else base64). Three tests ask
whether such a token could be random in its encoding:

- chi-squared: are the symbols of the alphabet equally frequent,
- runs: does it cross the middle of the alphabet as often as a random string,
- serial correlation: is a symbol's rank independent of the one before.

Their z values are squared and summed as if independent, which they nearly are, to one
chi-squared value with three degrees of freedom and a p-value; frequencies that are more equal than
chance would have them do not count against a token. Random tokens have p-values spread evenly over
0 to 1, structured ones crowd near 0. For each class of lengths the corpus is counted into 50 bins
of p. As long as a class has few tokens, what is known of them is little, so `PRIOR` tokens more
are counted in, spread as those of the other classes are; and `PRIOR` tokens are counted into these in turn, half
of them random and half with p below 0.1. The upper half of the bins tells how many random tokens there are,
and the threshold is the smallest p above which at most `FALSE_DISCOVERIES` of the tokens are in excess of
that, by more than `CHANCE` standard deviations of their number: so much may be due to chance where tokens are few. One rule holds for any number of tokens. The table of thresholds has four rows.

Null and empty texts have no spans. Repeated rows are judged one by one, equal
spans of two kinds are both listed; extra columns are not read. Texts are read
whole; all steps but the count of bins are narrow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, documents, fresh
from .native_spans import let, ordered, replaced, said, spans, where_any

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# An equals sign before a token is none of it (name=value), behind it it is padding or stands before a value.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])"
ASSIGN_CHARS = 8
FALSE_DISCOVERIES = 0.1
BINS = 50
CLASSES = 4
#: Tokens that stand for what is known before any is seen, and the bins of p below 0.1 that half of them are in.
PRIOR = 20.0
LOW_BINS = 5
CHANCE = 1.645
REPLACEMENT = "[secret]"

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def base_spans(text: Column) -> Column:
    """The spans of the three patterns, by start and then kind."""
    # No shorter match of the last two patterns hides a longer one, so the least length can stand in the pattern.
    # A failing assignment does hide what it covers, so those are dropped after the search.
    low = F.lower(text)
    worded = F.lit(False)
    for word in ("passw", "secret", "token", "api"):
        worded = worded | low.contains(word)
    assign = F.filter(spans(text, ASSIGN, "assign", 2), lambda s: F.length(s["body"]) >= ASSIGN_CHARS)
    found = F.concat(
        where_any(text, worded, assign),
        where_any(text, text.contains("AKIA"), spans(text, ACCESS, "access")),
        where_any(text, text.rlike(HEX), spans(text, HEX, "hex")),
    )
    return ordered(found, KINDS, False)


def candidates(text: Column) -> Column:
    """Tokens that the battery judges."""
    return where_any(text, text.rlike(CANDIDATE), spans(text, CANDIDATE, "random"))


def upper_tail(z: Column) -> Column:
    """P(N > z) of a standard normal variable, to 1e-7 (a rational approximation of the error function)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return let(series * F.exp(-x * x) / 2, lambda tail: F.when(z >= 0, tail).otherwise(1 - tail))


def chi_tail(x: Column, df: int) -> Column:
    """P(chi-squared > x), by the cube-root normal approximation."""
    return let((F.pow(x / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)), upper_tail)


def random_p(token: Column) -> Column:
    """The probability of a random string that departs from uniformity as far as the token."""

    def inferred(plain: Column) -> Column:
        kind = F.when(plain.rlike("^[0-9a-f]+$"), "hex").when(plain.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
        alphabet = F.create_map(*[F.lit(x) for k, a in ALPHABETS.items() for x in (k, a)])[kind]
        return let(alphabet, lambda a: let(_ranks(plain, a), lambda r: _battery(r, F.length(a).cast("double"))))

    return let(F.translate(token, "-_=", "+/"), inferred)


def _ranks(token: Column, alphabet: Column) -> Column:
    """Places in the alphabet, from 0, of the characters that are in it."""
    return F.filter(F.transform(F.split(token, ""), lambda c: F.instr(alphabet, c) - 1), lambda r: r >= 0)


def _battery(ranks: Column, size: Column) -> Column:
    start = F.struct(
        F.lit(0.0).alias("runs"), F.lit(0.0).alias("high"), F.lit(0.0).alias("cross"), F.lit(-1).alias("last")
    )
    middle, half = (size - 1) / 2, size / 2

    def step(acc: Column, r: Column) -> Column:
        first = acc["last"] < 0
        up = r >= half
        return F.struct(
            (acc["runs"] + F.when(first | (up != (acc["last"] >= half)), 1.0).otherwise(0.0)).alias("runs"),
            (acc["high"] + F.when(up, 1.0).otherwise(0.0)).alias("high"),
            (acc["cross"] + F.when(first, 0.0).otherwise((r - middle) * (acc["last"] - middle))).alias("cross"),
            r.alias("last"),
        )

    # sum of squared counts, symbol by symbol
    squares = F.aggregate(
        F.array_distinct(ranks),
        F.lit(0.0),
        lambda acc, r: acc + F.pow(F.size(F.array_remove(ranks, r)).cast("double") - F.size(ranks), F.lit(2.0)),
    )
    found = F.struct(
        F.size(ranks).cast("double").alias("n"), F.aggregate(ranks, start, step).alias("walk"), squares.alias("squares")
    )

    def combine(x: Column) -> Column:
        n, high, runs = x["n"], x["walk"]["high"], x["walk"]["runs"]
        z_chi = (x["squares"] * size / n - n - (size - 1)) / F.sqrt(2.0 * (size - 1) * (n - 1) / n)
        both = 2 * high * (n - high)
        spread = F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9)))
        z_runs = (runs - (both / n + 1)) / spread
        z_serial = x["walk"]["cross"] / (F.sqrt(n - 1) * ((size * size - 1) / 12))
        return F.pow(F.greatest(z_chi, F.lit(0.0)), F.lit(2.0)) + z_runs * z_runs + z_serial * z_serial

    return let(let(found, combine), lambda total: chi_tail(total, 3))


def length_class(n: Column) -> Column:
    return F.when(n < 32, 0).when(n < 48, 1).when(n < 80, 2).otherwise(3)


def thresholds(judged: DataFrame) -> DataFrame:
    """(class, cut): the smallest bin from which on tokens of a class of lengths are taken for secrets.

    `judged` has a row for each token: its length class and p. A class without a threshold has no row.
    """
    bins = judged.select("class", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    counts = bins.groupBy("class", "bin").agg(F.count("*").alias("n"))
    places = F.explode(F.sequence(F.lit(0), F.lit(CLASSES * BINS - 1))).alias("i")
    grid = judged.sparkSession.range(1).select(places).select(F.expr(f"i div {BINS}").cast("int").alias("class"), (F.col("i") % BINS).alias("bin"))
    full = grid.join(counts, ["class", "bin"], "left").fillna(0, ["n"])
    before = F.when(F.col("bin") < LOW_BINS, 0.5 / LOW_BINS).otherwise(0.0) + 0.5 / BINS
    others = F.sum("n").over(Window.partitionBy("bin")) - F.col("n") + PRIOR * before
    total = F.sum("n").over(Window.partitionBy()) - F.sum("n").over(Window.partitionBy("class")) + PRIOR
    known = full.withColumn("known", F.col("n") + PRIOR * others / total)
    per = Window.partitionBy("class")
    above = per.orderBy(F.desc("bin"))
    random = F.sum(F.when(F.col("bin") >= BINS // 2, F.col("known")).otherwise(0.0)).over(per) * 2.0
    told = known.select("class", "bin", F.sum("known").over(above).alias("found"), F.sum("n").over(above).alias("seen"), random.alias("random"))
    excess = F.col("found") - F.col("random") * (BINS - F.col("bin")) / BINS - CHANCE * F.sqrt("seen")
    false = excess / F.col("found")
    return told.where((F.col("bin") > 0) & (false <= FALSE_DISCOVERIES + 1e-9)).groupBy("class").agg(F.min("bin").alias("cut"))


def scan(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, `base_spans` and `spans` (arrays of kind, start, end, body); renamed on a clash."""
    base, every, source = fresh("base_spans", keep), fresh("spans", keep), fresh("scanned", keep)
    marks = fresh("tokens", keep)
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    one = df.select(text.alias("t")).select(F.explode(candidates(F.col("t"))).alias("s"))
    judged = one.select(length_class(F.length("s.body")).alias("class"), random_p(F.col("s.body")).alias("p"))
    cuts = thresholds(judged).agg(F.map_from_entries(F.collect_list(F.struct("class", "cut"))).alias("cuts"))
    # a row of at most four entries
    known = {int(k): int(v) for k, v in (cuts.first().cuts or {}).items()}
    taken = df.select(*[col(k) for k in keep], text.alias(source))
    taken = taken.withColumn(base, base_spans(col(source))).withColumn(marks, candidates(col(source)))

    def cut(n: Column) -> Column:
        out = F.lit(BINS)
        for k, v in known.items():
            out = F.when(length_class(n) == k, F.lit(v)).otherwise(out)
        return out

    secret = F.filter(col(marks), lambda s: F.floor(random_p(s["body"]) * BINS) >= cut(F.length(s["body"])))
    found = ordered(F.concat(col(base), secret), KINDS, False)
    return taken.select(*[col(k) for k in keep], col(base), F.when(F.size(col(marks)) == 0, col(base)).otherwise(found).alias(every))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of `df`, each stretch of secrets in the text replaced; a null text stays null."""
    every = fresh("spans", df.columns)
    found = scan(df, text_col, tuple(df.columns))
    text = F.when(F.size(col(every)) == 0, col(text_col)).otherwise(replaced(col(text_col), col(every), lambda s: F.lit(REPLACEMENT)))
    return found.select(*[text.alias(text_col) if c == text_col else col(c) for c in df.columns])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[n(k) for k in KINDS[:3]],
        F.sha2(said(F.col("base_spans")), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )
