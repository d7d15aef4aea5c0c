"""Quality rules as a bitmask ledger.

`ledger` measures every text once and evaluates every rule once; a row holds the
measurements and one bit for each rule that the text fails. Policies are named,
versioned masks over those bits: applying another one, or asking what a rule
alone removes, reads only the ledger, never the texts.

Null, empty and blank texts have no words, so they fail `few_words`. Repeated
rows and ids are judged row by row. Extra columns are not read; columns that the
caller keeps pass through unchanged whatever their names. Long texts are
measured whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, documents, fresh, map_text

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
WINDOW = 8
FIELDS = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """Bit `bit` is set where `fails`, SQL over the measurements, is true."""

    bit: int
    name: str
    fails: str


#: Bits are never given to another rule, so that old ledgers stay readable.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "short_words", "word_chars < 2 * n_words"),
    Rule(3, "long_words", "word_chars > 25 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(5, "duplicate_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
)


@dataclass(frozen=True)
class Policy:
    """A text is kept if it fails none of the named rules."""

    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: 1 << r.bit for r in rules}
        return sum(bits[n] for n in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
PRODUCTION = Policy("production", 1, tuple(r.name for r in RULES))

def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of 8 words that the list holds at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    with np.errstate(over="ignore"):
        mixed = (ids + np.uint64(1)) * ODD
        mixed ^= mixed >> np.uint64(29)
        codes = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            codes = codes * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
            codes ^= codes >> np.uint64(32)
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    if not same.any():
        return 0
    a, b = order[1:][same], order[:-1][same]
    if any((ids[a + k] != ids[b + k]).any() for k in range(WINDOW)):  # codes met by chance: compare windows themselves
        seen: dict[tuple, list[int]] = {}
        for i in range(n):
            seen.setdefault(tuple(ids[i : i + WINDOW].tolist()), []).append(i)
        twice = np.array([i for at in seen.values() if len(at) > 1 for i in at], np.int64)
    else:
        twice = np.concatenate([a, b])
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(texts: list[str | None]) -> dict[str, list[int]]:
    """The measurements of some texts."""
    out: dict[str, list[int]] = {m: [] for m in MEASURES}
    for text in texts:
        text = text or ""
        # bytes.split() cuts at exactly \x20 and \x09-\x0D
        data = text.encode()
        words = data.split()
        joined = b"".join(words)
        lines = [x for x in data.split(b"\n") if x.strip()]
        inner = joined.count
        out["n_words"].append(len(words))
        out["word_chars"].append(len(joined.decode()))
        out["n_symbols"].append(sum(map(inner, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_repeat_words"].append(repeated_words(words))
        out["n_lines"].append(len(lines))
    return out


def failed_bits(measures: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """The bits of the rules that the measurements in a struct column fail."""
    bits = F.lit(0).cast("long")
    for r in rules:
        said = re.sub(rf"\b({'|'.join(MEASURES)})\b", lambda m: f"`{measures}`.{m[1]}", r.fails)
        bits = bits.bitwiseOR(F.when(F.expr(said), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(
    df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """`keep` columns, `quality` (struct of measurements) and `failed` (bits); renamed with leading underscores on a clash."""
    quality = fresh("quality", keep)
    failed = fresh("failed", keep)
    return map_text(df, text_col, measure, FIELDS, keep, quality).withColumn(failed, failed_bits(quality, rules))


def passes(policy: Policy, failed: str = "failed", rules: tuple[Rule, ...] = RULES) -> Column:
    """True where none of the policy's bits is set."""
    return col(failed).bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ablation(led: DataFrame, policy: Policy, failed: str = "failed", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: texts that fail it, and texts that only it removes.

    One aggregation counts distinct bit patterns (at most 2^rules rows), the rest works on those.
    """
    mask, used = policy.mask(rules), [r for r in rules if r.name in policy.rules]
    patterns = led.groupBy(col(failed).bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    table = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in used])
    each = patterns.select("bits", "n", F.inline(table))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(total(hit).alias("n_failed"), total(F.col("bits") == F.col("bit")).alias("n_only"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledger(documents(spark, sf_dir))
    q = F.col("quality")
    shown = [q[m].alias(m) for m in MEASURES[:5]]
    policy = F.lit(f"{PRODUCTION.name}-{PRODUCTION.version}").alias("policy")
    return led.select("doc_id", *shown, (~passes(BASE)).alias("base_failed"), passes(PRODUCTION).alias("kept"), "failed", policy)


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the production policy removes, and what it alone removes."""
    return ablation(ledger(documents(spark, sf_dir)), PRODUCTION)


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT row_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i
  FROM (SELECT row_number() OVER () AS row_id, w FROM t)
), repeats AS (
  SELECT row_id, i FROM (
    SELECT row_id, i, count(*) OVER (PARTITION BY row_id, array_to_string(w[i:i+7], ' ')) AS n FROM windows
  ) WHERE n > 1
), n_repeats AS (
  SELECT row_id, count(DISTINCT j) AS n FROM (SELECT row_id, unnest(range(i, i + 8)) AS j FROM repeats) GROUP BY row_id
), m AS (
  SELECT t.doc_id, len(w)::bigint AS n_words,
         coalesce(list_sum(list_transform(w, lambda s: length(s))), 0)::bigint AS word_chars,
         length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
         (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines, len(l)::bigint AS n_lines,
         coalesce(n, 0)::bigint AS n_repeat_words
  FROM (SELECT row_number() OVER () AS row_id, * FROM t) t LEFT JOIN n_repeats USING (row_id)
), f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 16 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END)::bigint AS failed
  FROM m
)
"""
ABLATION_SQL = OP5_SQL + """
SELECT rule, count(*) FILTER (failed & bit <> 0)::bigint AS n_failed, count(*) FILTER (failed = bit)::bigint AS n_only
FROM f, (VALUES ('few_words', 1), ('repeated_words', 2), ('short_words', 4), ('long_words', 8), ('symbols', 16), ('duplicate_lines', 32)) AS r(rule, bit)
GROUP BY rule
"""
OP5_SQL += """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept,
       failed, 'production-1' AS policy
FROM f
"""
