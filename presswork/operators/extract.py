"""Article texts of stories: which pages are asked for, one fetch for all stories that share it, and what came of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions import html as H
from presswork.functions import scalars as N

TIMEOUT = 12
MAX_BYTES = 500_000


def over_http(requests: DataFrame, partitions: int = 16) -> DataFrame:
    """Answers for rows with a url: a host's pages are in one partition, so few requests go to it at once."""
    from presswork.sources.feeds import fetch

    dealt = requests.repartition(partitions, N.url_host(F.col("url")))
    return fetch(dealt, timeout=TIMEOUT, max_bytes=MAX_BYTES, retries=3)


def requested(stories: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Stories with `url` (publisherUrl, else canonicalUrl, else originalUrl), `key`, under which fetches are shared, and `state`.

    States: skipped (there is a text already), unaddressed (no url), disabled (the source is not in `allowed`, a table with
    source_id), unwanted (a host or file without articles), else attempted.
    """
    url = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("publisherUrl", "canonicalUrl", "originalUrl") if c in stories.columns])
    rows = stories.withColumn("url", url).withColumn("key", F.coalesce(N.cache_key(F.col("url")), F.col("url")))
    if allowed is None:
        rows = rows.withColumn("_allowed", F.lit(True))
    else:
        some = allowed.select("source_id").distinct().withColumn("_allowed", F.lit(True))
        rows = rows.join(some, "source_id", "left")
    state = (
        F.when(F.trim(F.coalesce("content", F.lit(""))) != "", "skipped")
        .when(F.col("url").isNull(), "unaddressed")
        .when(F.col("_allowed").isNull(), "disabled")
        .when(H.skipped(F.col("url")) | ~F.col("url").rlike("(?i)^https?://"), "unwanted")
        .otherwise("attempted")
    )
    return rows.withColumn("state", state).drop("_allowed")


def extract_articles(stories: DataFrame, allowed: DataFrame | None = None, fetcher: Callable[[DataFrame], DataFrame] = over_http) -> DataFrame:
    """Stories with `content` filled where a page gave an article, and `outcome`.

    Outcomes: skipped, unaddressed, disabled, extracted, failed; `first` is true for the story that a fetch was made for, the
    others share it. `fetcher` adds the columns of `FETCHED` to distinct (key, url) rows. Nothing is ever overwritten or raised.
    """
    rows = requested(stories, allowed)
    wanted = rows.where("state = 'attempted'").groupBy("key").agg(F.min(F.struct("id", "url")).alias("first"))
    answers = fetcher(wanted.select("key", F.col("first.id").alias("first_id"), F.col("first.url").alias("url")))
    good = F.col("error").isNull() & H.accepts(F.col("content_type"))
    texts = answers.select("key", "first_id", "status", "error", "requests", H.article_text(F.when(good, F.col("body"))).alias("_text"))
    both = rows.join(texts, "key", "left")
    outcome = (
        F.when(F.col("state").isin("skipped", "unaddressed", "disabled"), F.col("state"))
        .when(F.col("_text").isNotNull() & (F.col("state") == "attempted"), "extracted")
        .otherwise("failed")
    )
    first = F.coalesce((F.col("state") == "attempted") & (F.col("first_id") == F.col("id")), F.lit(False))
    filled = F.when(outcome == "extracted", F.col("_text")).otherwise(F.col("content"))
    keep = [filled.alias("content") if c == "content" else F.col(c) for c in stories.columns]
    return both.select(*keep, outcome.alias("outcome"), first.alias("first"), "status", "error", "requests")


def statistics(extracted: DataFrame) -> DataFrame:
    """Counts for every source, and for all of them (source_id null)."""
    words = F.when(F.col("outcome") == "extracted", N.word_count(F.col("content"))).otherwise(0)
    tried = F.col("outcome").isin("extracted", "failed")
    per = extracted.withColumn("_words", words).rollup("source_id").agg(
        F.count("*").alias("total"),
        F.count_if(tried).alias("attempted"),
        F.count_if(F.col("first")).alias("fetched"),
        F.count_if(tried & ~F.col("first")).alias("cached"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("extracted", "failed", "skipped", "disabled")],
        F.coalesce(F.sum(F.when(F.col("first"), F.col("requests"))), F.lit(0)).alias("requests"),
        F.coalesce(F.sum(F.when(F.col("first"), F.col("requests") - 1)), F.lit(0)).alias("retries"),
        F.sum("_words").alias("words"),
    )
    mean = F.when(F.col("extracted") > 0, F.floor(F.col("words") / F.col("extracted") + 0.5)).otherwise(0)
    return per.withColumn("avg_words", mean)


def by_status(extracted: DataFrame) -> DataFrame:
    """(source_id, kind, value, n): how often each status and each error type came, one for each fetch."""
    made = extracted.where("first")
    status = made.where("status is not null").select("source_id", F.lit("status").alias("kind"), F.col("status").cast("string").alias("value"))
    types = made.where("status is null and error is not null").select("source_id", F.lit("type").alias("kind"), F.col("error").alias("value"))
    return status.unionByName(types).groupBy("source_id", "kind", "value").agg(F.count("*").alias("n"))
