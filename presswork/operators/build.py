"""A whole build: from feeds to the archive, the snapshot and the run log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.config import Settings
from presswork.functions import lexicons as lex
from presswork.functions import stories as S
from presswork.functions.scalars import clean_title, story_id
from presswork.operators import cluster, dashboard, extract, snapshot, summaries
from presswork.operators.cluster import save
from presswork.operators.committed import CommittedArchive
from presswork.operators.runs import RunLog
from presswork.sources import feeds
from presswork.sources.schemas import story_errors, with_defaults


@dataclass
class Built:
    """What a build leaves: its stories, those it has rejected with the fields that are wrong, one record for each source, and counts."""

    stories: DataFrame
    rejected: DataFrame
    records: DataFrame
    counts: dict[str, int | float | None]
    run_id: str


def normalised(records: DataFrame, sources: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Stories that keep all rules, and the others with the fields that break one."""
    rows = feeds.normalize(feeds.items_of(records), with_defaults(sources), as_of).withColumn("wrong", story_errors())
    rows = save(rows)
    return rows.where(F.size("wrong") == 0).drop("wrong"), rows.where(F.size("wrong") > 0).select("id", "title", "source", "wrong")


def flat(stories: DataFrame) -> DataFrame:
    """Columns by the names that the stages read."""
    return stories.withColumns(
        {
            "url": F.col("canonicalUrl"), "published": F.col("publishedAt"), "discovered": F.col("discoveredAt"), "source_id": F.col("source.id"),
            "source_name": F.col("source.name"), "reliability": F.col("source.reliability"), "weight": F.col("source.weight"),
            "updated": F.col("updatedAt"), "day": F.to_date(F.coalesce("publishedAt", "discoveredAt")),
        }
    )


def unique(stories: DataFrame) -> DataFrame:
    """One story for each cluster, with the sources that report it."""
    one = cluster.with_sources(cluster.cluster(stories))
    some = F.coalesce(F.col("reportedBy"), F.lit(1))
    drop = {"fingerprint", "root", "canonical", "size", "n_sources", "reportedBy", "sources", "relatedStoryIds"}
    own = F.array(F.struct(F.col("source_id").alias("id"), F.coalesce("source_name", "source_id").alias("name")))
    none = F.array().cast("array<string>")
    return one.select(
        *[c for c in one.columns if c not in drop], F.col("fingerprint"), F.coalesce("sources", own).alias("sources"),
        F.coalesce("relatedStoryIds", none).alias("relatedStoryIds"), some.alias("reportedBy"),
    )


def build(
    sources: DataFrame, archive: CommittedArchive, as_of: Column, log: RunLog, snapshot_path: str, settings: Settings | None = None,
    fetched: DataFrame | None = None, pages: Callable[[DataFrame], DataFrame] = extract.over_http, summariser: Callable[[str], str | dict | None] | None = None,
) -> Built:
    """Ingest, normalise, check, deduplicate, extract, classify, score, summarise, scrub, store, prune, check again, log, and write the snapshot.

    `fetched` and `pages` stand in for the network. Each stage takes the whole table of the one before; tables are cut off where several stages
    read them. The archive is changed by one commit for the stories and one for what has grown too old; if its rows then break a rule,
    `ValueError` is raised before the log and the snapshot are written. `as_of` is a literal time.
    """
    spark = sources.sparkSession
    settings = settings or Settings.of(spark)
    records = save(feeds.ingest(sources.where(F.coalesce("enabled", F.lit(True))), fetched, settings.partitions))
    valid, rejected = normalised(records, sources, as_of)
    rows = save(unique(flat(valid).drop("fingerprint", "sources", "relatedStoryIds")))
    if settings.article_fetch:
        allowed = sources.where("articleFetch").select(F.col("id").alias("source_id"))
        rows = save(extract.extract_articles(rows, allowed, pages).drop("outcome", "first", "status", "error", "requests"))
    own = [c for c in rows.columns if c not in (*S.ENTITY_GROUPS, "subcategory", "category", "tags", "scores", "score", "signal")]
    scored = S.score_stories(S.classify_stories(rows.select(*own)), F.col("reportedBy"))
    done = summaries.summarise(scored, settings.summary_mode, summariser, settings.summary_pool)
    final = save(S.scrub_stories(done).drop("scrubbed_fields"))
    stored = archive.upsert(final, as_of, settings.retention_days).first()
    now = spark.range(1).select(as_of.alias("t"), F.date_format(as_of, "yyyy-MM-dd").alias("day")).first()
    pruned = archive.prune(now.day, settings.retention_days)
    archive.check()
    if mismatched(archive.read()).head(1):
        raise ValueError("ids that do not fit their titles")
    figures = final.agg(F.count("*").alias("stories"), F.min("signal").alias("lowest"), F.max("signal").alias("highest"), F.avg("signal").alias("mean")).first()
    said = summaries.statistics(final).first()
    counts = {
        "normalized": valid.count(), "rejected": rejected.count(), "stories": figures.stories, "stored": stored.total, "storedDays": stored.days,
        "upserted": stored.upserted, "updated": stored.updated, "unchanged": stored.unchanged, "prunedDays": len(pruned),
        "signalMin": figures.lowest, "signalMax": figures.highest, "signalMean": figures.mean, "summarized": said.summarized,
    }
    told = F.struct(
        F.col("source_id").alias("id"), F.col("source_name").alias("name"), "status", F.col("itemCount").cast("int").alias("itemCount"), "errorType",
        F.col("responseMs").cast("long").alias("responseMs"),
    )
    # a build has one record, which holds its sources: a list as long as the list of sources that was given
    record = records.agg(F.sort_array(F.collect_list(told)).alias("sources")).select(
        *[F.lit(counts[c]).alias(c) for c in ("normalized", "stored", "storedDays", "upserted", "updated", "unchanged", "signalMean", "summarized")],
        as_of.alias("startedAt"), as_of.alias("finishedAt"), as_of.alias("createdAt"), "sources",
    )
    run = log.append(record).first().runId
    snapshot.write(final, snapshot_path, as_of, records.select("source_id", "source_name", "status", "itemCount", "errorType", "responseMs"))
    return Built(final, rejected, records, counts, run)


def mismatched(rows: DataFrame) -> DataFrame:
    """Rows whose id is not that of their clean title and address."""
    aliases = lex.publisher_aliases()
    clean = F.coalesce(F.nullif(clean_title(F.col("title"), aliases)["title"], F.lit("")), F.col("title"))
    return rows.select("id", "title", story_id(clean, F.col("originalUrl")).alias("clean_id")).where("id <> clean_id")


def top_signals(stories: DataFrame, limit: int = 10) -> DataFrame:
    """The stories of a build with the strongest signal, in the snapshot's order."""
    return stories.orderBy(*dashboard.snapshot_order()).limit(limit)
