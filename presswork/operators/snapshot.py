"""The snapshot of all current stories, and what stands in where it can't be read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dashboard import snapshot_order

ITEM = "id string, title string, url string, description string, category string, published timestamp, score double, source_id string"
#: Last resort where nothing else can be read: a few stories that say so.
SAMPLES = (
    ("sample-research", "Sample: a paper on small models", "research"),
    ("sample-product", "Sample: a release of an assistant", "product"),
    ("sample-funding", "Sample: a round of funding", "funding"),
    ("sample-policy", "Sample: a rule for model makers", "policy"),
    ("sample-news", "Sample: what happened this week", "news"),
)


def samples(spark: SparkSession) -> DataFrame:
    rows = [(i, t, f"https://example.com/{i}", None, c, None, None, "sample") for i, t, c in SAMPLES]
    return spark.createDataFrame(rows, ITEM)


def statistics(stories: DataFrame, as_of: Column, zone: str = "UTC") -> DataFrame:
    """Stories, and those of today in a time zone."""
    from presswork.functions.scalars import local_day

    today = local_day(F.col("published").cast("timestamp"), zone) == local_day(as_of, zone)
    return stories.agg(F.count("*").alias("total"), F.count_if(today).alias("today"))


def write(stories: DataFrame, path: str, as_of: Column, sources: DataFrame | None = None) -> None:
    """Stories in snapshot order, their number and time, and the statuses of their sources, each in a folder of its own below `path`."""
    stories.orderBy(*snapshot_order()).write.mode("overwrite").json(f"{path}/items")
    scores = stories.agg(F.count("*").alias("stories"), F.min("score").alias("lowest"), F.max("score").alias("highest"), as_of.alias("generatedAt"))
    scores.coalesce(1).write.mode("overwrite").json(f"{path}/stats")
    if sources is not None:
        sources.coalesce(1).write.mode("overwrite").json(f"{path}/sources")


def read(spark: SparkSession, path: str, schema: str = ITEM) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/items")


#: Conditions of Spark's errors that say that a table isn't there or can't be read.
UNREADABLE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE", "FAILED_READ_FILE", "MALFORMED_RECORD_IN_PARSING", "TABLE_OR_VIEW_NOT_FOUND")


def first_available(readers: dict[str, Callable[[], DataFrame | None]]) -> tuple[str, DataFrame]:
    """Name and rows of the first reader, in order, that can be read and has a row; ("none", the last one's rows) if none has.

    A snapshot, a cached table no older than the caller allows, a live build and the samples can stand in such a row.
    """
    last = None
    for name, reader in readers.items():
        try:
            rows = reader()
            if rows is not None:
                last = rows
                if not rows.isEmpty():
                    return name, rows
        except FileNotFoundError:
            continue
        except PySparkException as error:  # what can't be read is passed over, as a missing file is
            if (error.getCondition() or "").split(".")[0] not in UNREADABLE:
                raise
    if last is None:
        raise ValueError("no source could be read")
    return "none", last


def fresh_enough(generated: float | None, now: float, minutes: float = 15) -> bool:
    """Whether a cached table, made at a time in seconds, may still be used."""
    return generated is not None and now - generated < minutes * 60
