"""Streams of stories: windows of days, deduplication within a watermark, upserts into the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from presswork.operators.archive import Archive


def read(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream, with the schema that it has now."""
    now = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    alone = len(now.inputFiles()) == 1 and now.inputFiles()[0].endswith("/" + name)
    reader = spark.readStream.schema(now.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder) if alone else reader.parquet(path)


def timed(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need an instant: a timestamp without a zone is taken as UTC, the session's zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def daily_counts(stream: DataFrame, ts: str, key: str, late: str = "2 days") -> DataFrame:
    """Events by UTC day and key; a day is closed when the watermark passes it."""
    return (
        timed(stream, ts)
        .withWatermark(ts, late)
        .groupBy(F.window(ts, "1 day"), key)
        .agg(F.count("*").alias("n"))
        .select(F.to_date("window.start").alias("day"), key, "n")
    )


def sliding_counts(stream: DataFrame, ts: str, key: str, late: str = "2 days") -> DataFrame:
    """Events of the last seven days, day by day."""
    return (
        timed(stream, ts)
        .withWatermark(ts, late)
        .groupBy(F.window(ts, "7 days", "1 day"), key)
        .agg(F.count("*").alias("n"))
        .select(F.to_date("window.end").alias("until"), key, "n")
    )


def dedupe(stream: DataFrame, ts: str, key: str, late: str = "3 days") -> DataFrame:
    """The first event of each key within the watermark."""
    return timed(stream, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def upsert(stream: DataFrame, archive: Archive, checkpoint: str) -> StreamingQuery:
    """All that is there into the archive, batch by batch; a batch that is run again changes nothing."""

    def each(batch: DataFrame, _: int) -> None:
        archive.upsert(batch)

    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
