"""The log of runs: a record for each, a capped summary of the last ones, and what a health page reads from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions.scalars import djb2

from .health import run_status, status_class

CAP = 120
RECORD = (
    "runId string, createdAt timestamp, startedAt timestamp, finishedAt timestamp, normalized long, stored long, storedDays long, upserted long, "
    "updated long, unchanged long, signalMean double, summarized long, sources array<struct<id:string,name:string,status:string,itemCount:int,errorType:string,responseMs:long>>"
)
NUMBERS = ("stored", "upserted", "storedDays", "signalMean", "summarized")


def run_id(finished: Column, stored: Column) -> Column:
    """yyyy-MM-dd-HHmmss and six hex digits of a hash of what was stored that day: the same run has the same id."""
    day = F.date_format(finished, "yyyy-MM-dd")
    mark = F.substring(djb2(F.concat(F.coalesce(F.nullif(stored.cast("string"), F.lit("0")), F.lit("")), day)), 1, 6)
    return F.concat(day, F.lit("-"), F.date_format(finished, "HHmmss"), F.lit("-"), mark)


def summaries(records: DataFrame) -> DataFrame:
    """A summary of each record: its numbers, its sources by status (a missing one is ok), whether it is degraded, and its status."""
    of = lambda test: F.coalesce(F.size(F.filter("sources", test)), F.lit(0))
    status = lambda s: F.coalesce(s["status"], F.lit("ok"))
    made = records.select(
        "runId", "createdAt", "startedAt", "finishedAt", *NUMBERS,
        of(lambda s: status(s) == "ok").alias("sourcesOk"),
        of(lambda s: ~status(s).isin("ok", "error")).alias("sourcesWarning"),
        of(lambda s: status(s) == "error").alias("sourcesError"),
    )
    total = F.col("sourcesOk") + F.col("sourcesWarning") + F.col("sourcesError")
    made = made.withColumn("degraded", F.col("sourcesError") + F.col("sourcesWarning") > 0)
    return made.withColumn("status", run_status(F.col("sourcesError"), F.col("sourcesWarning"), total))


def guarded(rows: DataFrame) -> DataFrame:
    """Summaries from records of text fields: what is no number is null."""
    return rows.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in NUMBERS if c in rows.columns})


def latest_with_sources(records: DataFrame) -> DataFrame:
    """The last record that has the statuses of its sources."""
    return records.where(F.coalesce(F.size("sources"), F.lit(0)) > 0).orderBy(F.desc("finishedAt"), F.desc("runId")).limit(1)


def source_rows(records: DataFrame) -> DataFrame:
    """A health row for each source of some records, with its class."""
    each = records.select("runId", F.inline("sources"))
    return each.withColumn("class", status_class(F.col("status")))


class RunLog:
    """Records of runs as JSON in a folder, a partition for each run, so that writing one again replaces it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        empty = self.spark.createDataFrame([], RECORD)
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return empty
        return self.spark.read.schema(RECORD).json(self.path).select(*empty.columns)

    def append(self, record: DataFrame) -> DataFrame:
        """Write records (one for each run); those without a runId get one. Returns the ids."""
        missing = {f.split()[0]: f.split(" ", 1)[1] for f in RECORD.split(", ")}
        rows = record.withColumns({c: F.lit(None).cast(k) for c, k in missing.items() if c not in record.columns})
        rows = rows.withColumn("finishedAt", F.coalesce("finishedAt", "createdAt"))
        rows = rows.withColumn("runId", F.coalesce("runId", run_id(F.col("finishedAt"), F.col("stored")))).select(*missing)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("runId").json(self.path)
        return rows.select("runId")

    def list(self) -> DataFrame:
        return self.read().select("runId").orderBy("runId")

    def recent(self, cap: int = CAP) -> DataFrame:
        """Summaries of the last runs."""
        return summaries(self.read()).orderBy(F.desc("finishedAt"), F.desc("runId")).limit(cap)

    def health(self) -> tuple[DataFrame, DataFrame]:
        """Summaries of the last ten runs, and the sources of the last run that told them."""
        return self.recent(10), source_rows(latest_with_sources(self.read()))
