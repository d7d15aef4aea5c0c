"""Health of runs and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_class(status: Column) -> Column:
    """ok, error, and a warning for anything else, also for none."""
    return F.when(status == "ok", "ok").when(status == "error", "error").otherwise("warning")


def tally(status: Column) -> list[Column]:
    """Counts of a run's sources; here a missing status is ok."""
    s = F.coalesce(status, F.lit("ok"))
    return [
        F.count_if(s == "error").alias("errors"),
        F.count_if(~s.isin("ok", "error")).alias("warnings"),
        F.count_if(s == "ok").alias("ok"),
    ]


def run_status(errors: Column, warnings: Column, total: Column) -> Column:
    """error if every source failed, degraded if any did or warned, else ok."""
    return F.when((total > 0) & (errors == total), "error").when((errors > 0) | (warnings > 0), "degraded").otherwise("ok")


def run_health(statuses: DataFrame) -> DataFrame:
    """A row per run from rows (run_id, source_id, status, items)."""
    per = statuses.groupBy("run_id").agg(*tally(F.col("status")), F.count("*").alias("sources"), F.sum("items").alias("items"))
    return per.withColumn("status", run_status(F.col("errors"), F.col("warnings"), F.col("sources")))


def source_health(statuses: DataFrame) -> DataFrame:
    """A row per source: runs of each class, items, and the class of its last run."""
    c = status_class(F.col("status"))
    return statuses.groupBy("source_id").agg(
        F.count_if(c == "ok").alias("ok"),
        F.count_if(c == "warning").alias("warnings"),
        F.count_if(c == "error").alias("errors"),
        F.sum("items").alias("items"),
        F.max_by(c, "run_id").alias("last"),
    )


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("run_id")).limit(1)


def history(runs: DataFrame, limit: int = 30) -> DataFrame:
    return runs.where("run_id is not null").orderBy(F.desc("run_id")).limit(limit)


def capped(runs: DataFrame, cap: int = 120) -> DataFrame:
    """The last runs with their place, the latest first."""
    some = runs.orderBy(F.desc("run_id")).limit(cap)
    return some.withColumn("place", F.row_number().over(Window.orderBy(F.desc("run_id"))))


def log_line(name: Column, status: Column, items: Column, millis: Column) -> Column:
    tag = F.when(status == "ok", "[OK]").when(status == "error", "[ERROR]").otherwise("[WARN]")
    return F.format_string("%s %s — %d items (%d ms)", tag, name, items, millis)
