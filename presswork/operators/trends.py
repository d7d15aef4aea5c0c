"""Counts, dense series and period-over-period trends.

Stories have at least: id, published (timestamp), score, category, companies,
models, source_id. Every operator is one aggregation with map-side partial sums, but for those that need the
bounds of the dates first; these, a row each, are cross-joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions.scalars import band, one_decimal
from presswork.operators import ranking

DAYS = {"7d": 6, "30d": 29}
CATEGORY_ORDER = ("research", "product", "funding", "policy", "news")
BANDS = ("high", "medium", "low", "unknown")


def with_day(stories: DataFrame) -> DataFrame:
    return stories.withColumn("day", F.to_date("published"))


def window_bounds(stories: DataFrame, period: str = "all") -> DataFrame:
    """One row: first and last day of the period that ends with the last day seen."""
    found = with_day(stories).agg(F.min("day").alias("first"), F.max("day").alias("last"))
    start = F.date_sub("last", DAYS[period]) if period in DAYS else F.col("first")
    return found.select(start.alias("from_day"), F.col("last").alias("to_day"))


def window_items(stories: DataFrame, period: str = "all") -> DataFrame:
    """Stories of the period; those without a date drop out."""
    bounds = window_bounds(stories, period)
    return with_day(stories).join(F.broadcast(bounds), F.col("day").between(F.col("from_day"), F.col("to_day"))).drop("from_day", "to_day")


def average(score: Column) -> Column:
    """Mean to one decimal, null if there is no score."""
    return one_decimal(F.avg(score))


def daily_series(stories: DataFrame, period: str = "all") -> DataFrame:
    """A row for every day of the period, also those without stories: count, mean score, bands."""
    bounds = window_bounds(stories, period).where("from_day is not null")
    spine = bounds.select(F.explode(F.sequence("from_day", "to_day")).alias("day"))
    per = with_day(stories).groupBy("day").agg(
        F.count("*").alias("n"),
        average(F.col("score")).alias("avg_score"),
        *[F.count_if(band(F.col("score")) == b).alias(b) for b in BANDS],
    )
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", *BANDS)]
    return spine.join(per, "day", "left").select("day", "avg_score", *filled)


def band_distribution(stories: DataFrame) -> DataFrame:
    return stories.groupBy(band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


def category_mix(stories: DataFrame) -> DataFrame:
    """Count and percentage of each category, in the fixed order, others after it by name."""
    per = stories.groupBy(F.coalesce("category", F.lit("other")).alias("category")).agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, CATEGORY_ORDER)), F.col("category"))
    place = F.when(place > 0, place).otherwise(len(CATEGORY_ORDER) + 1)
    total = F.sum("n").over(Window.partitionBy())
    ranked = per.withColumn("pct", one_decimal(F.col("n") * 100 / total)).withColumn("place", place)
    return ranked.select("category", "n", "pct", F.row_number().over(Window.orderBy("place", "category")).alias("position"))


def count_by(stories: DataFrame, column: str) -> DataFrame:
    """Mentions of each name in an array column; a name that a row has twice counts twice."""
    each = stories.select(F.explode(F.transform(column, lambda x: F.trim(x))).alias("name")).where("name <> ''")
    return each.groupBy("name").agg(F.count("*").alias("n"))


def top(counts: DataFrame, limit: int = 8) -> DataFrame:
    """The largest counts, ties by name."""
    return counts.orderBy(F.desc("n"), "name").limit(limit)


def source_counts(stories: DataFrame) -> DataFrame:
    """Stories of each source, and the name it had first."""
    return stories.groupBy("source_id").agg(F.count("*").alias("n"), F.min_by("source_name", "id").alias("source_name"))


def trending(stories: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Mentions in the last seven days against the seven before: change in percent, direction, rank.

    A name that is new ranks as a change of 1.
    """
    last = with_day(stories).agg(F.max("day").alias("last"))
    each = with_day(stories).join(F.broadcast(last)).select("day", "last", F.explode(F.transform(column, lambda x: F.trim(x))).alias("name")).where("name <> ''")
    age = F.datediff("last", "day")
    per = each.groupBy("name").agg(
        F.count_if(age.between(0, 6)).alias("current"), F.count_if(age.between(7, 13)).alias("prior")
    )
    per = per.where("current > 0 or prior > 0")
    pct = F.when(F.col("prior") > 0, one_decimal((F.col("current") - F.col("prior")) * 100 / F.col("prior")))
    direction = (
        F.when(F.col("prior") == 0, "new").when(F.col("current") > F.col("prior"), "up").when(F.col("current") < F.col("prior"), "down").otherwise("flat")
    )
    out = per.select("name", "current", "prior", pct.alias("pct"), direction.alias("direction"))
    keys = [F.desc(F.when(F.col("direction") == "new", 1.0).otherwise(F.col("pct"))), F.desc("current"), F.col("name")]
    return ranking.first(out, keys, limit) if limit else ranking.numbered(out, keys)


def peak_day(series: DataFrame) -> DataFrame:
    """The day with most stories, the earliest of several."""
    return series.orderBy(F.desc("n"), "day").limit(1).select("day", "n")


def active_days(series: DataFrame) -> DataFrame:
    return series.agg(F.count_if(F.col("n") > 0).alias("active_days"), F.count("*").alias("days"))


def dominant_band(stories: DataFrame) -> DataFrame:
    """The most frequent band; ties go to high, medium, low, unknown in this order."""
    place = F.array_position(F.array(*map(F.lit, BANDS)), F.col("band"))
    return band_distribution(stories).orderBy(F.desc("n"), place).limit(1).select("band", "n")


def facts(stories: DataFrame) -> DataFrame:
    """Label and value of the headline figures, as text; those without a value are left out.

    One scan: every story tells its day, band, category, source and companies, which are counted together.
    The counts are few (days, names), and each figure is the best of its kind among them.
    """
    one = lambda name, c: F.struct(F.lit(name).alias("kind"), F.array(c.cast("string")).alias("values"))
    places = F.array(
        one("all", F.lit("")), one("day", F.to_date("published")), one("band", band(F.col("score"))), one("category", F.coalesce("category", F.lit("other"))),
        one("source", F.col("source_id")), F.struct(F.lit("company").alias("kind"), F.transform("companies", lambda x: F.trim(x)).alias("values")),
    )
    each = stories.select("score", F.inline(places)).select("score", "kind", F.explode("values").alias("value")).where("value is not null")
    each = each.where("kind = 'all' or value <> ''")
    counts = each.groupBy("kind", "value").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    fixed = {b: f"{i}" for i, b in enumerate(BANDS)} | {c: f"{i}" for i, c in enumerate(CATEGORY_ORDER)}
    table = F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv])
    placed = F.when(F.col("kind").isin("band", "category"), F.coalesce(F.try_element_at(table, F.col("value")), F.lit("9")))
    tie = F.concat(F.coalesce(placed, F.lit("")), F.col("value"))
    best = counts.groupBy("kind").agg(
        F.min_by("value", F.struct(-F.col("n"), tie)).alias("top"), F.count("*").alias("kinds"), F.max("n").alias("n"), F.max("mean").alias("mean")
    )
    row = lambda label, value: F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"))
    k = F.col("kind")
    made = (
        F.when(k == "all", F.array(row("stories", F.col("n")), row("average score", one_decimal(F.col("mean")))))
        .when(k == "day", F.array(row("peak day", F.col("top")), row("active days", F.col("kinds"))))
        .when(k == "band", F.array(row("dominant band", F.col("top"))))
        .when(k == "category", F.array(row("top category", F.col("top"))))
        .when(k == "company", F.array(row("top company", F.col("top"))))
        .otherwise(F.array(row("top source", F.col("top"))))
    )
    return best.select(F.inline(made)).where("value is not null")


def extremes(series: DataFrame) -> DataFrame:
    """Bounds of a chart: days, the largest count and the first day that has it, the smallest and largest mean."""
    return series.agg(
        F.min("day").alias("from_day"), F.max("day").alias("to_day"), F.max("n").alias("largest"),
        F.min_by("day", F.struct(-F.col("n"), F.col("day"))).alias("peak"), F.min("avg_score").alias("lowest"), F.max("avg_score").alias("highest"),
    )


def report(stories: DataFrame, period: str = "all") -> dict[str, DataFrame]:
    """All parts of the trend page for one period."""
    inside = window_items(stories, period)
    series = daily_series(stories, period).join(window_bounds(stories, period), F.col("day").between(F.col("from_day"), F.col("to_day")))
    series = series.drop("from_day", "to_day")
    return {
        "series": series,
        "bands": band_distribution(inside),
        "mix": category_mix(inside),
        "companies": top(count_by(inside, "companies")),
        "models": top(count_by(inside, "models")),
        "sources": source_counts(inside),
        "trending": trending(inside, "companies", 8),
        "peak": peak_day(series),
        "active": active_days(series),
        "dominant": dominant_band(inside),
        "facts": facts(inside),
    }
