"""Faceted search over stories: a request becomes one conjunction that Catalyst can push down."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions.scalars import band, local_day
from presswork.operators import ranking

#: Pages that end behind so many rows are cut out of a distributed order.
DEEP = 10_000
ARRAYS = ("companies", "models", "people", "technologies")


@dataclass(frozen=True)
class Request:
    """Facets of a search; an empty one does not filter."""

    q: str = ""
    first_day: date | None = None
    last_day: date | None = None
    categories: tuple[str, ...] = ()
    subcategories: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    importance: tuple[str, ...] = ()
    companies: tuple[str, ...] = ()
    models: tuple[str, ...] = ()
    people: tuple[str, ...] = ()
    technologies: tuple[str, ...] = ()
    page: int = 1
    size: int = 48
    searched: tuple[str, ...] = field(default=("title", "description", "summary", "source_id", "source_name", "tags", *ARRAYS))


def query_tokens(q: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", q.lower()) if t]


def haystack(df: DataFrame, searched: tuple[str, ...]) -> Column:
    """The lower-case text that free text looks in; absent columns count as empty."""
    parts = []
    for name in searched:
        if name in df.columns:
            kind = dict(df.dtypes)[name]
            parts.append(F.array_join(name, " ") if kind.startswith("array") else F.col(name).cast("string"))
    return F.lower(F.concat_ws(" ", *parts)) if parts else F.lit("")


def in_list(value: Column, wanted: tuple[str, ...]) -> Column:
    """Equal to one of the wanted, whatever the case; null is not."""
    return F.coalesce(F.lower(value).isin([w.lower() for w in wanted]), F.lit(False))


def overlaps(values: Column, wanted: tuple[str, ...]) -> Column:
    """Has one of the wanted, whatever the case."""
    low = F.array(*[F.lit(w.lower()) for w in wanted])
    return F.coalesce(F.arrays_overlap(F.transform(values, F.lower), low), F.lit(False))


def condition(df: DataFrame, r: Request) -> Column:
    """The conjunction of all facets that are set. Free text matches substrings, all of them."""
    out = F.lit(True)
    tokens = query_tokens(r.q)
    if tokens:
        hay = haystack(df, r.searched)
        for t in tokens:
            out = out & hay.contains(t)
    day = F.to_date("published")
    if r.first_day:
        out = out & F.coalesce(day >= F.lit(r.first_day), F.lit(False))
    if r.last_day:
        out = out & F.coalesce(day <= F.lit(r.last_day), F.lit(False))
    if r.categories:
        out = out & in_list(F.col("category"), r.categories)
    if r.subcategories:
        out = out & in_list(F.col("subcategory"), r.subcategories)
    if r.sources:
        out = out & (F.col("source_id").isin(list(r.sources)) | in_list(F.col("source_name"), r.sources))
    if r.importance:
        out = out & in_list(band(F.col("score"), "low"), r.importance)
    for name in ARRAYS:
        wanted = getattr(r, name)
        if wanted:
            out = out & overlaps(F.col(name), wanted)
    return out


def order() -> list[Column]:
    """Score (none is -1), date (none is oldest), id."""
    return [F.coalesce("score", F.lit(-1)).desc(), F.col("published").desc_nulls_last(), F.col("id").asc()]


def page(df: DataFrame, keys: list[Column], number: int = 1, size: int = 48) -> DataFrame:
    """One page of the ordered rows; numbers beyond the ends give the nearest page."""
    size = max(1, size)
    pages = max(1, -(-df.count() // size))
    number = min(max(1, number), pages)
    if number * size > DEEP:
        return ranking.page(df, keys, number, size)
    return df.orderBy(*keys).offset((number - 1) * size).limit(size)


def search(df: DataFrame, r: Request) -> DataFrame:
    return page(df.where(condition(df, r)), order(), r.page, r.size)


def facets(df: DataFrame) -> DataFrame:
    """(facet, value): the distinct values of every facet, source ids and names together, and the ends of the date range.

    One scan and one aggregation; the days, of which there are few, are put together after it.
    """
    one = lambda name, c: F.struct(F.lit(name).alias("facet"), F.array(c.cast("string")).alias("values"))
    parts = [one("category", F.col("category")), one("source", F.col("source_id")), one("source", F.col("source_name")), one("day", F.to_date("published"))]
    parts += [one("subcategory", F.col("subcategory"))] if "subcategory" in df.columns else []
    parts += [F.struct(F.lit(name).alias("facet"), F.col(name).alias("values")) for name in ARRAYS if name in df.columns]
    each = df.select(F.inline(F.array(*parts))).select("facet", F.explode("values").alias("value"))
    seen = each.where("value is not null and value <> ''").distinct()
    days = F.array(F.struct(F.lit("first_day").alias("facet"), F.min("value").alias("value")), F.struct(F.lit("last_day").alias("facet"), F.max("value").alias("value")))
    is_day = F.col("facet") == "day"
    kinds = seen.groupBy("facet", F.when(~is_day, F.col("value")).alias("v")).agg(days.alias("ends"))
    shown = F.when(is_day, F.col("ends")).otherwise(F.array(F.struct(F.col("facet").alias("facet"), F.col("v").alias("value"))))
    return kinds.select(F.inline(shown))


def subcategories(df: DataFrame) -> DataFrame:
    """The distinct subcategories, in order."""
    return df.select("subcategory").where("subcategory is not null and subcategory <> ''").distinct().orderBy("subcategory")


def live_filter(df: DataFrame, sources: list[str], category: str, text: str) -> DataFrame:
    """Stories of some sources and one category whose title or description has the text as a whole."""
    low = text.lower()
    hit = F.lower("title").contains(low) | F.lower(F.coalesce("description", F.lit(""))).contains(low)
    return df.where(F.col("source_id").isin(sources) & (F.col("category") == category) & hit)


def by_range(df: DataFrame, name: str, as_of: Column, zone: str = "UTC") -> DataFrame:
    """today and yesterday are calendar days of a time zone; week is the last seven days and anything after."""
    if name == "week":
        return df.where(F.col("published") >= as_of - F.expr("interval 7 days"))
    back = {"today": 0, "yesterday": 1}[name]
    return df.where(local_day(F.col("published").cast("timestamp"), zone) == F.date_sub(local_day(as_of, zone), back))


def latest(df: DataFrame, as_of: Column, hours: int = 48) -> DataFrame:
    return df.where(F.col("published") >= as_of - F.expr(f"interval {hours} hours"))


def today_or_latest(df: DataFrame, as_of: Column, hours: int = 48) -> DataFrame:
    """Today's stories, or the latest ones if there are none today."""
    today = by_range(df, "today", as_of).withColumn("from_today", F.lit(True))
    recent = latest(df, as_of, hours).withColumn("from_today", F.lit(False))
    some = by_range(df, "today", as_of).limit(1).select(F.lit(1).alias("some"))
    return today.unionByName(recent.join(F.broadcast(some), how="left_anti", on=F.col("some") == 1))


def recent(df: DataFrame, limit: int = 100) -> DataFrame:
    when = F.coalesce("published", "discovered") if "discovered" in df.columns else F.col("published")
    return df.orderBy(when.desc_nulls_last(), "id").limit(limit)


def pages_so_far(df: DataFrame, keys: list[Column], number: int, size: int = 48) -> DataFrame:
    """All pages up to one, as a list that grows shows them."""
    return df.orderBy(*keys).limit(max(1, number) * max(1, size))


def ranked(df: DataFrame, keys: list[Column], limit: int, name: str = "rank") -> DataFrame:
    """The first rows with their number."""
    return ranking.first(df, keys, limit, name)
