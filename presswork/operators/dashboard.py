"""View models of the front page: top signal, highlights, groups, chips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHIPS = ("companies", "people", "models", "technologies", "tags")


def best_first() -> list[Column]:
    """Score (none is -1), date, then place of arrival."""
    return [F.coalesce("score", F.lit(-1)).desc(), F.col("published").desc_nulls_last(), F.col("id").asc()]


def identity(canonical_url: Column, fingerprint: Column) -> Column:
    return F.coalesce(F.concat(F.lit("url:"), F.nullif(canonical_url, F.lit(""))), F.concat(F.lit("key:"), fingerprint))


def top_signal(stories: DataFrame) -> DataFrame:
    return stories.orderBy(*best_first()).limit(1)


def highlights(stories: DataFrame, key: str) -> DataFrame:
    """`section` of every distinct story: lead, side (the next three) or feed.

    One story of each identity stays. The four that lead are found with a bounded
    top-k; the rest never meet in one task.
    """
    once = Window.partitionBy(key).orderBy(*best_first())
    one = stories.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    head = one.orderBy(*best_first()).limit(4).select("id", *[F.col(c) for c in ("score", "published")])
    placed = head.withColumn("place", F.row_number().over(Window.orderBy(*best_first()))).select("id", "place")
    out = one.join(F.broadcast(placed), "id", "left")
    section = F.when(F.col("place") == 1, "lead").when(F.col("place") <= 4, "side").otherwise("feed")
    return out.withColumn("section", section).drop("place")


def by_subcategory(stories: DataFrame) -> DataFrame:
    """Groups by size, then by first story; other is last."""
    name = F.coalesce("subcategory", F.lit("other"))
    per = stories.groupBy(name.alias("subcategory")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    order = Window.orderBy(F.col("subcategory") == "other", F.desc("n"), "first_id")
    return per.withColumn("position", F.row_number().over(order))


def chips(columns: list[str], cap: int = 6) -> Column:
    """Distinct names over the entity columns, in order."""
    some = [F.coalesce(c, F.array().cast("array<string>")) for c in columns]
    return F.slice(F.array_distinct(F.filter(F.concat(*some), lambda x: x.isNotNull() & (F.trim(x) != ""))), 1, cap)


def all_chips(columns: list[str]) -> Column:
    """Every distinct name over the entity columns and tags, trimmed, in order: what an article's own page shows."""
    some = [F.coalesce(c, F.array().cast("array<string>")) for c in columns]
    return F.array_distinct(F.filter(F.transform(F.concat(*some), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def source_list(configured: DataFrame, stories: DataFrame) -> DataFrame:
    """(source_id, name, color, seen, stories) of each source once: as it is configured, else as its first story by id tells it.

    Both tables are added up by source before they meet.
    """
    config = configured.groupBy(F.col("id").alias("source_id")).agg(F.min_by("name", "name").alias("c_name"), F.min_by("color", "name").alias("c_color"), F.lit(True).alias("known"))
    told = [F.min_by(c, "id").alias(f"s_{c}") for c in ("source_name", "source_color") if c in stories.columns]
    seen = stories.where("source_id is not null").groupBy("source_id").agg(F.count("*").alias("n"), *told)
    both = config.join(seen, "source_id", "full")
    own = lambda c, o: F.when(F.col("known"), F.col(c)).otherwise(F.col(o) if o in both.columns else F.lit(None).cast("string"))
    return both.select(
        "source_id", own("c_name", "s_source_name").alias("name"), own("c_color", "s_source_color").alias("color"),
        F.col("n").isNotNull().alias("seen"), F.coalesce("n", F.lit(0)).alias("stories"),
    )


def card(stories: DataFrame) -> DataFrame:
    """Projection for a card: category (news by default) and whether it has a picture."""
    image = F.col("image") if "image" in stories.columns else F.lit(None).cast("string")
    return stories.select(
        "id", F.coalesce("category", F.lit("news")).alias("category"), (F.coalesce(image, F.lit("")) != "").alias("has_thumb")
    )


def snapshot_order() -> list[Column]:
    return [F.coalesce("score", F.lit(0)).desc(), F.col("published").desc_nulls_last(), F.col("id").asc()]
