"""Entities of stories: names, statistics, pages and co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions.scalars import one_decimal, slug

GROUPS = {"company": "companies", "model": "models", "research": "technologies"}


def mentions(stories: DataFrame, groups: dict[str, str] = GROUPS) -> DataFrame:
    """(group, name, id, score) of each mention, all groups in one pass."""
    have = {g: c for g, c in groups.items() if c in stories.columns}
    table = F.array(*[F.struct(F.lit(g).alias("group"), F.col(c).alias("names")) for g, c in have.items()])
    each = stories.select("id", "score", F.inline(table))
    return each.select("group", F.explode(F.transform("names", lambda x: F.trim(x))).alias("name"), "id", "score").where("name <> ''")


def names(stories: DataFrame, group: str) -> DataFrame:
    """Name, slug and mentions of every entity of a group."""
    per = mentions(stories, {group: GROUPS[group]}).groupBy("name").agg(F.count("*").alias("n"))
    return per.select("name", slug(F.col("name")).alias("slug"), "n")


def statistics(stories: DataFrame, group: str) -> DataFrame:
    """Mentions by exact name, and the mean score of stories that have the name in any case."""
    each = mentions(stories, {group: GROUPS[group]}).withColumn("low", F.lower("name"))
    counted = each.groupBy("name", "low").agg(F.count("*").alias("n"))
    # stories once per name whatever its case
    scored = each.groupBy("low", "id").agg(F.first("score").alias("score")).groupBy("low")
    scored = scored.agg(F.avg("score").alias("mean"), F.count("*").alias("stories"))
    out = counted.join(scored, "low")
    return out.select("name", "n", "stories", one_decimal(F.col("mean")).alias("avg_score"))


def of_entity(stories: DataFrame, group: str, name: str) -> DataFrame:
    """Stories that have the name, in any case."""
    low = name.strip().lower()
    return stories.where(F.exists(GROUPS[group], lambda x: F.lower(F.trim(x)) == low))


def related(stories: DataFrame, group: str, name: str, limit: int | None = 12) -> DataFrame:
    """Names of the other groups in the entity's stories."""
    others = {g: c for g, c in GROUPS.items() if g != group}
    per = mentions(of_entity(stories, group, name), others).groupBy("group", "name").agg(F.count("*").alias("n"))
    return per.orderBy(F.desc("n"), "name", "group").limit(limit) if limit else per


def group_of(stories: DataFrame) -> DataFrame:
    """(token, group): which group a name belongs to; company before model before research."""
    place = F.create_map(*[F.lit(x) for i, g in enumerate(GROUPS) for x in (g, i)])
    each = mentions(stories).select(F.lower("name").alias("token"), F.struct(place[F.col("group")].alias("p"), "group").alias("g"))
    return each.groupBy("token").agg(F.min("g").alias("g")).select("token", F.col("g.group").alias("group"))


def resolve(stories: DataFrame, group: str, wanted: str) -> DataFrame:
    """The name with a slug; the one with most mentions if several have it."""
    return names(stories, group).where(F.col("slug") == wanted).orderBy(F.desc("n"), "name").limit(1)


def overview(stories: DataFrame) -> DataFrame:
    """Names and mentions of each group."""
    return mentions(stories).groupBy("group").agg(F.countDistinct("name").alias("names"), F.count("*").alias("mentions"))


def totals(stories: DataFrame) -> DataFrame:
    """One row: stories, and distinct names of each group."""
    have = {g: c for g, c in GROUPS.items() if c in stories.columns}
    table = F.array(F.struct(F.lit("stories").alias("group"), F.array(F.lit("")).alias("names")), *[F.struct(F.lit(g).alias("group"), F.col(c).alias("names")) for g, c in have.items()])
    each = stories.select(F.inline(table)).select("group", F.explode(F.transform("names", lambda x: F.trim(x))).alias("name")).where("group = 'stories' or name <> ''")
    per = each.groupBy("group", "name").agg(F.count("*").alias("n"))
    of = lambda g: F.coalesce(F.sum(F.when(F.col("group") == g, 1)), F.lit(0))
    return per.agg(F.coalesce(F.max(F.when(F.col("group") == "stories", F.col("n"))), F.lit(0)).alias("stories"), *[of(g).alias(c) for g, c in have.items()])


def url(group: str, name_slug: str) -> str:
    return f"#/radar/{group}/{name_slug}"


def parse_hash(text: str) -> tuple[str, str | None, str | None]:
    """(kind, group, slug): global, entity, unknown or none."""
    parts = [p for p in text.lstrip("#").split("/") if p]
    if not parts or parts[0] != "radar":
        return "none", None, None
    if len(parts) == 1:
        return "global", None, None
    if len(parts) == 3 and parts[1] in GROUPS:
        return "entity", parts[1], parts[2]
    return "unknown", None, None


def page(stories: DataFrame, group: str, name: str) -> DataFrame:
    """Stories of an entity, the best first."""
    return of_entity(stories, group, name).orderBy(F.coalesce("score", F.lit(0)).desc(), F.desc("published"), "id")


def ranked_names(stories: DataFrame, group: str, cap: int = 50) -> DataFrame:
    order = Window.orderBy(F.desc("n"), "name")
    return names(stories, group).orderBy(F.desc("n"), "name").limit(cap).withColumn("rank", F.row_number().over(order))
