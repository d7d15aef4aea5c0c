"""Schemas of sources, raw items, stories and runs, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCE = (
    "id string, name string, url string, category string, enabled boolean, articleFetch boolean, priority double, "
    "fetchIntervalHours double, parser string, reliability double, weight double, color string"
)
RAW = "title string, link string, pubDate string, description string, image string, describedHref string, tags array<string>"
STORY = (
    "schemaVersion string, id string, fingerprint string, title string, description string, originalUrl string, canonicalUrl string, "
    "publisherUrl string, source struct<id:string,name:string,type:string,reliability:double,priority:double,weight:double,color:string>, "
    "publishedAt timestamp, discoveredAt timestamp, author string, imageUrl string, category string, subcategory string, tags array<string>, "
    "companies array<string>, people array<string>, models array<string>, technologies array<string>, countries array<string>, content string, "
    "ai struct<summary:string,whyItMatters:string,keyTakeaways:array<string>,method:string>, "
    "scores struct<importance:int,impact:int,novelty:int,credibility:int,relevance:int,sourceConfidence:int>, "
    "relatedStoryIds array<string>, sources array<struct<id:string,name:string>>, createdAt timestamp, updatedAt timestamp"
)
RUN = (
    "runId string, startedAt timestamp, finishedAt timestamp, normalized int, stored int, upserted int, updated int, unchanged int, "
    "sources array<struct<id:string,name:string,status:string,itemCount:int,errorType:string,responseMs:int>>"
)
# Defaults of a source.
DEFAULTS = {
    "enabled": True, "articleFetch": False, "priority": 100.0, "fetchIntervalHours": 3.0, "parser": "auto", "reliability": 5.0,
    "weight": 3.0, "color": "#666666",
}


def failures(checks: dict[str, Column]) -> Column:
    """Names of the fields whose check is true (bad), in order; a null check passes."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()]))


def source_errors() -> Column:
    """Fields of a source row that break a rule."""
    c = F.col
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    off = lambda x, ok: ~F.coalesce(ok, F.lit(False))
    return failures(
        {
            "id": off("id", c("id").rlike("^[a-z0-9][a-z0-9-]*$")),
            "name": blank(c("name")),
            "url": off("url", c("url").rlike(r"(?i)^https?://\S+$")),
            "category": off("category", c("category").isin("company", "research", "media")),
            "priority": c("priority") < 0,
            "fetchIntervalHours": c("fetchIntervalHours") < 0.5,
            "parser": ~c("parser").isin("rss", "atom", "auto"),
            "reliability": ~c("reliability").between(0, 10),
            "weight": ~c("weight").between(1, 5),
            "color": ~c("color").rlike("^#[0-9a-fA-F]{3,8}$"),
        }
    )


def with_defaults(sources: DataFrame) -> DataFrame:
    return sources.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in DEFAULTS.items()})


def story_errors() -> Column:
    """Fields of a story row that break a rule; types are what the schema says."""
    c = F.col
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    no_url = lambda x: (F.coalesce(x, F.lit("")) != "") & ~x.rlike("(?i)^https?://")
    return failures(
        {
            "schemaVersion": ~c("schemaVersion").eqNullSafe(F.lit("1.0")),
            "id": ~F.coalesce(c("id").rlike("^s[0-9a-f]{8}$"), F.lit(False)),
            "fingerprint": F.coalesce(c("fingerprint"), F.lit("")) == "",
            "title": blank(c("title")),
            "url": (F.coalesce(c("originalUrl"), F.lit("")) == "") & (F.coalesce(c("canonicalUrl"), F.lit("")) == ""),
            "originalUrl": no_url(c("originalUrl")),
            "canonicalUrl": no_url(c("canonicalUrl")),
            "publisherUrl": no_url(c("publisherUrl")),
            "source.id": F.coalesce(c("source.id"), F.lit("")) == "",
            "source.name": F.coalesce(c("source.name"), F.lit("")) == "",
            "discoveredAt": c("discoveredAt").isNull(),
        }
    )


LIST_FIELDS = ("tags", "companies", "people", "models", "technologies", "countries", "relatedStoryIds", "sources")
TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def raw_story_errors(line: Column) -> Column:
    """Fields of a story as JSON text that break a rule, in order: what a schema would hide, as a number for a text, is told too.

    `*` alone: the text is no JSON object.
    """
    v = F.try_parse_json(line)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, f"$.{path}" if path else "$", "variant"))
    text = lambda path: F.when(kind(path) == "STRING", F.try_variant_get(v, f"$.{path}", "string"))
    there = lambda path: F.coalesce(kind(path) != "VOID", F.lit(False))
    starts = lambda path, start: F.coalesce(kind(path).startswith(start), F.lit(False))
    empty = lambda path: ~there(path) | (kind(path) == "STRING") & (text(path) == "")
    matches = lambda path, pattern: F.coalesce(text(path).rlike(pattern), F.lit(False))
    timed = lambda path: matches(path, TIME) & F.try_to_timestamp(F.regexp_replace(text(path), "Z$", "+00:00")).isNotNull()
    source = starts("source", "OBJECT")
    checks = {
        "schemaVersion": ~F.coalesce(text("schemaVersion") == "1.0", F.lit(False)),
        "id": ~matches("id", "^s[0-9a-f]{8}$"),
        "fingerprint": F.coalesce(text("fingerprint"), F.lit("")) == "",
        "title": F.trim(F.coalesce(text("title"), F.lit(""))) == "",
        "url": empty("originalUrl") & empty("canonicalUrl"),
        **{c: ~empty(c) & ~matches(c, "(?i)^https?://") for c in ("originalUrl", "canonicalUrl", "publisherUrl")},
        "source": ~source,
        "source.id": source & (F.coalesce(text("source.id"), F.lit("")) == ""),
        "source.name": source & (F.coalesce(text("source.name"), F.lit("")) == ""),
        "publishedAt": there("publishedAt") & ~timed("publishedAt") & (kind("publishedAt") != "BIGINT"),
        "discoveredAt": ~timed("discoveredAt"),
        **{c: there(c) & ~starts(c, "ARRAY") for c in LIST_FIELDS},
        **{c: there(c) & ~starts(c, "OBJECT") & ~starts(c, "ARRAY") for c in ("scores", "ai")},
    }
    return F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), failures(checks)).otherwise(F.array(F.lit("*")))
