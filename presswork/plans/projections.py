"""Stories projected from the driver tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"view": "research", "click": "product", "purchase": "funding", "error": "policy", "signup": "news"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A story for each event: category by type, score by value, entities by user and payload."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("published"),
        F.try_element_at(kind, F.col("event_type")).alias("category"),
        F.when(F.col("event_id") % 17 != 0, F.least(F.lit(100), F.floor("value").cast("int"))).alias("score"),
        F.array(F.concat(F.lit("c"), (F.col("user_id") % 12).cast("string"))).alias("companies"),
        F.array(F.concat(F.lit("m"), (k % 7).cast("string"))).alias("models"),
        F.array(F.concat(F.lit("T "), (F.col("event_id") % 5).cast("string"))).alias("technologies"),
        F.concat(F.lit("src"), (F.col("user_id") % 13).cast("string")).alias("source_id"),
        F.concat(F.lit("Source "), (F.col("user_id") % 13).cast("string")).alias("source_name"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("user_id").cast("string")).alias("title"),
    )


EVENT_SQL = """
SELECT event_id AS id, ts AS published,
       CASE event_type WHEN 'view' THEN 'research' WHEN 'click' THEN 'product' WHEN 'purchase' THEN 'funding'
            WHEN 'error' THEN 'policy' WHEN 'signup' THEN 'news' END AS category,
       CASE WHEN event_id % 17 <> 0 THEN least(100, floor(value)::int) END AS score,
       ['c' || (user_id % 12)] AS companies, ['m' || ((props->>'$.k')::bigint % 7)] AS models,
       ['T ' || (event_id % 5)] AS technologies, 'src' || (user_id % 13) AS source_id, 'Source ' || (user_id % 13) AS source_name,
       event_type || ' ' || user_id AS title
FROM events
"""


def document_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A story for each document: the first sentence, cut at twelve words, is the title; the date is that of the event with its id."""
    docs = table(spark, sf_dir, "documents")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("published"))
    first = F.regexp_extract(F.coalesce("text", F.lit("")), r"^([^.!?\n]*)", 1)
    title = F.array_join(F.slice(F.filter(F.split(first, " "), lambda w: w != ""), 1, 12), " ")
    return docs.join(events, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        title.alias("title"),
        F.col("text").alias("description"),
        F.concat(F.lit("https://www."), F.col("source"), F.lit(".example.com/"), F.col("lang"), F.lit("/"), F.lower(F.substring(title, 1, 5))).alias("url"),
        F.col("source").alias("source_id"),
        (1 + F.col("doc_id") % 9).cast("int").alias("reliability"),
        (1 + F.col("doc_id") % 5).cast("int").alias("weight"),
        F.col("published"),
    )


DOCUMENT_SQL = r"""
SELECT doc_id AS id, title, text AS description,
       'https://www.' || source || '.example.com/' || lang || '/' || lower(substr(title, 1, 5)) AS url,
       source AS source_id, (1 + doc_id % 9)::int AS reliability, (1 + doc_id % 5)::int AS weight, e.ts AS published
FROM (SELECT *, array_to_string(list_filter(string_split(regexp_extract(coalesce(text, ''), '^([^.!?\n]*)', 1), ' '),
                lambda w: w <> '')[1:12], ' ') AS title FROM documents) d
LEFT JOIN events e ON e.event_id = d.doc_id
"""

# Sentences that bring words of every list into invented prose, dealt out by id.
PLANTED = (
    "OpenAI raises a series B and unveils GPT-5 in the United States",
    "New study on arXiv: a benchmark for reinforcement learning agents",
    "Google DeepMind releases Gemini 2 with multimodal tools in the UK",
    "Regulation and safety: the EU policy on open source models",
    "NVIDIA and Microsoft team up on an AI chip partnership in India",
    "Market growth in the industry, says a survey of companies",
)


def planted(text, id_):
    """A text with one of the planted sentences before it."""
    table_ = F.array(*map(F.lit, PLANTED))
    return F.concat(F.get(table_, (id_ % len(PLANTED)).cast("int")), F.lit(". "), F.coalesce(text, F.lit("")))


PLANTED_SQL = "[" + ", ".join("'" + p + "'" for p in PLANTED) + f"][1 + doc_id % {len(PLANTED)}] || '. ' || coalesce(text, '')"
