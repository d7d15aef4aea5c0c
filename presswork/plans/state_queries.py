"""Queries over the archive, checks of rows, feeds, and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions import lexicons as lex
from presswork.operators import archive
from presswork.sources import feeds, schemas

from .document_queries import DJB2, FP
from .projections import document_stories, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What is stored (two of three events), and a batch (two of three): some in both, newer, older or moved to another day."""
    e = table(spark, d, "events")
    day = F.to_date("ts")
    base = e.select(F.col("event_id").alias("id"), day.alias("day"), F.col("ts").alias("updated"), F.col("value").alias("v"), "user_id")
    stored = base.where("id % 3 <> 0").drop("user_id")
    shift = F.when(F.col("user_id") % 5 == 0, F.expr("interval -1 hour")).otherwise(F.expr("interval 1 hour"))
    moved = F.when(F.col("user_id") % 7 == 0, F.date_add("day", 1)).otherwise(F.col("day"))
    batch = base.where("id % 3 <> 1").select("id", moved.alias("day"), (F.col("updated") + shift).alias("updated"), (F.col("v") + 1).alias("v"))
    return stored, batch


VERSIONS = """WITH e AS (SELECT event_id AS id, ts::date AS day, ts AS updated, value AS v, user_id FROM events),
  stored AS (SELECT id, day, updated, v FROM e WHERE id % 3 <> 0),
  batch AS (SELECT id, CASE WHEN user_id % 7 = 0 THEN day + 1 ELSE day END AS day,
                   CASE WHEN user_id % 5 = 0 THEN updated - INTERVAL 1 HOUR ELSE updated + INTERVAL 1 HOUR END AS updated, v + 1 AS v FROM e WHERE id % 3 <> 1),
  merged AS (SELECT coalesce(s.id, b.id) AS id, CASE WHEN newer THEN b.day ELSE s.day END AS day,
                    CASE WHEN newer THEN b.updated ELSE s.updated END AS updated, CASE WHEN newer THEN b.v ELSE s.v END AS v,
                    CASE WHEN s.id IS NULL THEN 'inserted' WHEN b.id IS NULL THEN 'kept' WHEN newer THEN 'updated' ELSE 'unchanged' END AS action
             FROM (SELECT s.id AS sid, b.id AS bid, s.id IS NULL OR b.updated > s.updated AS newer FROM stored s FULL JOIN batch b ON s.id = b.id) x
             LEFT JOIN stored s ON s.id = x.sid LEFT JOIN batch b ON b.id = x.bid)"""


@query(f"{VERSIONS} SELECT id, day::date AS day, updated, v, action FROM merged")
def upsert_merge(spark, d):
    return archive.merge(*versions(spark, d)).select("id", "day", "updated", "v", "action")


@query(f"{VERSIONS} SELECT action, count(*)::bigint AS n FROM merged GROUP BY 1")
def upsert_stats(spark, d):
    return archive.merge(*versions(spark, d)).groupBy("action").agg(F.count("*").alias("n"))


@query(f"{VERSIONS} SELECT b.id, s.day AS from_day, b.day::date AS to_day FROM stored s JOIN batch b ON s.id = b.id AND s.day <> b.day")
def rebucket_moves(spark, d):
    return archive.moves(*versions(spark, d)).select("id", "from_day", "to_day")


@query(f"{VERSIONS} SELECT id, day FROM stored WHERE day >= DATE '2024-04-10' - 90")
def prune_90d(spark, d):
    return archive.prune(versions(spark, d)[0], F.lit("2024-04-10").cast("timestamp")).select("id", "day")


@query(f"{VERSIONS} SELECT id, day FROM stored WHERE id NOT IN (SELECT id FROM batch)")
def remove_by_id(spark, d):
    return archive.remove(*versions(spark, d)).select("id", "day")


@query(f"{VERSIONS}, u AS (SELECT id, day FROM stored UNION ALL SELECT id, day FROM batch) SELECT id, count(DISTINCT day)::bigint AS days, count(*)::bigint AS n FROM u GROUP BY id HAVING days > 1")
def dup_id_audit(spark, d):
    a, b = versions(spark, d)
    return archive.duplicate_ids(a.select("id", "day").unionByName(b.select("id", "day")))


def suffixed(spark: SparkSession, d: str) -> DataFrame:
    """Document stories, every other one with a publisher behind its title; ids are those of the title as it stands."""
    from presswork.functions.scalars import story_id

    ds = document_stories(spark, d)
    title = F.concat("title", F.when(F.col("id") % 2 == 0, " - Reuters").otherwise(""))
    at = F.coalesce("published", F.lit("2024-01-01").cast("timestamp"))
    return ds.select(
        story_id(title, F.col("url")).alias("id"), title.alias("title"), "url", "description", "source_id", at.alias("updated"), F.to_date(at).alias("day"),
        F.col("id").alias("doc_id"),
    )


from .document_queries import clean_sql  # noqa: E402
from .projections import DOCUMENT_SQL  # noqa: E402

# ids of titles as they stand, and of clean ones; a title that is nothing but a publisher stays
SUFFIXED = f"""WITH ds AS ({DOCUMENT_SQL}), x AS (SELECT id AS doc_id, id, title || CASE WHEN id % 2 = 0 THEN ' - Reuters' ELSE '' END AS full_title, url, description,
    source_id, coalesce(published, TIMESTAMP '2024-01-01') AS updated FROM ds), {clean_sql('x', 'full_title')},
  f AS (SELECT doc_id, full_title, url, description, source_id, updated, {FP.replace('title', 'full_title')} AS fp_full FROM x),
  k AS (SELECT c3.id AS doc_id, t AS title, x.url FROM c3 JOIN x USING (id)),
  g AS (SELECT doc_id, {FP} AS fp_clean FROM k),
  i AS (SELECT f.*, {DJB2.format('fp_clean')} AS clean_id, {DJB2.format('fp_full')} AS id FROM f JOIN g USING (doc_id))"""


@query(f"{SUFFIXED} SELECT doc_id, id, clean_id FROM i WHERE id <> clean_id")
def identity_audit(spark, d):
    return archive.inconsistent_ids(suffixed(spark, d), lex.publisher_aliases()).select("doc_id", "id", "clean_id")


@query(
    f"""{SUFFIXED}, r AS (SELECT *, row_number() OVER (PARTITION BY clean_id ORDER BY updated DESC, length(description) DESC NULLS LAST, id) AS n FROM i)
    SELECT clean_id, list_sort(list_distinct(list(source_id))) AS sources, count(*)::bigint AS merged, count(*) FILTER (id <> clean_id)::bigint AS rekeyed FROM r GROUP BY 1"""
)
def rekey_merge(spark, d):
    return archive.rekey(suffixed(spark, d), lex.publisher_aliases()).select("clean_id", "sources", "merged", "rekeyed")


@query(f"{VERSIONS} SELECT day, count(*)::bigint AS n, min(id) AS first_id, max(id) AS last_id FROM stored GROUP BY 1")
def day_index(spark, d):
    return archive.day_index(versions(spark, d)[0])


@query(f"{VERSIONS} SELECT count(DISTINCT day)::bigint AS days, count(*)::bigint AS stories FROM stored")
def archive_metrics(spark, d):
    return archive.metrics(versions(spark, d)[0])


def candidate_sources(spark: SparkSession, d: str) -> DataFrame:
    """A source row for each supplier, some fields broken by key."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("key"),
        F.when(k % 5 == 0, F.concat(F.lit("Bad "), k.cast("string"))).otherwise(F.concat(F.lit("src-"), k.cast("string"))).alias("id"),
        F.when(k % 7 == 0, " ").otherwise(F.col("s_name")).alias("name"),
        F.when(k % 3 == 0, "ftp://x").otherwise("https://x.example/feed").alias("url"),
        F.when(k % 11 == 0, "blog").otherwise("media").alias("category"),
        (k % 4 - 1).cast("double").alias("priority"),
        F.lit(None).cast("double").alias("fetchIntervalHours"),
        F.when(k % 2 == 0, "rss").alias("parser"),
        (k % 13).cast("double").alias("reliability"),
        (k % 6).cast("double").alias("weight"),
        F.when(k % 9 == 0, "red").otherwise("#a0b0c0").alias("color"),
    )


@query(
    """SELECT s_suppkey AS key, list_filter([CASE WHEN k % 5 = 0 THEN 'id' END, CASE WHEN k % 7 = 0 THEN 'name' END, CASE WHEN k % 3 = 0 THEN 'url' END,
    CASE WHEN k % 11 = 0 THEN 'category' END, CASE WHEN k % 4 = 0 THEN 'priority' END, CASE WHEN k % 13 > 10 THEN 'reliability' END,
    CASE WHEN k % 6 < 1 THEN 'weight' END, CASE WHEN k % 9 = 0 THEN 'color' END], lambda x: x IS NOT NULL) AS errors
    FROM (SELECT *, s_suppkey AS k FROM supplier)"""
)
def validate_sources(spark, d):
    return candidate_sources(spark, d).select("key", schemas.source_errors().alias("errors"))


@query(
    """SELECT doc_id, list_filter([CASE WHEN doc_id % 2 = 0 THEN 'schemaVersion' END, CASE WHEN doc_id % 3 = 0 THEN 'id' END, CASE WHEN doc_id % 5 = 0 THEN 'url' END,
    CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 = 0 THEN 'canonicalUrl' END, CASE WHEN source = 'src0' THEN 'source.name' END], lambda x: x IS NOT NULL) AS errors FROM documents"""
)
def validate_stories(spark, d):
    k = F.col("doc_id")
    null = F.lit(None).cast("string")
    url = F.when(k % 5 == 0, null).when(k % 7 == 0, "ftp://x").otherwise("https://x/y")
    rows = table(spark, d, "documents").select(
        "doc_id",
        F.when(k % 2 == 0, "0.9").otherwise("1.0").alias("schemaVersion"),
        F.when(k % 3 == 0, "x").otherwise("s0123abcd").alias("id"),
        F.lit("f").alias("fingerprint"),
        F.lit("t").alias("title"),
        F.lit("").alias("originalUrl"),
        url.alias("canonicalUrl"),
        null.alias("publisherUrl"),
        F.struct(F.col("source").alias("id"), F.when(F.col("source") != "src0", "n").alias("name")).alias("source"),
        F.current_timestamp().alias("discoveredAt"),
    )
    return rows.select("doc_id", schemas.story_errors().alias("errors"))


@query(
    """SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'parse' END AS error, CASE WHEN page_id % 4 = 3 THEN 0 WHEN page_id % 4 = 2 THEN 0 ELSE 1 END::int AS n,
    CASE WHEN page_id % 4 < 2 THEN url END AS link FROM pages"""
)
def parse_feeds(spark, d):
    """A feed around each page: RSS, Atom, an empty one, and one that is none."""
    k, u = F.col("page_id") % 4, F.replace("url", F.lit("&"), F.lit("&amp;"))
    rss = F.concat(F.lit("<rss><channel><title>c</title><item><title>t</title><link>"), u, F.lit("</link><description>d</description></item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>c</title><entry><title>t</title><link href="'), u, F.lit('"/></entry></feed>'))
    xml = F.when(k == 0, rss).when(k == 1, atom).when(k == 2, "<rss><channel><title>c</title></channel></rss>").otherwise("<html><body/></html>")
    got = table(spark, d, "pages").select("page_id", feeds.parse_feeds(xml).alias("p"))
    return got.select("page_id", "p.error", F.size("p.items").alias("n"), F.get("p.items", F.lit(0))["link"].alias("link"))


def _through_stream(spark: SparkSession, d: str, make) -> DataFrame:
    """Run a stream over the events to its end, into a table in the shared warehouse, and read it.

    What earlier calls of this session left is deleted, and so is the state of the stream.
    """
    import uuid

    from presswork.streaming import stories

    home = f"{spark.conf.get('spark.sql.warehouse.dir')}/presswork_streams_{spark.sparkContext.applicationId}"
    place = f"{home}/{uuid.uuid4().hex}"
    stream = make(stories, stories.read(spark, f"{d}/events.parquet"))
    remove = lambda path: _files(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    remove(home)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    q = (
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").foreachBatch(each).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    remove(f"{place}/state")
    return spark.read.parquet(f"{place}/out").drop("batch")


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


@query("SELECT ts::date AS day, event_type, count(*)::bigint AS n FROM events GROUP BY 1, 2")
def stream_daily_window(spark, d):
    return _through_stream(spark, d, lambda s, e: s.daily_counts(e, "ts", "event_type"))


@query("SELECT event_id FROM events")
def stream_dedupe(spark, d):
    return _through_stream(spark, d, lambda s, e: s.dedupe(e.select("event_id", "ts"), "ts", "event_id").select("event_id"))


@query(
    "SELECT until::date AS until, event_type, count(*)::bigint AS n FROM (SELECT event_type, unnest(generate_series(date_trunc('day', ts) + INTERVAL 1 DAY, "
    "date_trunc('day', ts) + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS until FROM events) GROUP BY 1, 2"
)
def stream_sliding_window(spark, d):
    return _through_stream(spark, d, lambda s, e: s.sliding_counts(e, "ts", "event_type"))
