"""Queries over raw items, sources and display values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions import html as H
from presswork.functions import scalars as N
from presswork.operators import dashboard, health
from presswork.sources import feeds

from .document_queries import DJB2, FP, HOST, KEY, NORM, PATH
from .event_queries import AS_OF, EV, STATUS_SQL, statuses
from .projections import event_stories, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return add


def raw_items(spark: SparkSession, d: str) -> DataFrame:
    """A raw item for each page; its source is that of its id."""
    k = F.col("page_id")
    return table(spark, d, "pages").select(
        F.concat(F.lit("  Page "), k.cast("string"), F.lit("\t of the   Day ")).alias("title"),
        F.col("url").alias("link"),
        F.when(k % 3 == 0, "Tue, 02 Jan 2024 10:00:00 GMT").when(k % 3 == 1, "2024-01-03T04:05:06Z").otherwise("soon").alias("pubDate"),
        F.when(k % 2 == 0, " ").otherwise("a  b").alias("description"),
        F.lit(None).cast("string").alias("image"),
        F.concat(F.lit("s"), (k % 4).cast("string")).alias("source_id"),
    )


def three_sources(spark: SparkSession) -> DataFrame:
    rows = [(f"s{i}", f"Source {i}", 5.0 + i, 3.0, "media") for i in range(3)]
    return spark.createDataFrame(rows, "id string, name string, reliability double, weight double, category string")


ITEM = f"""SELECT * FROM (SELECT page_id, url, 'Page ' || page_id || ' of the Day' AS title FROM pages WHERE page_id % 4 <> 3)"""


@query(
    f"""WITH i AS ({ITEM}), f AS (SELECT *, {FP} AS fp FROM i)
    SELECT {DJB2.format('fp')} AS id, fp AS fingerprint, title, CASE WHEN page_id % 2 = 1 THEN 'a b' END AS description, url AS originalUrl,
    's' || (page_id % 4) AS source_id, CASE page_id % 3 WHEN 0 THEN '2024-01-02T10:00:00.000Z' WHEN 1 THEN '2024-01-03T04:05:06.000Z' END AS published FROM f"""
)
def normalize_items(spark, d):
    got = feeds.normalize(raw_items(spark, d), three_sources(spark), F.lit(AS_OF).cast("timestamp"))
    return got.select(
        "id", "fingerprint", "title", "description", "originalUrl", F.col("source.id").alias("source_id"), N.iso_millis(F.col("publishedAt")).alias("published")
    )


@query(
    rf"""SELECT page_id, coalesce(regexp_matches({HOST}, '(^|\.)({"|".join(h.replace(".", "[.]") for h in H.SKIPPED_HOSTS)})$'), false)
    OR regexp_matches({PATH}, '(?i)\.({"|".join(H.SKIPPED_SUFFIXES)})$') AS skipped FROM
    (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://m.youtube.com/watch?v=1' WHEN 1 THEN url || '.pdf' ELSE url END AS url FROM pages)"""
)
def skipped_urls(spark, d):
    u = F.when(F.col("page_id") % 5 == 0, "https://m.youtube.com/watch?v=1").when(F.col("page_id") % 5 == 1, F.concat("url", F.lit(".pdf"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", H.skipped(u).alias("skipped"))


@query(
    f"""WITH k AS (SELECT page_id, {HOST} || regexp_replace(regexp_replace(lower({PATH}), '/{{2,}}', '/', 'g'), '/$', '') ||
        CASE WHEN regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) = '?' THEN '' ELSE regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) END AS key FROM pages)
    SELECT key, count(*)::bigint AS sharers, min(page_id) AS fetched_for FROM k GROUP BY key"""
)
def shared_fetches(spark, d):
    """Pages that one fetch serves."""
    keyed = table(spark, d, "pages").select("page_id", N.cache_key(F.col("url")).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("sharers"), F.min("page_id").alias("fetched_for"))


@query("SELECT page_id, url FROM pages WHERE 'blog' = split_part(split_part(url, '://', 2), '.', 1)")
def gated_pages(spark, d):
    """Pages of an allow-list of sources, by a semi join."""
    allowed = spark.createDataFrame([("blog",)], "source string")
    pages = table(spark, d, "pages").withColumn("source", F.regexp_extract("url", "://([^.]*)", 1))
    return pages.join(allowed, "source", "left_semi").select("page_id", "url")


@query(f"{EV} SELECT id, coalesce(category, 'news') AS category, id % 3 = 0 AS has_thumb FROM d")
def card_visual(spark, d):
    ev = event_stories(spark, d)
    return dashboard.card(ev.withColumn("image", F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "")))


@query(
    f"""SELECT event_id, CASE WHEN status = 'ok' THEN '[OK]' WHEN status = 'error' THEN '[ERROR]' ELSE '[WARN]' END || ' ' || source_id || ' — ' || items || ' items (' || event_id || ' ms)' AS line
    FROM ({STATUS_SQL})"""
)
def ingest_log_lines(spark, d):
    s = statuses(spark, d)
    return s.select("event_id", health.log_line(F.col("source_id"), F.col("status"), F.col("items"), F.col("event_id")).alias("line"))


@query(
    """SELECT count(*) FILTER (error IS NULL AND n > 0)::bigint AS ok, count(*) FILTER (error IS NULL AND n = 0)::bigint AS empty,
    count(*) FILTER (error IS NOT NULL)::bigint AS failed, sum(CASE WHEN error IS NULL THEN n ELSE 0 END)::bigint AS items
    FROM (SELECT CASE WHEN event_type = 'error' THEN 'http' END AS error, event_id % 4 AS n FROM events)"""
)
def ingest_summary(spark, d):
    e = table(spark, d, "events")
    items = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < F.col("event_id") % 4), lambda i: i)
    return feeds.ingest_summary(e.select(F.when(F.col("event_type") == "error", "http").alias("error"), items.alias("items")))


@query(
    f"""{EV} SELECT id, round(CASE WHEN id % 4 = 0 THEN greatest(0.2::double - (id % 12) * 0.02::double, 0)
      ELSE exp(-greatest((epoch(TIMESTAMP '{AS_OF}') - epoch(published)) / 3600::double, 0) / 30) END * 3, 9) AS score FROM d"""
)
def recency_scores(spark, d):
    ev = event_stories(spark, d)
    at = F.when(F.col("id") % 4 != 0, F.col("published"))
    return ev.select("id", F.round(N.recency_score(F.lit(3), at, F.col("id") % 12, F.lit(AS_OF).cast("timestamp")), 9).alias("score"))


@query(
    f"""{EV}, s AS (SELECT id, epoch(TIMESTAMP '{AS_OF}')::bigint - floor(epoch(published))::bigint AS s, published FROM d)
    SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago'
      WHEN s < 604800 THEN (s // 86400) || 'd ago' ELSE strftime(published, '%b %-d, %Y') END AS ago FROM s"""
)
def time_ago(spark, d):
    ev = event_stories(spark, d)
    return ev.select("id", N.time_ago(F.col("published").cast("timestamp"), F.lit(AS_OF).cast("timestamp")).alias("ago"))


@query(
    f"""SELECT doc_id AS id, {NORM.format("source")} AS norm, trim(regexp_replace(lower(source || ' / ' || lang), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents"""
)
def slugs(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), N.normalize_title(F.col("source")).alias("norm"), N.slug(F.concat("source", F.lit(" / "), "lang")).alias("slug"))


@query(
    """SELECT source_id, count(n)::bigint > 0 AS seen, coalesce(sum(n), 0)::bigint AS stories FROM
    (SELECT unnest(['src0', 'src1', 'idle']) AS source_id UNION SELECT 'src' || (user_id % 13) FROM events) a
    LEFT JOIN (SELECT 'src' || (user_id % 13) AS source_id, count(*) AS n FROM events GROUP BY 1) b USING (source_id) GROUP BY source_id"""
)
def source_list(spark, d):
    """Configured sources and those that stories name, each once."""
    configured = spark.createDataFrame([("src0",), ("src1",), ("idle",)], "source_id string")
    seen = event_stories(spark, d).groupBy("source_id").agg(F.count("*").alias("n"))
    both = configured.join(seen, "source_id", "full_outer")
    return both.select("source_id", F.col("n").isNotNull().alias("seen"), F.coalesce("n", F.lit(0)).alias("stories"))


@query(f"""WITH k AS (SELECT page_id, url, {KEY} AS key FROM pages) SELECT coalesce('url:' || nullif(url, ''), 'key:' || key) AS identity, count(*)::bigint AS n FROM k GROUP BY 1""")
def article_identities(spark, d):
    pages = table(spark, d, "pages").select("url", N.canonical_url_key(F.col("url")).alias("key"))
    return pages.groupBy(dashboard.identity(F.col("url"), F.col("key")).alias("identity")).agg(F.count("*").alias("n"))
