"""Queries over moments, orders, state and indexes: joins by time, numbered rows, the state of a stream, commits, postings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.operators import ranking, temporal
from presswork.operators.committed import CommittedArchive
from presswork.operators.postings import Postings
from presswork.shared import shared_folder

from .document_queries import DS, SPACES, STRIP
from .event_queries import ENTITY, EV, SLUG, event_stories
from .projections import document_stories, table
from .state_queries import VERSIONS, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/presswork-{uuid.uuid4().hex}"


@query(
    """SELECT s.sale_id, s.sold_at, c.change_id, c.segment FROM (SELECT *, row_number() OVER () AS k FROM sales) s
    LEFT JOIN client_changes c ON c.client_id = s.client_id AND c.valid_at <= s.sold_at
    QUALIFY row_number() OVER (PARTITION BY s.k ORDER BY c.valid_at DESC NULLS LAST, c.seq DESC, c.change_id DESC) = 1"""
)
def sale_segments(spark, d):
    """Each sale with what its client's last change before it says."""
    changes = table(spark, d, "client_changes").select("client_id", "valid_at", "seq", "change_id", "segment").distinct()
    found = temporal.asof_join(table(spark, d, "sales"), changes, ["client_id"], "sold_at", "valid_at", ["seq", "change_id"])
    return found.select("sale_id", "sold_at", F.col("match.change_id").alias("change_id"), F.col("match.segment").alias("segment"))


@query(
    """SELECT s.sale_id, s.sold_at, c.change_id FROM (SELECT *, row_number() OVER () AS k FROM sales) s
    LEFT JOIN client_changes c ON c.client_id = s.client_id AND c.valid_at <= s.sold_at AND c.valid_at >= s.sold_at - INTERVAL 72 HOUR
    QUALIFY row_number() OVER (PARTITION BY s.k ORDER BY c.valid_at DESC NULLS LAST, c.seq DESC, c.change_id DESC) = 1"""
)
def sale_recent_changes(spark, d):
    """The same, where the change is no older than 72 hours."""
    changes = table(spark, d, "client_changes").select("client_id", "valid_at", "seq", "change_id").distinct()
    found = temporal.asof_join(table(spark, d, "sales"), changes, ["client_id"], "sold_at", "valid_at", ["seq", "change_id"], within=72 * 3600)
    return found.select("sale_id", "sold_at", F.col("match.change_id").alias("change_id"))


@query(
    """SELECT s.sale_id, c.change_id, c.valid_at FROM sales s JOIN client_changes c
    ON c.client_id = s.client_id AND s.sold_at <= c.valid_at AND c.valid_at < s.arrived_at"""
)
def changes_before_arrival(spark, d):
    """Changes of a client between one of its sales and the sale's arrival."""
    sales = table(spark, d, "sales").select("client_id", "sale_id", "sold_at", "arrived_at")
    changes = table(spark, d, "client_changes").select("client_id", "change_id", "valid_at")
    met = temporal.interval_join(changes, sales, ["client_id"], "valid_at", "sold_at", "arrived_at")
    return met.select("span.sale_id", "point.change_id", "point.valid_at")


@query("SELECT click_id, ts, row_number() OVER (ORDER BY ts DESC NULLS LAST, click_id, client_id NULLS FIRST) AS rank FROM clicks")
def numbered_clicks(spark, d):
    """Every click with its number from the latest on."""
    clicks = table(spark, d, "clicks").select("click_id", "ts", "client_id")
    keys = [F.col("ts").desc_nulls_last(), F.col("click_id").asc_nulls_first(), F.col("client_id").asc_nulls_first()]
    return ranking.numbered(clicks, keys).select("click_id", "ts", "rank")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 10 OFFSET 490")
def deep_page(spark, d):
    """A page far from the start."""
    events = table(spark, d, "events").select("event_id", "ts")
    return ranking.page(events, [F.desc("ts"), F.col("event_id")], 50, 10)


@query(f"{VERSIONS} SELECT id, day::date AS day, updated, v FROM merged WHERE updated > (SELECT max(updated) FROM merged) - INTERVAL 14 DAY")
def stream_state(spark, d):
    """The latest version of each id, kept by a stream that evicts what is 14 days old."""
    from presswork.streaming import state, stories

    e = stories.read(spark, f"{d}/events.parquet")
    day, up = F.to_date("ts"), F.col("user_id")
    shift = F.when(up % 5 == 0, F.expr("interval -1 hour")).otherwise(F.expr("interval 1 hour"))
    old = F.struct(F.col("event_id").alias("id"), day.alias("day"), F.col("ts").alias("updated"), F.col("value").alias("v"))
    moved = F.when(up % 7 == 0, F.date_add(day, 1)).otherwise(day)
    new = F.struct(F.col("event_id").alias("id"), moved.alias("day"), (F.col("ts") + shift).alias("updated"), (F.col("value") + 1).alias("v"))
    both = F.array_compact(F.array(F.when(F.col("event_id") % 3 != 0, old), F.when(F.col("event_id") % 3 != 1, new)))
    place, name = folder(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, state.PROVIDER)
    try:
        changes = state.latest(e.select(F.inline(both)), retention="14 days")

        def each(batch: DataFrame, number: int) -> None:
            batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{place}/out/batch={number}")

        q = changes.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").foreachBatch(each).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(name, before)
    rows = spark.read.parquet(f"{place}/out")
    last = rows.groupBy("id").agg(F.max_by(F.struct("day", "updated", "v", "action"), F.struct("number", F.col("action") == "evicted")).alias("r"))
    return last.where("r.action <> 'evicted'").select("id", "r.day", F.col("r.updated").cast("timestamp_ntz").alias("updated"), "r.v")


@query(f"{VERSIONS} SELECT printf('s%08x', id) AS id, day::date AS day, updated, v FROM merged WHERE day >= DATE '2024-01-10'")
def archive_commits(spark, d):
    """What an archive holds after two commits of upserts and one of retention."""
    named = lambda df: df.withColumn("id", F.format_string("s%08x", "id"))
    box = CommittedArchive(spark, folder(spark), bucket_rows=20_000)
    for batch in map(named, versions(spark, d)):
        box.upsert(batch)
    box.prune("2024-01-20", 10)
    return box.read().select("id", "day", "updated", "v")


@query("SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'license')")
def search_postings(spark, d):
    """Documents whose text has two terms, through an index of trigrams."""
    docs = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    index = Postings(spark, folder(spark))
    index.build(docs, "doc_id", F.col("text"))
    return index.search(docs, "doc_id", F.col("text"), ["The", "license"]).select("doc_id", "n_chars")


@query(
    """SELECT doc_id::varchar AS id, n_chars FROM documents WHERE doc_id % 5 <> 2 AND doc_id % 7 <> 3"""
)
def ndjson_days(spark, d):
    """Documents written as lines of JSON, some of them broken or without an id, and read again."""
    k = F.col("doc_id")
    line = F.to_json(F.struct(F.when(k % 7 != 3, k.cast("string")).alias("id"), "n_chars", F.col("lang").alias("other")))
    line = F.when(k % 5 == 2, F.concat(F.lit("{broken "), line)).otherwise(line)
    place = folder(spark)
    table(spark, d, "documents").select(line.alias("value")).write.text(f"{place}/days")
    from presswork.sources.feeds import read_ndjson

    return read_ndjson(spark, f"{place}/days", "id string, n_chars long")


@query(
    """SELECT conv_id, turn, 'Turn ' || turn AS title, 'http://c.example/' || conv_id AS link FROM conversations WHERE turn % 3 <> 1"""
)
def json_feeds(spark, d):
    """Items of a JSON rendering of a feed for each turn: those without a title or a link drop out, and a body that is no JSON has none."""
    from presswork.sources.feeds import parse_json_feed

    t, c = F.col("turn"), F.col("conv_id")
    good = F.struct(F.concat(F.lit("Turn "), t.cast("string")).alias("title"), F.concat(F.lit("http://c.example/"), c.cast("string")).alias("link"))
    bad = F.struct(F.lit("").alias("title"), F.lit("http://x").alias("link"))
    rows = table(spark, d, "conversations").select(c, t, F.to_json(F.struct(F.array(bad, good).alias("items"))).alias("body"))
    rows = rows.withColumn("body", F.when(t % 3 == 1, F.lit("no json")).otherwise(F.col("body")))
    return rows.select("conv_id", "turn", F.inline(parse_json_feed(F.col("body")))).select("conv_id", "turn", "title", "link")


@query(
    """SELECT s_suppkey AS key, coalesce(s_suppkey % 4 - 1, 100)::double AS priority, 3.0::double AS fetchIntervalHours, CASE WHEN s_suppkey % 2 = 0 THEN 'rss' ELSE 'auto' END AS parser,
    true AS enabled, false AS articleFetch, row_number() OVER (ORDER BY s_suppkey % 4, CASE WHEN s_suppkey % 7 = 0 THEN ' ' ELSE s_name END, s_suppkey) AS place FROM supplier"""
)
def sources_in_order(spark, d):
    """Sources with their defaults, by priority and name."""
    from presswork.sources.schemas import with_defaults

    from .state_queries import candidate_sources

    rows = candidate_sources(spark, d).withColumns({"enabled": F.lit(None).cast("boolean"), "articleFetch": F.lit(None).cast("boolean")})
    full = with_defaults(rows).select("key", "name", "priority", "fetchIntervalHours", "parser", "enabled", "articleFetch")
    return ranking.numbered(full, [F.col("priority"), F.col("name"), F.col("key")], "place").drop("name")


@query(f"{VERSIONS} SELECT printf('s%08x', id) AS id, day::date AS day, updated, v FROM stored WHERE NOT (id % 5 = 1 AND day < DATE '2024-01-10') AND id % 11 <> 4")
def archive_removals(spark, d):
    """What stays of an archive when ids are removed by their day, where that is right, and others by id alone."""
    rows = versions(spark, d)[0]
    named = rows.withColumn("id", F.format_string("s%08x", "id"))
    box = CommittedArchive(spark, folder(spark), bucket_rows=20_000)
    box.upsert(named)
    by_day = rows.where("id % 5 = 1").select(
        F.format_string("s%08x", "id").alias("id"), F.when(F.col("day") < F.lit("2024-01-10").cast("date"), F.col("day")).otherwise(F.date_add("day", 1)).alias("day")
    )
    box.remove(by_day)
    box.remove(rows.where("id % 11 = 4").select(F.format_string("s%08x", "id").alias("id")))
    return box.read().select("id", "day", "updated", "v")


@query(
    """SELECT doc_id, list_filter([CASE WHEN k % 9 = 1 THEN 'schemaVersion' END, CASE WHEN k % 5 = 0 THEN 'id' END, CASE WHEN k % 7 = 2 THEN 'url' END, CASE WHEN k % 8 = 3 THEN 'source' END,
    CASE WHEN k % 6 = 4 THEN 'publishedAt' END, CASE WHEN k % 4 = 1 THEN 'discoveredAt' END, CASE WHEN k % 10 = 7 THEN 'tags' END], lambda x: x IS NOT NULL) AS errors
    FROM (SELECT *, doc_id AS k FROM documents) WHERE k % 13 <> 5 UNION ALL SELECT doc_id, ['*'] FROM documents WHERE doc_id % 13 = 5"""
)
def raw_story_checks(spark, d):
    """Fields that break a rule in stories as JSON text, made from documents."""
    from presswork.sources.schemas import raw_story_errors

    k = F.col("doc_id")
    said = lambda test, bad, good: F.when(test, F.lit(bad)).otherwise(F.lit(good))
    fields = [
        said(k % 9 == 1, '"schemaVersion":1', '"schemaVersion":"1.0"'),
        F.concat(F.lit('"id":"'), said(k % 5 == 0, "S", "s"), F.format_string("%08x", k), F.lit('"')),
        F.lit('"fingerprint":"f","title":"t"'),
        said(k % 7 == 2, '"originalUrl":""', '"originalUrl":"https://x.example/a"'),
        said(k % 8 == 3, '"source":"x"', '"source":{"id":"a","name":"A"}'),
        said(k % 6 == 4, '"publishedAt":"soon"', '"publishedAt":"2026-01-10T10:00:00Z"'),
        said(k % 4 == 1, '"discoveredAt":null', '"discoveredAt":"2026-01-10T10:00:00.000Z"'),
        said(k % 10 == 7, '"tags":"x"', '"tags":["x"]'),
    ]
    line = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    line = F.when(k % 13 == 5, F.concat(F.lit("["), line, F.lit("]"))).otherwise(line)
    return table(spark, d, "documents").select("doc_id", raw_story_errors(line).alias("errors"))


# characters that XML can't have are taken out on both sides; a feed's texts are trimmed as Python trims them
PLAIN = r"[\x00-\x1f]"


@query(
    rf"""WITH d AS (SELECT doc_id, source, lang, regexp_replace(coalesce(text, ''), '[\x00-\x1f]', ' ', 'g') AS html FROM documents)
    SELECT doc_id, 'Document ' || doc_id AS title, 'https://' || source || '.example/' || doc_id AS link, trim(regexp_replace({STRIP}, '{SPACES}', ' ', 'g')) AS description,
    CASE WHEN doc_id % 3 = 0 THEN 'https://img.example/' || doc_id END AS image FROM d"""
)
def feeds_of_documents(spark, d):
    """A feed around the whole text of each document: RSS, Atom or RSS 1.0 with namespaces, an image where it tells one that is no logo."""
    from presswork.sources.feeds import parse_feeds

    k, docs = F.col("doc_id"), table(spark, d, "documents")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), PLAIN, " ")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    n = k.cast("string")
    link = F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), n)
    image = F.when(k % 3 == 0, F.concat(F.lit('<media:content url="https://img.example/'), n, F.lit('"/>'))).when(k % 3 == 1, '<media:thumbnail url="https://x/logo.png"/>').otherwise("")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    title = F.concat(F.lit("Document "), n)
    rss = F.concat(F.lit('<rss xmlns:media="http://search.yahoo.com/mrss/"><channel><title>c</title><item>'), tag("title", title), tag("link", link), tag("description", text), image, F.lit("</item></channel></rss>"))
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:media="http://search.yahoo.com/mrss/"><title>c</title><entry>'), tag("title", title),
        F.lit('<link href="'), link, F.lit('"/>'), tag("summary", text), image, F.lit("</entry></feed>"),
    )
    rdf = F.concat(
        F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" '
              'xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>c</title></channel><item>'),
        tag("dc:title", title), tag("link", link), F.lit("<description>short</description>"), tag("content:encoded", F.when(F.trim(text) == "", " ").otherwise(text)), image, F.lit("</item></rdf:RDF>"),
    )
    xml = F.when(k % 4 == 1, atom).when((k % 4 == 2) & (F.trim(text) != ""), rdf).otherwise(rss)
    items = docs.select("doc_id", F.inline(parse_feeds(xml)["items"]))
    return items.select("doc_id", "title", "link", "description", "image")


@query(
    rf"""{DS}, t AS (SELECT id, description, trim(regexp_replace(title, '[^\x00-\x7F]', '_', 'g')) AS t,
        CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN regexp_replace(title, '[^\x00-\x7F]', '_', 'g') ELSE 'A summary of its own ' || id END AS own FROM ds),
    c AS (SELECT id, t, coalesce(nullif(own, ''), regexp_replace(substr(description, 1, 90), '[^\x00-\x7F]', '_', 'g')) AS chosen, trim(coalesce(coalesce(nullif(own, ''), regexp_replace(substr(description, 1, 90), '[^\x00-\x7F]', '_', 'g')), '')) AS s FROM t)
    SELECT id, CASE WHEN NOT (CASE WHEN s = '' THEN true WHEN t = '' THEN false ELSE lower(s) = lower(t) OR 1 - levenshtein(lower(s), lower(t))::double / greatest(length(s), length(t)) > 0.85 END)
        THEN chosen END AS shown FROM c"""
)
def shown_summaries(spark, d):
    """What a card shows of a story: its summary, else its description, and nothing that only repeats the title."""
    from presswork.functions import scalars as N

    ascii_ = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "_")
    own = F.when(F.col("id") % 3 == 1, ascii_(F.col("title"))).when(F.col("id") % 3 == 2, F.concat(F.lit("A summary of its own "), F.col("id").cast("string")))
    return document_stories(spark, d).select("id", N.shown_summary(own, ascii_(F.substring("description", 1, 90)), ascii_(F.col("title"))).alias("shown"))


@query(
    f"""{EV}, n AS (SELECT name, {SLUG} AS slug, count(*)::bigint AS n FROM ({ENTITY}) WHERE "group" = 'company' GROUP BY 1, 2)
    SELECT name, slug, n, row_number() OVER (ORDER BY n DESC, name) AS rank FROM n QUALIFY rank <= 5"""
)
def first_companies(spark, d):
    """The five companies with most mentions."""
    from presswork.operators import entities

    return entities.ranked_names(event_stories(spark, d), "company", 5)
