"""A build from feeds to the archive and the snapshot, feeds as a data source, settings, and checks of raw rows."""

import json
import threading
from datetime import date, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from presswork.config import Settings, env_lines
from presswork.operators import build as whole
from presswork.operators import dashboard, extract, snapshot, summaries
from presswork.operators.committed import CommittedArchive
from presswork.operators.runs import RunLog
from presswork.sources import feed_source, feeds, schemas

BODY = "The lab released a new open model today. It is faster than the last one by a wide margin. Researchers can use the weights under a free license. " * 4


def item(title, link, date_="Sat, 10 Jan 2026 10:00:00 GMT", text="About " + BODY):
    return f"<item><title>{title}</title><link>{link}</link><pubDate>{date_}</pubDate><description>{text}</description></item>"


def feed(*items):
    return f"<rss><channel><title>c</title>{''.join(items)}</channel></rss>"


BODIES = {
    "a": feed(item("OpenAI ships a new reasoning model for coders - Reuters", "https://a.example/one?utm_source=x"), item("Quiet day for startup funding", "https://a.example/two"), item("A key leaked today", "https://a.example/key", text="It was ghp_" + "a" * 36 + " " + BODY)),
    "b": feed(item("OpenAI ships a new reasoning model for coders", "https://b.example/copy", "Sat, 10 Jan 2026 12:00:00 GMT"), item("Old news of last autumn", "https://b.example/old", "Thu, 10 Jul 2025 12:00:00 GMT")),
    "c": "<html>", "d": feed(), "e": feed(item("No address at all", "")),
}
SOURCES = [(k, f"Source {k}", f"https://{k}.example/rss", "media", True, k == "a", 5.0, 3.0 + (k == "a")) for k in BODIES]
SOURCE_SCHEMA = "id string, name string, url string, category string, enabled boolean, articleFetch boolean, reliability double, weight double"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("build")
    sources = spark.createDataFrame(SOURCES, SOURCE_SCHEMA)
    for c, kind in (("priority", "double"), ("fetchIntervalHours", "double"), ("parser", "string"), ("color", "string")):
        sources = sources.withColumn(c, F.lit(None).cast(kind))
    fetched = spark.createDataFrame([(k, b, None, 5) for k, b in BODIES.items()], "source_id string, body string, error string, millis long")
    archive, log = CommittedArchive(spark, f"{place}/archive"), RunLog(spark, f"{place}/runs")
    pages = lambda df: df.withColumns({"body": F.lit(f"<article><p>{BODY}</p></article>"), "status": F.lit(200), "error": F.lit(None).cast("string"), "content_type": F.lit("text/html"), "requests": F.lit(1)})

    def run(hour):
        return whole.build(
            sources, archive, F.lit(f"2026-01-11 {hour:02d}:00:00").cast("timestamp"), log, f"{place}/snapshot", Settings(article_fetch=True), fetched, pages,
        )

    return run, archive, log, place


def test_a_build_from_end_to_end(spark, built):
    run, archive, log, place = built
    one = run(8)
    stories = {r.title: r for r in one.stories.collect()}
    assert set(stories) == {"OpenAI ships a new reasoning model for coders", "Quiet day for startup funding", "A key leaked today", "Old news of last autumn"}
    both = stories["OpenAI ships a new reasoning model for coders"]
    assert {s.id for s in both.sources} == {"a", "b"} and both.reportedBy == 2 and both.source_id == "a" and "OpenAI" in both.companies
    assert both.canonicalUrl == "https://a.example/one" and both.content.startswith("The lab released") and both.ai.method == "extractive" and 0 <= both.signal <= 100
    assert "It was [redacted-credential] The lab" in stories["A key leaked today"].description
    assert stories["Quiet day for startup funding"].subcategory is not None and both.scores.impact is not None
    assert [r.wrong for r in one.rejected.collect()] == [["url"]]
    assert {r.source_id: r.status for r in one.records.collect()} == {"a": "ok", "b": "ok", "c": "error", "d": "empty", "e": "ok"}
    assert one.counts["normalized"] == 5 and one.counts["rejected"] == 1 and one.counts["upserted"] == 3  # one is too old to be stored
    assert archive.read().count() == 3 and archive.versions() == [1]
    assert log.list().count() == 1 and spark.read.json(f"{place}/snapshot/items").count() == 4
    again = run(9)
    assert again.counts["upserted"] == again.counts["updated"] + 0 == 3 and archive.read().count() == 3 and log.list().count() == 2
    assert {r.id for r in again.stories.collect()} == {r.id for r in stories.values()}
    assert whole.top_signals(again.stories, 2).count() == 2


def test_a_build_over_a_broken_archive_stops_before_its_log(spark, built, monkeypatch):
    run, archive, log, place = built
    before = log.list().count()
    monkeypatch.setattr(whole, "mismatched", lambda rows: rows.limit(1))
    with pytest.raises(ValueError, match="titles"):
        run(10)
    assert log.list().count() == before


@pytest.fixture(scope="module")
def server():
    asked = {}
    late = "<rss><channel><title>c</title><item><link>http://x/1</link></item></channel></rss>"

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            n = asked[self.path] = asked.get(self.path, 0) + 1
            body = late if self.path == "/late" and n % 2 else late if self.path == "/never" else BODIES.get(self.path[1:], BODIES["a"])
            self.send_response(404 if self.path == "/gone" else 200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", asked
    made.shutdown()


def plain(records):
    return sorted((r.source_id, r.ok, r.status, r.errorType, r.itemCount, [tuple(i) for i in r["items"]]) for r in records.collect())


def test_feeds_as_a_source_give_what_ingest_gives(spark, server, tmp_path):
    base, asked = server
    sources = [{"id": n, "name": n, "url": f"{base}/{n}"} for n in ("a", "b", "c", "d", "gone")] + [{"id": "off", "name": "off", "url": f"{base}/off", "enabled": False}]
    feed_source.register(spark)
    rows = spark.read.format("feeds").option("sources", json.dumps(sources)).load()
    want = feeds.ingest(spark.createDataFrame([(s["id"], s["name"], s["url"]) for s in sources[:5]], "id string, name string, url string"))
    assert plain(feed_source.records(rows)) == plain(want) and "/off" not in asked
    (tmp_path / "sources.json").write_text(json.dumps(sources[:1]))
    assert spark.read.format("feeds").load(f"file://{tmp_path}/sources.json").count() == 3
    assert spark.read.format("feeds").option("sources", "[]").load().count() == 0


def test_untitled_feeds_are_asked_again_or_kept(spark, server):
    base, asked = server
    feed_source.register(spark)
    one = lambda name: spark.read.format("feeds").option("sources", json.dumps([{"id": name, "name": name, "url": f"{base}/{name}"}]))
    assert {r.title for r in one("late").option("untitled", "true").load().collect()} >= {"Quiet day for startup funding"} and asked["/late"] == 2
    kept = one("never").option("untitled", "true").load().collect()
    assert [(r.title, r.link) for r in kept] == [("", "http://x/1")] and asked["/never"] == 2
    assert [(r.title, r.error) for r in one("never").load().collect()] == [(None, None)]


def test_feeds_as_a_stream(spark, server, tmp_path):
    base, _ = server
    feed_source.register(spark)
    told = json.dumps([{"id": "a", "name": "a", "url": f"{base}/a"}, {"id": "b", "name": "b", "url": f"{base}/b"}])
    for k in (1, 2):  # each start polls once, on one checkpoint
        stream = spark.readStream.format("feeds").option("sources", told).load()
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 5 * k
    assert spark.read.parquet(f"{tmp_path}/out").select("source_id", "title").distinct().count() == 5


def test_settings(spark):
    lines = ["# no", "", "PRESSWORK_TIMEOUT=2.5", ' PRESSWORK_SUMMARY_MODE = "llm" ', "=x", "PRESSWORK_RETENTION_DAYS=many", "PRESSWORK_ARTICLE_FETCH=1", "novalue"]
    env = env_lines(lines)
    assert env["PRESSWORK_SUMMARY_MODE"] == "llm" and "novalue" not in env and "" not in env
    assert Settings.of(env=env) == Settings(timeout=2.5, summary_mode="llm", article_fetch=True)
    spark.conf.set("spark.presswork.timeout", "7")
    try:
        assert Settings.of(spark, env).timeout == 7.0 and Settings.of(spark, env, timeout=9).timeout == 9.0
    finally:
        spark.conf.unset("spark.presswork.timeout")
    assert Settings.of(env={"PRESSWORK_TIMEOUT": "nan", "PRESSWORK_ARTICLE_FETCH": "maybe"}) == Settings()


def test_all_chips(spark):
    df = spark.createDataFrame([([" A ", "b", None], ["b", ""], None)], "companies array<string>, people array<string>, tags array<string>")
    assert df.select(dashboard.all_chips(["companies", "people", "tags"]).alias("c")).first().c == ["A", "b"]


def test_source_list(spark):
    configured = spark.createDataFrame([("a", "Name a", "#1"), ("idle", "Idle", None)], "id string, name string, color string")
    stories = spark.createDataFrame([(2, "x", "X two", "#9"), (1, "x", "X one", "#8"), (3, "a", "other", "#7"), (4, None, "none", None)], "id int, source_id string, source_name string, source_color string")
    got = {r.source_id: tuple(r)[1:] for r in dashboard.source_list(configured, stories).collect()}
    assert got == {"a": ("Name a", "#1", True, 1), "idle": ("Idle", None, False, 0), "x": ("X one", "#8", True, 2)}


def test_summariser_in_batches_and_in_a_pool(spark):
    df = spark.createDataFrame([(f"p{k % 5}" if k % 7 else None,) for k in range(40)], "p string").coalesce(1)

    class Batched:
        def batch(self, prompts):
            assert len(prompts) == len(set(prompts))
            return [{"summary": p} if p != "p3" else None for p in prompts]

    class Broken:
        def batch(self, prompts):
            raise RuntimeError("no batches")

        def __call__(self, prompt):
            if prompt == "p1":
                raise RuntimeError("no")
            return prompt

    got = summaries.asked(df, "p", "a", Batched()).collect()
    assert all(r.a == (None if r.p in (None, "p3") else json.dumps({"summary": r.p})) for r in got) and len(got) == 40
    assert all(r.a == (None if r.p in (None, "p1") else r.p) for r in summaries.asked(df, "p", "a", Broken(), pool=3).collect())


def test_raw_stories(spark):
    good = {
        "schemaVersion": "1.0", "id": "s0123abcd", "fingerprint": "f", "title": "T", "originalUrl": "https://x/1", "canonicalUrl": "", "publisherUrl": None, "source": {"id": "a", "name": "A"},
        "publishedAt": None, "discoveredAt": "2026-01-10T10:00:00.000Z", "tags": [], "scores": {"impact": 1}, "ai": None,
    }
    cases = [
        ({}, []), ({"schemaVersion": "2"}, ["schemaVersion"]), ({"id": "S0123abcd"}, ["id"]), ({"id": 5}, ["id"]), ({"title": "  "}, ["title"]), ({"fingerprint": None}, ["fingerprint"]),
        ({"originalUrl": ""}, ["url"]), ({"originalUrl": "ftp://x"}, ["originalUrl"]), ({"canonicalUrl": "x", "publisherUrl": "mailto:a"}, ["canonicalUrl", "publisherUrl"]),
        ({"source": None}, ["source"]), ({"source": "a"}, ["source"]), ({"source": {"id": ""}}, ["source.id", "source.name"]), ({"publishedAt": "soon"}, ["publishedAt"]),
        ({"publishedAt": "2026-13-01"}, ["publishedAt"]), ({"publishedAt": "2026-01-01"}, []), ({"discoveredAt": None}, ["discoveredAt"]), ({"discoveredAt": 5}, ["discoveredAt"]),
        ({"tags": "x", "countries": {}}, ["tags", "countries"]), ({"tags": None, "sources": [1]}, []), ({"scores": 5, "ai": "x"}, ["scores", "ai"]),
    ]
    lines = [json.dumps({**good, **change}) for change, _ in cases] + ["[]", "no json", "5"]
    df = spark.createDataFrame(list(enumerate(lines)), "k int, line string").orderBy("k")
    got = [r.e for r in df.select("k", schemas.raw_story_errors(F.col("line")).alias("e")).orderBy("k").collect()]
    assert got == [want for _, want in cases] + [["*"]] * 3


def test_ndjson_and_json_feeds(spark, tmp_path):
    (tmp_path / "day.ndjson").write_text('{"id":"s1","n":1}\nbroken {\n{"n":2}\n\n{"id":"s2"}\n')
    assert sorted(tuple(r) for r in feeds.read_ndjson(spark, str(tmp_path / "day.ndjson"), "id string, n int").collect()) == [("s1", 1), ("s2", None)]
    body = json.dumps({"items": [{"title": "T", "link": "http://x"}, {"title": "", "link": "http://y"}, {"title": "no link"}]})
    df = spark.createDataFrame([(body,), ("no json",), ('{"items": 5}',)], "b string")
    assert [[i.title for i in r.i or []] for r in df.select(feeds.parse_json_feed(F.col("b")).alias("i")).collect()] == [["T"], [], []]


def test_feeds_are_parsed_a_part_of_a_batch_at_a_time():
    import pyarrow as pa
    from presswork.sources import feeds

    xml = "<rss><channel><title>c</title><item><title>t</title><description>" + "x" * 100_000 + "</description></item></channel></rss>"
    made = list(feeds._parsed(iter([pa.array([xml] * 45 + [None]), pa.array([xml])])))
    assert len(made) > 4 and max(map(len, made)) <= 11 and sum(map(len, made)) == 47
    assert [r["error"] for m in made for r in m.to_pylist()] == [None] * 45 + ["parse", None]
