"""Fetching against a local server, ingest, extraction, summaries, archive with its index, re-keying, runs and snapshots."""

import threading
from datetime import date, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from presswork.functions import lexicons as lex
from presswork.functions.scalars import story_id
from presswork.operators import archive, extract, runs, snapshot, summaries
from presswork.operators.archive import Archive
from presswork.sources import feeds

WORDS = " ".join(f"word{i}" for i in range(40))
FEED = "<rss><channel><title>c</title><item><title>One - Reuters</title><link>http://x.example/1</link></item></channel></rss>"


@pytest.fixture(scope="module")
def server():
    asked = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            n = asked[self.path] = asked.get(self.path, 0) + 1
            status = 429 if self.path.startswith("/busy") and n < 3 else 404 if self.path == "/gone" else 200
            kind = "application/pdf" if self.path == "/pdf" else "application/xml" if self.path == "/feed" else "text/html"
            body = {"/feed": FEED, "/empty": "", "/late": FEED if n > 1 else " "}.get(self.path, f"<article><p>{WORDS}</p></article>")
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", asked
    made.shutdown()


def test_fetch(spark, server, tmp_path):
    base, _ = server
    (tmp_path / "secret").write_text("never read")
    urls = [f"{base}/page", f"{base}/busy1", f"{base}/gone", f"{base}/empty", f"file://{tmp_path}/secret", "ftp://x/y", None]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r for r in feeds.fetch(rows, retries=3, backoff=(0.01,)).collect()}
    assert got[urls[0]].error is None and got[urls[0]].content_type == "text/html" and got[urls[0]].status == 200
    assert got[urls[1]].error is None and got[urls[1]].requests == 3
    assert (got[urls[2]].error, got[urls[2]].status, got[urls[2]].message) == ("http", 404, "status 404")
    assert got[urls[3]].error == "empty" and all(got[u].error == "network" and got[u].body is None for u in urls[4:])
    small = feeds.fetch(rows.limit(1), max_bytes=10).first()
    assert small.error == "http" and "10 bytes" in small.message


def test_ingest_from_a_server(spark, server):
    base, _ = server
    rows = [(n, n, f"{base}/{n}", 5.0, 3.0, "media") for n in ("feed", "gone", "late")]
    sources = spark.createDataFrame(rows, "id string, name string, url string, reliability double, weight double, category string")
    records = feeds.ingest(sources, partitions=2).cache()
    got = {r.source_id: (r.ok, r.status, r.errorType, r.itemCount) for r in records.collect()}
    assert got == {"feed": (True, "ok", None, 1), "gone": (False, "error", "http", 0), "late": (True, "ok", None, 1)}
    stories = feeds.normalize(feeds.items_of(records), sources, F.lit("2024-01-01").cast("timestamp"))
    assert {(r.title, r.source.id, r.canonicalUrl) for r in stories.collect()} == {("One", "feed", "http://x.example/1"), ("One", "late", "http://x.example/1")}


def test_extraction_shares_fetches(spark, server):
    base, asked = server
    stories = [
        (1, f"{base}/story", None, "a"), (2, f"{base}/story/", "x", "b"), (3, f"{base}/story", None, "b"), (4, f"{base}/story", "there", "a"), (5, None, None, "a"),
        (6, f"{base}/gone", None, "a"), (7, f"{base}/pdf", None, "a"), (8, "https://youtu.be/x", None, "a"), (9, f"{base}/other", None, "c"), (10, f"{base}/busy2", None, "b"),
    ]
    df = spark.createDataFrame([(i, u, None if c == "x" else c, s) for i, u, c, s in stories], "id long, canonicalUrl string, content string, source_id string")
    allowed = spark.createDataFrame([("a",), ("b",)], "source_id string")
    from presswork.sources.feeds import fetch

    got = extract.extract_articles(df, allowed, lambda r: fetch(r, retries=3, backoff=(0.01,))).cache()
    rows = {r.id: r for r in got.collect()}
    assert {i: r.outcome for i, r in rows.items()} == {
        1: "extracted", 2: "extracted", 3: "extracted", 4: "skipped", 5: "unaddressed", 6: "failed", 7: "failed", 8: "failed", 9: "disabled", 10: "extracted"
    }
    assert asked["/story"] + asked.get("/story/", 0) == 1 and "/other" not in asked and rows[4].content == "there" and rows[1].content == WORDS
    total = extract.statistics(got).where("source_id is null").first()
    assert (total.total, total.attempted, total.extracted, total.cached, total.requests, total.retries, total.avg_words) == (10, 7, 4, 3, 6, 2, 40)
    assert {(r.source_id, r.kind, r.value): r.n for r in extract.by_status(got).collect()}[("a", "status", "404")] == 1


def test_summaries_by_a_plugged_in_summariser(spark):
    body = "The new model ships today to everyone. It was trained on public text."

    def answer(prompt):
        if "broken" in prompt:
            raise ValueError("no answer")
        if "made up" in prompt:
            return {"summary": "Completely different invented statement without support"}
        return {"summary": " The model ships today. ", "whyItMatters": "", "keyTakeaways": ["Trained on public text.", " ", "x" * 300]}

    rows = [(1, "A title", body), (2, "broken", body), (3, "made up", body), (4, "empty", None)]
    df = spark.createDataFrame(rows, "id long, title string, content string")
    got = {r.id: r.ai for r in summaries.summarise(df, "llm", answer).collect()}
    assert got[1].method == "llm" and got[1].summary == "The model ships today." and got[1].whyItMatters is None
    assert len(got[1].keyTakeaways) == 2 and len(got[1].keyTakeaways[1]) <= 140
    assert got[2].method == got[3].method == "extractive" and got[2].summary.startswith("The new model") and (got[4].summary, got[4].method) == (None, None)
    once = summaries.summarise(df, "llm", answer)
    assert summaries.summarise(once).collect() == once.collect()
    assert summaries.resolved_mode("llm", None) == "extract"
    n = summaries.statistics(once).first()
    assert (n.summarized, n.extractive, n.llm, n.none) == (3, 2, 1, 1)


def batch(spark, rows):
    return spark.createDataFrame(rows, "id string, day date, updated timestamp, title string, url string")


def story(n, day, hour=0, title="t"):
    return (f"s{n:08x}", date(2026, 1, day), datetime(2026, 1, day, hour), title, "u")


def test_archive_reads_only_the_partitions_it_touches(spark, tmp_path):
    box = Archive(spark, f"{tmp_path}/days")
    done = box.upsert(batch(spark, [story(n, 1 + n % 6) for n in range(60)] + [("bad", date(2026, 1, 1), None, "x", "u")])).first()
    assert (done.inserted, done.upserted, done.days, done.total, done.skipped) == (60, 60, 6, 60, 1)
    old = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "days").rglob("*.parquet")}
    for part in (tmp_path / "days").glob("day=2026-01-0[3-6]"):  # what is not touched can't even be read
        for f in part.glob("*.parquet"):
            f.write_bytes(b"broken")
    more = box.upsert(batch(spark, [("s00000000", date(2026, 1, 2), datetime(2026, 2, 1), "moved", "u"), story(100, 2)])).first()
    assert (more.inserted, more.updated, more.days) == (1, 1, 2) and old
    assert box.read_by_id("s00000000").first().title == "moved" and str(box.read_by_id("s00000000").first().day) == "2026-01-02"
    assert box.read_by_id("sffffffff") is None and box.read_day("2026-01-01").count() == 9
    assert box.index().count() == 61 and box.index().where("id = 's00000000'").count() == 1
    assert box.remove(spark.createDataFrame([("s00000000",), ("s00000064",)], "id string")) == 2
    assert box.read_by_id("s00000000") is None and box.index().count() == 59
    assert box.remove(spark.createDataFrame([("s00000006", date(2026, 1, 2))], "id string, day date")) == 0
    for n in range(6, 60, 6):
        box.remove(spark.createDataFrame([(f"s{n:08x}", date(2026, 1, 1))], "id string, day date")) if n in (6, 54) else None
    assert box.read_day("2026-01-01").count() == 7


def test_archive_cleanup_and_prune(spark, tmp_path):
    box = Archive(spark, f"{tmp_path}/days")
    box.upsert(batch(spark, [story(1, 1), story(2, 2), story(3, 3)]))
    stray = batch(spark, [story(1, 3, title="stray")]).drop("day")
    stray.write.mode("append").parquet(f"{tmp_path}/days/day=2026-01-03")
    with pytest.raises(ValueError):
        box.check()
    assert box.cleanup() == 1
    box.check()
    assert {(r.id, str(r.day)) for r in box.index().collect()} == {(f"s{n:08x}", f"2026-01-0{n}") for n in (1, 2, 3)}
    assert box.prune("2026-04-02", 90) == ["2026-01-01"] and box.index().count() == 2 and box.days() == ["2026-01-02", "2026-01-03"]


def test_rekey_of_an_archive(spark, tmp_path):
    schema = "id string, day date, updated timestamp, title string, url string, description string, author string, tags array<string>, sources array<string>, reportedBy int"
    url, at = "https://x.example/a", lambda d: datetime(2026, 1, d)
    clean = spark.range(1).select(story_id(F.lit("Model ships"), F.lit(url)).alias("i")).first().i
    other = spark.range(1).select(story_id(F.lit("Quiet day"), F.lit(url)).alias("i")).first().i
    rows = [
        ("s00000001", date(2026, 1, 1), at(1), "Model ships - Reuters", url, "long description", None, ["a"], ["r"], None),
        ("s00000002", date(2026, 1, 2), at(2), "Model ships | Axios", url, None, "me", ["b", "a"], ["x", "r"], None),
        (other, date(2026, 1, 2), at(2), "Quiet day", url, None, None, [], [], None),
    ]
    box = Archive(spark, f"{tmp_path}/days")
    box.upsert(spark.createDataFrame(rows, schema))
    dry = box.rekey(lex.publisher_aliases(), write=False).first()
    assert (dry.input_rows, dry.unchanged, dry.rekeyed, dry.merged, dry.danger, dry.collisions) == (3, 1, 1, 1, 0, 0) and box.read().count() == 3
    box.rekey(lex.publisher_aliases())
    got = {r.id: r for r in box.read().collect()}
    assert set(got) == {clean, other} and got[clean].title == "Model ships" and got[clean].description == "long description" and got[clean].author == "me"
    assert got[clean].tags == ["b", "a"] and got[clean].sources == ["x", "r"] and got[clean].reportedBy == 2 and str(got[clean].day) == "2026-01-02"
    box.check(lex.publisher_aliases())
    assert box.days() == ["2026-01-02"] and box.read_by_id(clean).count() == 1
    again = box.rekey(lex.publisher_aliases()).first()
    assert (again.unchanged, again.rekeyed, again.merged) == (2, 0, 0)


def test_rows_in_danger_keep_their_ids(spark, monkeypatch):
    monkeypatch.setattr(archive, "story_id", lambda title, url: F.lit("s0000aaaa"))  # every clean id the same
    rows = [(f"s0000000{i}", date(2026, 1, 1), datetime(2026, 1, i), "t", f"https://x.example/{'a' if i < 3 else 'b'}", None) for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, "id string, day date, updated timestamp, title string, url string, description string")
    done = archive.rekeyed(df, [])
    assert {(r.id, r.fate) for r in done.collect()} == {("s0000aaaa", "kept"), ("s00000003", "danger")}
    assert archive.rekey_statistics(done).first().danger == 1


def test_one_identity_of_two_addresses(spark, tmp_path):
    """rekey_stats counts what its SQL counts, also where two addresses share a 32-bit id."""
    import os

    import duckdb
    from presswork.plans import build_queries

    sf = "/root/testdata/sf0.001"
    for name in os.listdir(sf):
        if name != "documents.parquet":
            os.symlink(f"{sf}/{name}", f"{tmp_path}/{name}")
    # in ids of djb2 "as" and "c1" are alike: 33 * 97 + 115 = 33 * 99 + 49
    rows = [(1, "Model one ships.", "en", "as", 16), (3, "Model one ships.", "en", "c1", 16), (4, "Model two ships.", "en", "as", 16), (5, "Model one ships.", "en", "as", 16)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want, got = con.execute(build_queries.SQL["rekey_stats"]), build_queries.rekey_stats(spark, str(tmp_path))
    assert [tuple(r) for r in got.select(*[c[0] for c in want.description]).collect()] == want.fetchall()
    assert got.first().merged == 2 and got.first().danger == 0


def test_run_log(spark, tmp_path):
    log = runs.RunLog(spark, f"{tmp_path}/runs")
    assert log.list().count() == 0

    def record(day, stored, sources):
        rows = [(datetime(2026, 1, day, 5, 6, 7), stored, sources)]
        return spark.createDataFrame(rows, "finishedAt timestamp, stored long, sources array<struct<id:string,name:string,status:string,itemCount:int,errorType:string,responseMs:long>>")

    log.append(record(1, 10, [("a", "A", None, 1, None, 1), ("b", "B", "error", 0, "http", 1)]))
    log.append(record(2, 0, None))
    log.append(record(2, 0, None))  # the same run again
    ids = [r.runId for r in log.list().collect()]
    assert len(ids) == 2 and ids[0].startswith("2026-01-01-050607-") and len(ids[0]) == 24
    last, sources = log.health()
    rows = last.collect()
    assert [r.sourcesOk + r.sourcesError for r in rows] == [0, 2] and rows[1].degraded and rows[1].status == "degraded"
    assert {r["class"] for r in sources.collect()} == {"warning", "error"}


def test_snapshot_and_what_stands_in(spark, tmp_path):
    path = f"{tmp_path}/snap"
    chain = {"snapshot": lambda: snapshot.read(spark, path), "cache": lambda: None, "samples": lambda: snapshot.samples(spark)}
    assert snapshot.first_available(chain)[0] == "samples"
    rows = snapshot.samples(spark).withColumn("score", F.length("id").cast("double"))
    snapshot.write(rows, path, F.lit("2026-01-01").cast("timestamp"))
    name, got = snapshot.first_available(chain)
    assert name == "snapshot" and got.count() == 5
    assert snapshot.fresh_enough(0, 60) and not snapshot.fresh_enough(0, 1000) and not snapshot.fresh_enough(None, 0)
