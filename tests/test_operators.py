"""Clusters, archive, streams, feeds and pages."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from presswork.functions import html
from presswork.operators import archive, cluster, entities, search, trends
from presswork.operators.archive import Archive
from presswork.sources import feeds
from presswork.streaming import stories as streams

STORY = "id long, title string, url string, source_id string, reliability int, published timestamp"


def clusters(spark, rows):
    return {r.id: r for r in cluster.cluster(spark.createDataFrame(rows, STORY)).collect()}


def by_hand(rows):
    def core(t):
        low = {*cluster.STOPWORDS, *cluster.LOW_INFO}
        return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split() if w not in low]

    n = len(rows)
    top = list(range(n))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = set(core(rows[i][1])), set(core(rows[j][1]))
            ta, tb = rows[i][5], rows[j][5]
            close = ta is None or tb is None or abs((ta - tb).total_seconds()) <= 72 * 3600
            if len(core(rows[i][1])) >= 2 and len(core(rows[j][1])) >= 2 and len(a & b) / len(a | b) >= 0.7 and close:
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    return {rows[i][0]: rows[root(i)][0] for i in range(n)}


@pytest.mark.parametrize("undated", [0, 0.15])
def test_clusters_by_hand(spark, undated):
    rnd = random.Random(1)
    words = [f"word{i}" for i in range(14)]
    bases = [[rnd.choice(words) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(70):
        t = list(rnd.choice(bases))
        if rnd.random() < 0.5:
            t[rnd.randrange(6)] = rnd.choice(words)
        at = None if rnd.random() < undated else datetime(2026, 1, 1 + rnd.randrange(20), rnd.randrange(24))
        rows.append((i, " ".join(t), f"http://h{i}.com/{i}", f"s{i % 4}", i % 5, at))
    got = clusters(spark, rows)
    assert {i: r.root for i, r in got.items()} == by_hand(rows)
    back = clusters(spark, rows[::-1])
    assert {i: (r.root, r.canonical) for i, r in back.items()} == {i: (r.root, r.canonical) for i, r in got.items()}
    assert all(sum(x.canonical for x in got.values() if x.root == r) == 1 for r in {x.root for x in got.values()})


def test_same_headline_a_month_apart_stays_apart(spark):
    rows = [
        (1, "Lab releases new Falcon model weights", "http://a.com/1", "a", 5, datetime(2026, 1, 1)),
        (2, "Lab announces its latest Falcon model weights", "http://b.com/1", "b", 9, datetime(2026, 1, 2)),
        (3, "Lab releases new Falcon model weights", "http://c.com/1", "c", 5, datetime(2026, 2, 10)),
    ]
    got = clusters(spark, rows)
    assert got[1].root == got[2].root == 1 and got[3].root == 3
    assert got[2].canonical and not got[1].canonical and got[1].n_sources == 2


def batch(spark, rows):
    return spark.createDataFrame(rows, "id string, day date, updated timestamp, title string, url string")


def test_archive_upserts_moves_and_prunes(spark, tmp_path):
    box = Archive(spark, f"{tmp_path}/days")
    d1, d2 = date(2026, 1, 1), date(2026, 1, 2)
    one = batch(spark, [("s00000001", d1, datetime(2026, 1, 1), "a", "u"), ("s00000002", d2, datetime(2026, 1, 2), "b", "u"), ("bad", d1, None, "x", "u")])
    assert box.upsert(one).first().inserted == 2
    again = box.upsert(one).first()
    assert (again.inserted, again.updated, again.unchanged) == (0, 0, 2)
    box.upsert(batch(spark, [("s00000001", d2, datetime(2026, 1, 3), "moved", "u")]))
    rows = {r.id: r for r in box.read().collect()}
    assert rows["s00000001"].day == d2 and rows["s00000001"].title == "moved" and len(rows) == 2
    box.check()
    older = box.upsert(batch(spark, [("s00000002", d2, datetime(2025, 1, 1), "old", "u")])).first()
    assert older.updated == 0 and {r.title for r in box.read().collect()} == {"moved", "b"}
    assert box.prune("2026-06-01", 90) == ["2026-01-02"]


def test_duplicate_ids_are_found(spark):
    rows = batch(spark, [("s1", date(2026, 1, 1), None, "a", "u"), ("s1", date(2026, 1, 2), None, "a", "u"), ("s2", date(2026, 1, 1), None, "a", "u")])
    assert [r.id for r in archive.duplicate_ids(rows).collect()] == ["s1"]


def test_stream_into_archive_equals_batch(spark, tmp_path):
    rows = [(f"s{i:08x}", date(2026, 1, 1 + i % 3), datetime(2026, 1, 1, i), f"t{i}", "u") for i in range(12)]
    for k in range(3):
        batch(spark, rows[k * 4 : k * 4 + 6]).write.parquet(f"{tmp_path}/in/part{k}")
    paths = f"{tmp_path}/in/*"
    stream = spark.readStream.schema(batch(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(paths)
    box = Archive(spark, f"{tmp_path}/days")
    q = streams.upsert(stream, box, f"{tmp_path}/state")
    q.awaitTermination()
    assert sorted(r.id for r in box.read().collect()) == sorted(r[0] for r in rows)


RSS = """<?xml version="1.0"?><rss xmlns:media="http://search.yahoo.com/mrss/"><channel><title>c</title>
<item><title><![CDATA[One & two]]></title><link>http://x.com/1</link><pubDate>Wed, 02 Sep 2026 12:00:00 GMT</pubDate>
<description>&lt;p&gt;Hi&amp;nbsp;there&lt;/p&gt;</description><media:content url="http://x.com/logo.png"/></item>
<item><description>untitled</description></item></channel></rss>"""


@pytest.mark.parametrize(
    "xml,n,error",
    [
        (RSS, 1, None),
        ('<feed xmlns="http://www.w3.org/2005/Atom"><title>c</title><entry><title>t</title><link href="http://x/2"/></entry></feed>', 1, None),
        ("<rss><channel><title>c</title></channel></rss>", 0, None),
        ("<rss><channel><item><title><![CDATA[broken", 0, "parse"),
        ("<rss><channel><title>c</title><item><ti", 0, None),
        ("<html><body>no</body></html>", 0, "parse"),
        ('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><channel><title>c</title></channel><item><title>t</title></item></rdf:RDF>', 1, None),
        ("", 0, "parse"),
        (None, 0, "parse"),
    ],
)
def test_feeds(xml, n, error):
    got = feeds.parse_feed(xml)
    assert (len(got["items"]), got["error"]) == (n, error)


def test_feed_fields():
    item = feeds.parse_feed(RSS)["items"][0]
    assert item == {"title": "One & two", "link": "http://x.com/1", "pubDate": "Wed, 02 Sep 2026 12:00:00 GMT", "description": "Hi there", "image": None}


def test_sources(spark, tmp_path):
    path = tmp_path / "sources.json"
    path.write_text('{"sources": [{"id": "b", "name": "B", "url": "https://b", "category": "media", "priority": 2}, {"id": "a", "name": "A", "url": "https://a", "category": "media", "priority": 1, "enabled": false}, {"id": "b", "name": "C", "url": "https://c", "category": "media"}, {"id": "Bad", "name": "", "url": "x", "category": "y"}]}')
    rows = feeds.load_sources(spark, str(path)).collect()
    errors = {(r.id, r.name): list(r.errors) for r in rows}
    assert errors[("b", "B")] == [] and errors[("b", "C")] == ["duplicate"] and errors[("Bad", "")] == ["id", "name", "url", "category"]
    assert [r.id for r in feeds.enabled(feeds.load_sources(spark, str(path))).collect()] == ["b"]


def test_fetch_errors_are_rows(spark):
    rows = spark.createDataFrame([("http://127.0.0.1:1/x",), ("nonsense",)], "url string")
    assert [r.error for r in feeds.fetch(rows, timeout=2).collect()] == ["network", "network"]


WORDS = " ".join(f"word{i}" for i in range(30))


def test_articles():
    page = f"<head><title>t</title></head><nav>menu</nav><article><script>var t='</p>';x</script><p>{WORDS}</p><div class='shareBar x'>share me</div></article>"
    assert html.article(page) == WORDS
    assert html.article(page.replace("word0 ", "")) is None
    assert html.article(f"<p>a<p>{WORDS}</p>") == "a " + WORDS
    assert html.article(f"<article><p>{WORDS} &amp;lt; é &#233;</p></article>").endswith("< é é")
    assert html.article(None) is None
    assert html.is_boilerplate("ad-slot") and html.is_boilerplate("relatedArticles") and not html.is_boilerplate("adapter")


def test_skipped_urls(spark):
    rows = spark.createDataFrame([("https://m.youtube.com/x",), ("https://x.org/a.PDF",), ("https://notx.com/a",)], "u string")
    assert [r.s for r in rows.select(html.skipped(F.col("u")).alias("s")).collect()] == [True, True, False]


def test_search_pages_clamp(spark):
    rows = spark.createDataFrame([(i, None, None) for i in range(10)], "id long, score int, published timestamp")
    ids = lambda page, size: [r.id for r in search.page(rows, search.order(), page, size).collect()]
    assert ids(0, 3) == [0, 1, 2] and ids(99, 3) == [9] and ids(1, 48) == list(range(10))


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "id long, score int, published timestamp, category string, companies array<string>, models array<string>, technologies array<string>, source_id string, source_name string")
    assert trends.daily_series(none).count() == trends.category_mix(none).count() == trends.trending(none, "companies").count() == 0
    assert entities.statistics(none, "company").count() == 0
    assert search.search(none, search.Request()).count() == 0


def test_routes():
    assert entities.parse_hash("#/radar") == ("global", None, None)
    assert entities.parse_hash("#/radar/company/open-ai") == ("entity", "company", "open-ai")
    assert entities.parse_hash("#/radar/x/y")[0] == "unknown" and entities.parse_hash("#/news")[0] == "none"
