"""Joins by time, row numbers, postings and the state of a stream against plain versions of them."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from presswork.operators import postings, ranking, temporal
from presswork.operators.postings import Postings

START = datetime(2024, 1, 1)


def moments(rnd, n, keys, share_hot=0.4):
    key = lambda: None if rnd.random() < 0.03 else "hot" if rnd.random() < share_hot else rnd.choice(keys)
    when = lambda: None if rnd.random() < 0.03 else START + timedelta(minutes=rnd.randrange(60 * 24 * 9) // 7 * 7)
    return [(k, key(), when()) for k in range(n)]


@pytest.mark.parametrize("hours,within", [(24, None), (1, None), (400, 7200), (3, 36_000)])
def test_asof_by_hand(spark, hours, within):
    rnd = random.Random(hours)
    left, right = moments(rnd, 300, "abc"), moments(rnd, 250, "abcd")
    left += left[:5]
    right = [(*r, rnd.randrange(3)) for r in right]
    got = temporal.asof_join(
        spark.createDataFrame(left, "l int, k string, t timestamp_ntz"), spark.createDataFrame(right, "r int, k string, u timestamp_ntz, o int"),
        ["k"], "t", "u", ["o", "r"], hours, within,
    )
    assert got.columns == ["l", "k", "t", "match"]

    def best(k, t):
        some = [x for x in right if k is not None and x[1] == k and t is not None and x[2] is not None and x[2] <= t]
        top = max(some, key=lambda x: (x[2], x[3], x[0]), default=None)
        return None if top is None or within is not None and t - top[2] > timedelta(seconds=within) else tuple(top)

    want = sorted(((i, k, t, best(k, t)) for i, k, t in left), key=repr)
    assert sorted(((r.l, r.k, r.t, r.match and tuple(r.match)) for r in got.collect()), key=repr) == want
    assert any(w[3] for w in want) and any(w[3] is None for w in want)


def test_asof_with_empty_sides(spark):
    left = spark.createDataFrame([(1, "a", START)], "l int, k string, t timestamp_ntz")
    right = spark.createDataFrame([], "r int, k string, u timestamp_ntz")
    assert temporal.asof_join(left, right, ["k"], "t", "u").first().match is None
    assert temporal.asof_join(left.limit(0), right, ["k"], "t", "u").count() == 0


def test_a_hot_key_is_many_pieces(spark):
    """No window holds more rows than a piece has, though all rows have one key."""
    left = spark.range(2_000).select(F.lit("a").alias("k"), F.expr("timestampadd(hour, cast(id as int), timestamp'2024-01-01')").alias("t"))
    right = left.where("hour(t) = 0").select("k", F.col("t").alias("u"))
    df = temporal.asof_join(left, right, ["k"], "t", "u", hours=24)
    assert df.where("match.u = date_trunc('day', t)").count() == 2_000
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(k" in plan and all("_piece" in line for line in plan.splitlines() if "last(CASE" in line)


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_by_hand(spark, seed):
    rnd = random.Random(seed)
    points = moments(rnd, 200, "ab")
    spans = []
    for i, k, t in moments(rnd, 120, "ab"):
        length = rnd.choice([timedelta(0), timedelta(microseconds=1), timedelta(minutes=7), timedelta(hours=5), timedelta(days=6), timedelta(days=-1), timedelta(days=40_000)])
        spans.append((i, k, t, None if t is None or rnd.random() < 0.05 else t + length))
    got = temporal.interval_join(
        spark.createDataFrame(points, "p int, k string, t timestamp_ntz"), spark.createDataFrame(spans, "s int, k string, a timestamp_ntz, b timestamp_ntz"), ["k"], "t", "a", "b"
    )
    want = sorted((p, s) for p, k, t in points for s, j, a, b in spans if k is not None and k == j and None not in (t, a, b) and a <= t < b)
    assert sorted((r.point.p, r.span.s) for r in got.collect()) == want and len(want) > 500
    none = spark.createDataFrame([], "s int, k string, a timestamp_ntz, b timestamp_ntz")
    assert temporal.interval_join(spark.createDataFrame(points, "p int, k string, t timestamp_ntz"), none, ["k"], "t", "a", "b").count() == 0


def test_numbers_and_deep_pages(spark):
    rows = [(k, k * 7919 % 1000) for k in range(3_000)]
    df = spark.createDataFrame(rows, "id int, score int").repartition(5)
    keys = [F.desc("score"), F.col("id")]
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = ranking.numbered(df, keys)
    assert [(r.id, r.score) for r in sorted(got.collect(), key=lambda r: r["rank"])] == order
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 3_001))
    assert [tuple(r) for r in ranking.page(df, keys, 41, 48).collect()] == order[40 * 48 : 41 * 48]
    assert [tuple(r) for r in ranking.page(df, keys, 10**6, 48).collect()] == order[62 * 48 :]
    assert ranking.page(df.limit(0), keys).count() == 0


def test_postings_find_what_a_scan_finds(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(k, None if k == 3 else " ".join(rnd.choice(["alpha", "Beta", "gam-ma", "dé lta", "ab", "aab😀c", "\n"]) for _ in range(6))) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, text string")
    index = Postings(spark, f"{tmp_path}/index")
    index.build(df, "id", F.col("text"))
    for terms in (["beta"], ["ALPHA", "a dé"], ["ab"], ["b😀"], ["aab😀c", "ma"], ["zzz"], ["é lta"], ["phab"], []):
        got = sorted(r.id for r in index.search(df, "id", F.col("text"), terms).collect())
        assert got == sorted(k for k, t in rows if all(x.lower() in (t or "").lower() for x in terms)), terms
    assert index.candidates(["ab"]) is None and index.candidates(["zzz"]).count() == 0
    files = index.candidates(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in files and "bucket" in files


def test_postings_shuffle_lists_not_a_row_for_each_gram(spark, tmp_path):
    """2,000 texts in two tasks: a gram is a row of each task, and its lists name each of its texts once."""
    df = spark.range(0, 2_000, 1, 2).select("id", F.concat(F.lit("the same words "), F.col("id").cast("string")).alias("text"))
    index = Postings(spark, f"{tmp_path}/index")
    index.build(df, "id", F.col("text"))
    rows = spark.read.parquet(index.path)
    assert rows.where("gram = 'wor'").count() == 2 and rows.count() < 3_000
    assert sorted(r.id for r in rows.where("gram = 'wor'").select(F.explode("ids").alias("id")).collect()) == list(range(2_000))
    assert sorted(r.id for r in index.search(df, "id", F.col("text"), ["SAME", "s 77"]).collect()) == [77, *range(770, 780)]


@pytest.mark.parametrize("piece", [5, 50, 1 << 21])
@pytest.mark.parametrize("letters", ["ab\0", "aé😀\n", "".join(map(chr, range(0x20, 0x3000)))])
def test_lists_by_hand(monkeypatch, piece, letters):
    """Every gram of every text, whatever the pieces: cut texts, NUL, letters beyond 16 bits, alphabets of thousands."""
    monkeypatch.setattr(postings, "PIECE", piece)
    rnd = random.Random(piece)
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 2, 3, 4, 9, 60]))) for _ in range(90)]
    made = list(postings.lists(pa.array(range(90)), texts))
    got = [(g, i) for said, ids in made for g, some in zip(said, ids.to_pylist(), strict=True) for i in some]
    assert set(got) == {(t[k : k + 3], i) for i, t in enumerate(texts) for k in range(len(t) - 2)}
    assert piece < 60 or len(got) == len(set(got)), "only a text longer than a piece is cut"
    assert list(postings.lists(pa.array([1, 2]), ["", "ab"])) == []


def test_lists_of_more_letters_than_one_number_holds():
    """A trigram of all of Unicode and one of 16 rows take more than 63 bits; the rows are then taken apart."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    texts = [every[k::16] for k in range(16)]
    made = list(postings.lists(pa.array(range(16)), texts))
    got = {(g, i) for said, ids in made for g, (i,) in zip(said, ids.to_pylist(), strict=True)}
    assert len(made) > 1 and got == {(t[k : k + 3], i) for i, t in enumerate(texts) for k in range(len(t) - 2)}


def test_state_keeps_the_latest_and_evicts(spark, tmp_path):
    """Two starts on one checkpoint: state is kept between them, ties keep what is there, old versions go."""
    from presswork.streaming import state

    day = lambda n, h=0: START + timedelta(days=n, hours=h)
    first = [("a", day(0), "a0"), ("a", day(1), "a1"), ("b", day(1), "b1"), (None, day(1), "x"), ("c", day(5), "c5")]
    then = [("a", day(1), "tie"), ("a", day(0), "older"), ("b", day(6), "b6"), ("d", day(40), "d40")]
    name, seen = "spark.sql.streaming.stateStore.providerClass", []
    before = spark.conf.get(name)
    spark.conf.set(name, state.PROVIDER)
    try:
        for k, rows in enumerate((first, then)):
            spark.createDataFrame(rows, "id string, updated timestamp, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema("id string, updated timestamp, v string").parquet(f"{tmp_path}/in")
            q = (
                state.latest(stream, retention="30 days").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state")
                .foreachBatch(lambda df, n: seen.extend((r.id, r.v, r.action) for r in df.collect())).trigger(availableNow=True).start()
            )
            q.awaitTermination()
            if k == 0:
                assert sorted(seen) == [("a", "a1", "inserted"), ("b", "b1", "inserted"), ("c", "c5", "inserted")]
                seen.clear()
    finally:
        spark.conf.set(name, before)
    assert sorted(seen) == [("a", "a1", "evicted"), ("a", "a1", "unchanged"), ("b", "b6", "evicted"), ("b", "b6", "updated"), ("c", "c5", "evicted"), ("d", "d40", "inserted")]


def test_state_is_called_by_bucket_and_not_by_key():
    """A thousand keys of one bucket take a few calls to the state store, whether they are new, newer or go."""
    from types import SimpleNamespace

    from presswork.streaming import state
    from pyspark.sql import Row
    from pyspark.sql import types as T

    class Store:
        calls, held, timers = 0, None, ()

        def __getattr__(self, name):
            self.calls += 1
            return getattr(type(self), f"_{name}").__get__(self)

        def _getValueState(self, *_):
            return self

        def _get(self):
            return self.held

        def _update(self, value):
            self.held = value

        def _clear(self):
            self.held = None

        def _listTimers(self):
            return iter(self.timers)

        def _deleteTimer(self, at):
            self.timers = tuple(t for t in self.timers if t != at)

        def _registerTimer(self, at):
            self.timers = (*self.timers, at)

    store, fields = Store(), T._parse_datatype_string("id int, v string, at long")
    one = state.Latest("id", "at", fields)
    one.init(store)
    batch = lambda v, at: [r for r in one.handleInputRows((0,), (Row(id=k, v=v, at=at + 1_000_000 * k) for k in range(1_000)), None)]
    assert {r.action for r in batch("a", 5_000)} == {"inserted"} and store.timers == (5,)
    assert {(r.v, r.action) for r in batch("b", 9_000)} == {("b", "updated")} and store.timers == (9,)
    assert {(r.v, r.action) for r in batch("c", 9_000)} == {("b", "unchanged")}
    gone = list(one.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 500_009), None))
    assert [r.id for r in gone] == list(range(501)) and len(store.held[0]) == 499 and store.timers == (501_009,)
    list(one.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**9), None))
    assert store.held is None and store.timers == () and store.calls < 30
