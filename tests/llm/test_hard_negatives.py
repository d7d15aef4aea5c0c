"""Hard negatives against all scores by hand, and the bounds that the search rests on."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.llm import hard_negatives as hn

SF = "/root/testdata/sf0.01"
SCHEMA = "id long, label int, v array<double>, n int, region string"


def by_hand(rows, every, k=5, m=10):
    good = [(i, c, [int(np.floor(256 * x)) for x in v]) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = max((len(v) for *_, v in good), default=0)
    good = [(i, c, v + [0] * (d - len(v))) for i, c, v in good]
    out = []
    for i, c, v in {(i, c, tuple(v)) for i, c, v in good if i % every == 0}:
        scored = [(-sum(x * y for x, y in zip(v, w)), j, b) for j, b, w in good if j != i]
        for p, pos in [(-s, j) for s, j, b in sorted(x for x in scored if x[2] == c)][:k]:
            fit = sorted((s, j) for s, j, b in scored if b != c and 30 * p <= -100 * s <= 90 * p)
            out += [(i, pos, r, j, p, -s) for r, (s, j) in enumerate(fit[:m], 1)]
    return sorted(out)


def found(spark, rows, every):
    rows = [(i, c, v if v is None else [x if x is None else float(x) for x in v]) for i, c, v in rows]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = hn.hard_negatives(hn.vectors(df, "id", "v", F.col("label"), F.col("id") % every == 0))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def cluster_rows(seed, n=700, d=6, labels=4):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(9, d))
    return [(int(i), int(rnd.integers(labels)), (centres[rnd.integers(9)] + 0.2 * rnd.normal(size=d)).round(3).tolist()) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    for name, v in (("BUNDLE", 60), ("ANCHORS", 16), ("LEAF", 8), ("ANCHOR_LEAF", 4)):
        monkeypatch.setattr(hn, name, v)


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_by_hand(spark, small, seed):
    rows = cluster_rows(seed)
    want = by_hand(rows, 10)
    assert len(want) > 1_000 and found(spark, rows, 10) == want


def test_one_vector_on_a_third_of_the_rows(spark, small):
    rows = [(i, c, [0.5, 0.25, 1, 0, 0, 0.1] if i % 3 == 0 else v) for i, c, v in cluster_rows(3)]
    assert found(spark, rows, 20) == by_hand(rows, 20)


def test_whole_groups_are_put_aside(spark, small, monkeypatch):
    """Far clusters are never scored, and nothing is lost by it."""
    rows = [(i, i // 2 % 2, [4.0 * (i % 2), 4.0 * (1 - i % 2), (i % 7) / 20, (i % 11) / 20]) for i in range(600)]
    want = by_hand(rows, 10)
    assert found(spark, rows, 10) == want
    from pyspark.sql import DataFrame

    pairs = []
    save = hn.Scratch.__call__

    def watched(self, df: DataFrame):
        made = save(self, df)
        if set(made.columns) == {"bundle", "meets"}:
            pairs.append(made.count())
        return made

    monkeypatch.setattr(hn.Scratch, "__call__", watched)
    assert found(spark, rows, 10) == want
    anchors, bundles = 60 / 16, 600 / 60
    assert sum(pairs) < 2 * anchors * bundles


def test_odd_rows(spark, small):
    nan, inf = float("nan"), float("inf")
    rows = cluster_rows(5, 60)
    rows += [(None, 1, [1.0]), (200, None, [1.0]), (201, 1, None), (202, 1, [nan, 1.0]), (203, 1, [1.0, -inf]), (204, 1, [1.0, None])]
    rows += [(210, 1, [1.0, 1.0]), (220, 2, []), (230, 1, [0.0] * 6), *rows[:12], (rows[10][0], 3, [0.5] * 6), (250, 1, [-3e4, 1e5, 3.0])]
    assert found(spark, rows, 10) == by_hand(rows, 10)
    assert found(spark, [], 10) == [] and found(spark, [(10, 1, [1.0])], 10) == []


def test_large_components_are_exact(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, i % 2, (rnd.integers(-(10**6), 10**6, 3) / 256.0 * 100 + 3e5).tolist()) for i in range(80)]
    assert found(spark, rows, 8) == by_hand(rows, 8)


def test_intervals_hold():
    rnd = np.random.default_rng(2)
    a, b = rnd.integers(-300, 300, (40, 16)), rnd.integers(-300, 300, (50, 16)) + 200
    ca, cb = a.mean(0), b.mean(0)
    ra, rb = np.sqrt(((a - ca) ** 2).sum(1).max()), np.sqrt(((b - cb) ** 2).sum(1).max())
    low, high = hn.interval(ca[None], np.array([ra]), cb[None], np.array([rb]))
    scores = a @ b.T
    assert low[0, 0] <= scores.min() and scores.max() <= high[0, 0]
    assert hn.best(np.array([5, 9, 9, 1, 9]), np.array([1, 7, 2, 3, 4]), 2).tolist() == [2, 4]


def test_query_against_its_sql(spark):
    from presswork.llm.registry import QUERIES, SQL

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.sql(SQL["op13_hard_negatives"])
    got = QUERIES["op13_hard_negatives"](spark, SF)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
