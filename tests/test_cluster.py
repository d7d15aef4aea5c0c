"""Clusters of headlines against all pairs by hand."""

import random
import re
from datetime import datetime, timedelta

import pytest

from presswork.operators import cluster, search
from pyspark.sql import functions as F

SCHEMA = "id int, title string, url string, published timestamp, source_id string, reliability int"


def components_by_hand(ids, edges):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def by_hand(rows):
    sets = {i: frozenset(t.split()) for i, t, *_ in rows}
    at = {r[0]: r[3] for r in rows}
    near = lambda u, v: at[u] is None or at[v] is None or abs(at[u] - at[v]) <= timedelta(hours=72)
    ids = [r[0] for r in rows]
    pairs = [(u, v) for u in ids for v in ids if u < v and near(u, v) and len(sets[u] & sets[v]) >= 0.7 * len(sets[u] | sets[v]) - 1e-9]
    return components_by_hand(ids, pairs)


@pytest.mark.parametrize("seed,undated", [(1, 0), (2, 0.02), (3, 0), (4, 0.1)])
def test_components_of_links_by_hand(spark, seed, undated):
    rnd = random.Random(seed)
    names = [f"zork{a}{b}" for a in "abcdefg" for b in "xyz"]
    bases = [rnd.sample(names, rnd.randint(3, 8)) for _ in range(9)]
    rows = []
    for i in range(260):
        words = list(bases[0] if i % 3 == 0 else rnd.choice(bases))  # a title that a third of the rows have
        if rnd.random() < 0.4:
            words[rnd.randrange(len(words))] = rnd.choice(names)
        at = None if rnd.random() < undated else datetime(2026, 1, 1) + timedelta(hours=rnd.choice([0, 71, 72, 73, 144, rnd.randrange(24 * 60)]))
        rows.append((i, " ".join(dict.fromkeys(words)), f"http://h/{i}", at, "s", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    edges = [(r.u, r.v) for r in cluster.links(df).collect()]
    assert components_by_hand([r[0] for r in rows], edges) == by_hand(rows)
    assert len(set(by_hand(rows).values())) > (3 if undated else 12)


def test_a_repeated_title_needs_no_window(spark):
    """Each of many stories of one title has one edge to its piece, and pieces have one to the next."""
    df = spark.range(20_000).select(
        F.col("id").cast("int").alias("id"), F.lit("untitled weekly report").alias("title"), F.format_string("http://h/%d", "id").alias("url"),
        F.expr("timestampadd(minute, cast(id as int), timestamp'2026-01-01')").alias("published"), F.lit("s").alias("source_id"), F.lit(1).alias("reliability"),
    )
    edges = cluster.links(df)
    assert 19_000 < edges.count() <= 20_000 and cluster.components(df, edges).select("root").distinct().count() == 1
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    made = {m for line in plan.splitlines() if "Window [" in line for m in re.findall(r"frame\([^)]*\)*\) AS (\w+)#", line.replace("$()", ""))}
    assert made == {"n", "r"}  # of the words of distinct titles alone, never of stories


def test_deep_pages_are_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(k, k * 37 % 100, None) for k in range(500)], "id int, score int, published timestamp")
    plain = search.page(rows, search.order(), 7, 48).collect()
    monkeypatch.setattr(search, "DEEP", 10)
    assert search.page(rows, search.order(), 7, 48).collect() == plain


def test_cluster_queries_carry_no_texts(spark, monkeypatch):
    from presswork.plans import catalogue

    seen, plain = [], cluster.cluster
    monkeypatch.setattr(cluster, "cluster", lambda df: seen.append(df.columns) or plain(df.limit(50)))
    for name in ("cluster_canonical", "cluster_stats", "cluster_sources"):
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(seen) == 3 and not any("description" in columns for columns in seen)


def test_long_chains_settle_in_few_rounds(spark, monkeypatch):
    """A chain with ids in no order; the number that estimates the result's size may not grow with the rounds."""
    monkeypatch.setattr(cluster, "MAX_ROUNDS", 12)
    ids = [f"s{k:03}" for k in range(100)]
    random.Random(1).shuffle(ids)
    nodes = spark.createDataFrame([(i,) for i in [*ids, "s900"]], "id string")
    place = spark._jvm.org.apache.hadoop.fs.Path(cluster.shared_folder(spark) + "/presswork-*")
    tables = lambda: {str(f.getPath()) for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)}
    before = tables()
    roots = cluster.components(nodes, spark.createDataFrame(list(zip(ids, ids[1:])), "u string, v string"))
    assert {r.id: r.root for r in roots.collect()} == {i: "s000" for i in ids} | {"s900": "s900"}
    assert len(roots._jdf.queryExecution().optimizedPlan().stats().simpleString()) < 100
    assert tables() == before


def test_links_find_similar_sets_once(spark):
    rows = [(k, f"zork{k % 3} blorp frob{k % 2} quux", f"http://h/{k}", datetime(2026, 1, 1) if k % 2 else None, "s", 1) for k in range(8)]
    plan = cluster.links(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("Generate explode(tokens") <= 4  # the words and their numbers, on both sides of the join
