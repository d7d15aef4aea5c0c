"""Closed itemsets and their rules against all subsets by hand, with both phases."""

import random
from itertools import combinations

import duckdb
import numpy as np
import pytest

from presswork.llm import closed_itemsets as ci

SF = "/root/testdata/sf0.001"


def by_hand(pairs, least, share, confidence):
    held = {}
    for b, i in pairs:
        if b is not None and i is not None:
            held.setdefault(b, set()).add(i)
    least = max(least, -(-len(held) // share))
    count = {}
    for items in held.values():
        for n in range(1, len(items) + 1):
            for s in combinations(sorted(items), n):
                count[s] = count.get(s, 0) + 1
    frequent = {s: n for s, n in count.items() if n >= least}
    every = {i for s in frequent for i in s}
    out = {}
    for s, n in frequent.items():
        if all(count.get(tuple(sorted({*s, i})), 0) < n for i in every - set(s)):
            rules = []
            for c in s if len(s) > 1 else ():
                a, own = count[tuple(x for x in s if x != c)], count[c,]
                if 100 * n >= confidence * a and n * len(held) > a * own:
                    rules.append((c, a, own))
            out[s] = (n, tuple(rules))
    return out


def found(df):
    got = [(tuple(r["items"]), (r.support, tuple(map(tuple, r.rules or ())))) for r in df.collect()]
    assert len(dict(got)) == len(got)
    return dict(got)


def random_pairs(seed, items=9, baskets=120):
    rnd = random.Random(seed)
    pairs = []
    for b in range(baskets):
        for i in range(items):
            if rnd.random() < (0.9 if i == 3 else 0.45):
                pairs.append((b, i * 7 - 10))
                if i == 5:
                    pairs += [(b, 100), (b, -3)]  # these come along with it, so many sets aren't closed
    return pairs + pairs[:40] + [(None, 1), (1, None), (None, None)]


@pytest.mark.parametrize("task_rows", [3, 25, 1_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_sets_and_rules_by_hand(spark, seed, task_rows):
    pairs = random_pairs(seed)
    df = spark.createDataFrame(pairs, "b long, i long").repartition(3)
    want = by_hand(pairs, 8, 20, 60)
    assert len(want) > 50 and any(rules for _, rules in want.values())
    assert found(ci.closed_itemsets(df, "b", "i", 8, 20, 60, task_rows)) == want


@pytest.mark.parametrize("task_rows", [2, 1_000])
def test_items_in_every_basket(spark, task_rows):
    pairs = [(b, i) for b in range(30) for i in (7, 3, *random.Random(b).sample(range(20, 28), 4))]
    df = spark.createDataFrame(pairs, "b long, i long")
    got = found(ci.closed_itemsets(df, "b", "i", 4, 2000, 10, task_rows))
    assert got == by_hand(pairs, 4, 2000, 10) and got[3, 7][0] == 30 and all({3, 7} <= set(s) for s in got)


def test_a_walk_alone():
    rnd = random.Random(4)
    rows = [sorted({0, *rnd.sample(range(1, 12), 6)}) for _ in range(200)]
    got = list(ci.walk([np.array(r, np.int32) for r in rows], np.ones(200, np.int64), [], 0, {}, 5))
    want = by_hand([(b, i) for b, r in enumerate(rows) for i in r], 5, 10**9, 0)
    assert len(got) == len(want) and {tuple(s): n for s, n in got} == {s: n for s, (n, _) in want.items()}


def test_failed_tests_that_are_handed_down_save_closures(monkeypatch):
    rnd = random.Random(4)
    rows = [sorted({0, *(x for x in range(1, 14) if rnd.random() < 0.6)}) for _ in range(300)]
    rows = [np.array(sorted({*r, *([9] if 11 in r else [])}), np.int32) for r in rows]
    calls = []
    counts = ci.Branch.counts
    monkeypatch.setattr(ci.Branch, "counts", lambda self, own: calls.append(1) or counts(self, own))
    got = list(ci.walk(rows, np.ones(300, np.int64), [], 0, {}, 5))
    handed = len(calls)
    calls.clear()
    real = dict
    monkeypatch.setattr(ci, "dict", lambda *_: {}, raising=False)
    assert sorted(ci.walk(rows, np.ones(300, np.int64), [], 0, {}, 5)) == sorted(got)
    monkeypatch.setattr(ci, "dict", real, raising=False)
    assert handed < len(calls)


def test_hot_branches_are_tables_not_tasks(spark, monkeypatch):
    """No task walks more rows than allowed, and the result stays."""
    pairs = [(b, i) for b in range(400) for i in ({1} if b % 3 == 0 else set()) | set(random.Random(b).sample(range(2, 30), 5))]
    df = spark.createDataFrame(pairs, "b long, i long")
    stream = ci._seeds

    def watched(least):
        run = stream(least)

        def checked(batches):
            counts = {}

            def passing():
                for batch in batches:
                    for node, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        counts[tuple(node)] = counts.get(tuple(node), 0) + (kind == 2)
                    yield batch

            yield from run(passing())
            assert all(n <= 40 for n in counts.values()), counts

        return checked

    monkeypatch.setattr(ci, "_seeds", watched)
    want = by_hand(pairs, 8, 2000, 10)
    assert found(ci.closed_itemsets(df, "b", "i", 8, 2000, 10, 40)) == want


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "b long, i long")
    assert found(ci.closed_itemsets(none, "b", "i")) == {}
    assert found(ci.closed_itemsets(spark.createDataFrame([(1, 1), (None, 2)], "b long, i long"), "b", "i")) == {}


def test_clashing_names(spark):
    rows = [(b, i, "x") for b in range(10) for i in (1, 2)]
    df = spark.createDataFrame(rows, "basket long, item long, items string").selectExpr("*", "1 as rank", "2 as weight", "3 as node")
    assert found(ci.closed_itemsets(df, "basket", "item")) == {(1, 2): (10, ())}


def test_query_against_its_sql(spark):
    from presswork.llm.registry import QUERIES, SQL

    con = duckdb.connect()
    con.execute(f"create view sale_lines as select * from '{SF}/sale_lines.parquet'")
    want = con.sql(SQL["op12_closed_itemsets"])
    got = QUERIES["op12_closed_itemsets"](spark, SF)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
