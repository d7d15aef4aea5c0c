"""Closed frequent itemsets of baskets, and rules from them, by close-by-one.

A concept is a set of items with all baskets that hold it; its item set is closed: no
further item stands in all of those baskets. Concepts with enough baskets form the iceberg
lattice. Close-by-one walks a tree in it: a concept is extended by one item `j` behind its
own last one, the baskets are cut down to those with `j`, and the item set is closed again.
The extension counts (is *canonical*) only if closing adds no item before `j`; so every
concept is reached once, and no branch needs to know another. A test that fails is handed
down: where closing with `j` has once added an item `x` before `j`, it adds `x` again below,
so that `j` is passed over, without closing anything, until the set holds `x`.

Items are ordered by rising support, so frequent ones have few items behind them.

* **Baskets** are distinct (basket, item) pairs of frequent items; equal item sets are one row
  with a weight. A basket's row is no longer than the number of frequent items, which is
  at most (mean basket size) / (least share), whatever the number of baskets.
* **Breadth phase.** While a branch has more than `TASK_ROWS` rows, it is treated as a table:
  its items' counts are sums over all its rows (added up before the shuffle, so a hot
  item is no hot task), the closure and the test are read off these, and its children are branches of the next round.
* **Depth phase.** All branches with at most `TASK_ROWS` rows are seeds: a seed's rows and the failed tests
  of its ancestors are dealt to tasks by seed, and a task walks the seed's whole
  subtree. It holds one seed at a time.

So nothing that grows with the number of baskets goes through one task, to the driver or
into a broadcast. Steps are tables in the shared folder.

**Rules.** Taking an item out of a closed set leaves a set whose support is that of its
smallest closed superset: the set itself where it is closed, else the largest support among closed supersets.

Rows with a null basket or item take no part; repeated pairs count once; no baskets, or none
that is frequent, give an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, col

#: A branch with more distinct rows than this is counted as a table; other branches go to one task each.
TASK_ROWS = 8192
#: The least support, and the least share of the baskets: support * SHARE >= baskets.
LEAST, SHARE = 8, 2000
#: A rule's confidence in per cent.
CONFIDENCE = 10


class Branch:
    """The rows of a seed: for each row its items, for each item its rows."""

    def __init__(self, rows: list[np.ndarray], weights: np.ndarray):
        sizes = np.array([len(r) for r in rows], np.int64)
        self.starts, self.sizes, self.weights = np.cumsum(sizes) - sizes, sizes, weights
        self.items, self.of = np.unique(np.concatenate(rows), return_inverse=True)
        order = np.argsort(self.of, kind="stable")
        holder = np.repeat(np.arange(len(rows)), sizes)[order]
        self.holders = np.split(holder, np.cumsum(np.bincount(self.of, minlength=len(self.items)))[:-1])

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """The weight of those of `rows` that hold each item."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        return np.bincount(self.of[at], weights=np.repeat(self.weights[rows], sizes), minlength=len(self.items)).astype(np.int64)


def walk(rows: list[np.ndarray], weights: np.ndarray, intent: list[int], item: int, failed: dict[int, frozenset], least: int) -> Iterator[tuple[list[int], int]]:
    """All concepts of the branch that extends `intent` by `item`; `rows` are those that hold both."""
    branch = Branch(rows, weights)
    names = branch.items.tolist()

    def closed(own: np.ndarray) -> tuple[frozenset, list[tuple[int, int]], int]:
        """The closure of some rows, and the other items with enough weight, by name and place."""
        counts, size = branch.counts(own), int(weights[own].sum())
        whole = frozenset(branch.items[counts == size].tolist())
        more = np.flatnonzero((counts >= least) & (counts < size))
        return whole, [(names[k], k) for k in more.tolist()], size

    def canonical(new: frozenset, old: frozenset, j: int) -> bool:
        return {x for x in new if x < j} == {x for x in old if x < j}

    own = np.arange(len(rows))
    whole, more, size = closed(own)
    if size < least or not canonical(whole, frozenset(intent), item):
        return
    stack = [(own, whole, more, size, item, failed)]
    while stack:
        own, whole, more, size, last, failed = stack.pop()
        yield sorted(whole), size
        failed, children = dict(failed), []
        for j, k in more:
            if j <= last or any(x < j and x not in whole for x in failed.get(j, ())):
                continue
            part = np.intersect1d(own, branch.holders[k], assume_unique=True)
            new, below, n = closed(part)
            if canonical(new, whole, j):
                children.append((part, new, below, n, j, failed))
            else:
                failed[j] = new
        stack.extend(children)


def _seeds(least: int):
    """Walks the branches of a sorted stream of (node, kind, items, weight) rows: 0 the node itself, 1 failed tests, 2 its rows."""

    def results(node: list[int] | None, seen: list[tuple[int, list[int], int]]) -> Iterator[tuple[list[int], int]]:
        if not node:
            return
        intent, item = next((i, w) for kind, i, w in seen if kind == 0)
        failed = {w: frozenset(i) for kind, i, w in seen if kind == 1}
        rows = [np.array(i, np.int32) for kind, i, w in seen if kind == 2]
        weights = np.array([w for kind, i, w in seen if kind == 2], np.int64)
        if rows:
            yield from walk(rows, weights, intent, item, failed, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, seen, out = None, [], []

        def packed() -> pa.RecordBatch:
            sets, sizes = [s for s, _ in out], [n for _, n in out]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int32())), pa.array(sizes, pa.int64())], names=["items", "support"])

        for batch in batches:
            for at, kind, items, weight in zip(*(c.to_pylist() for c in batch.columns)):
                if at != node:
                    for found in results(node, seen):
                        out.append(found)
                        if len(out) >= 4096:
                            yield packed()
                    node, seen = at, []
                seen.append((kind, items, weight))
        for found in results(node, seen):
            out.append(found)
            if len(out) >= 4096:
                yield packed()
        yield packed()

    return run


def _before(items: Column, j: Column) -> Column:
    return F.filter(items, lambda x: x < j)


def _tested(ext: DataFrame, big: DataFrame, least: int) -> DataFrame:
    """The nodes with their closure `whole`, the items behind them `more`, and whether they are canonical."""
    counts = ext.join(big.select("node"), "node", "left_semi").select("node", F.explode("items").alias("x"), "weight")
    counts = counts.groupBy("node", "x").agg(F.sum("weight").alias("n")).where(F.col("n") >= least)
    known = counts.join(big.select("node", "item", "support"), "node")
    inside = F.col("n") == F.col("support")
    found = known.groupBy("node").agg(
        F.sort_array(F.collect_list(F.when(inside, F.col("x")))).alias("whole"),
        F.collect_list(F.when(~inside & (F.col("x") > F.col("item")), F.struct("x", "n"))).alias("more"),
    )
    found = found.join(big, "node")
    return found.withColumn("canonical", _before(F.col("whole"), F.col("item")) == _before(F.col("intent"), F.col("item")))


NODE = "node array<int>, parent array<int>, intent array<int>, item int, support bigint"
FAILED = "parent array<int>, failed array<struct<item: int, whole: array<int>>>"
CONCEPT = "items array<int>, support bigint"


def concepts(rows: DataFrame, singles: DataFrame, baskets: int, least: int, save: Scratch, task_rows: int = 0) -> DataFrame:
    """`items` (ranks, ascending) and `support` of every concept with at least one item.

    `rows` has `items` and `weight`, `singles` has `rank` and `support`.
    """
    spark, task_rows = rows.sparkSession, task_rows or TASK_ROWS
    everywhere = sorted(r[0] for r in singles.where(F.col("support") == baskets).select("rank").collect())
    root = F.array(*[F.lit(x) for x in everywhere]).cast("array<int>")
    done = [spark.createDataFrame([(everywhere, baskets)] if everywhere else [], CONCEPT)]
    nodes = singles.where(F.col("support") < baskets).select(
        F.concat(root, F.array("rank")).alias("node"), root.alias("parent"), root.alias("intent"), F.col("rank").alias("item"), "support"
    )
    failed = spark.createDataFrame([], FAILED)
    ext = rows.select(F.explode("items").alias("item"), "items", "weight").join(nodes.select("item", "node"), "item").select("node", "items", "weight")
    streams = []
    for _ in range(1 << 16):
        sizes = ext.groupBy("node").agg(F.count("*").alias("rows"))
        sized = save(nodes.join(sizes, "node"))
        big, small = sized.where(F.col("rows") > task_rows).drop("rows"), sized.where(F.col("rows") <= task_rows)
        tests = save(_tested(ext, big, least)) if big.head(1) else None
        if tests is not None:
            fresh = tests.where(~F.col("canonical")).groupBy("parent").agg(F.collect_list(F.struct("item", "whole")).alias("fresh"))
            failed = save(_added(failed, fresh))
        streams += [
            small.select("node", F.lit(0).alias("kind"), F.col("intent").alias("items"), F.col("item").cast("long").alias("weight")),
            small.select("node", "parent").join(failed, "parent").select("node", F.explode("failed").alias("f"))
            .select("node", F.lit(1).alias("kind"), F.col("f.whole").alias("items"), F.col("f.item").cast("long").alias("weight")),
            ext.join(small.select("node"), "node", "left_semi").select("node", F.lit(2).alias("kind"), "items", "weight"),
        ]
        if tests is None:
            break
        good = tests.where("canonical")
        done.append(good.select(F.col("whole").alias("items"), "support"))
        # what failed beside a node, or above it, holds for its children too
        passed = good.select("node", "parent").join(failed, "parent").select(F.col("node").alias("parent"), "failed")
        kids = good.select("node", "whole", F.explode("more").alias("m")).select(F.col("node").alias("parent"), "whole", F.col("m.x").alias("x"), F.col("m.n").alias("n"))
        kids = kids.join(passed, "parent", "left")
        lost = F.exists("failed", lambda f: (f["item"] == F.col("x")) & F.exists(f["whole"], lambda y: (y < F.col("x")) & ~F.array_contains(F.col("whole"), y)))
        kids = kids.where(~F.coalesce(lost, F.lit(False)))
        nodes = save(
            kids.select(F.concat("whole", F.array("x")).alias("node"), "parent", F.col("whole").alias("intent"), F.col("x").alias("item"), F.col("n").alias("support"))
        )
        failed = save(passed)
        links = nodes.select(F.col("parent").alias("at"), "item", F.col("node").alias("child"))
        inner = ext.select(F.col("node").alias("at"), "items", "weight", F.explode("items").alias("item"))
        ext = save(inner.join(links, ["at", "item"]).select(F.col("child").alias("node"), "items", "weight"))
    else:
        raise RuntimeError("the breadth phase did not end")
    dealt = streams[0]
    for s in streams[1:]:
        dealt = dealt.unionByName(s)
    dealt = dealt.repartition("node").sortWithinPartitions("node", "kind")
    for table in done[1:]:
        done[0] = done[0].unionByName(table)
    return done[0].unionByName(dealt.mapInArrow(_seeds(least), CONCEPT))


def _added(failed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Failed tests with new ones of the same parent; the new one of an item replaces the old one."""
    both = failed.join(fresh, "parent", "full")
    new = F.coalesce("fresh", F.expr("array()"))
    old = F.filter(F.coalesce("failed", F.expr("array()")), lambda f: ~F.exists(new, lambda g: g["item"] == f["item"]))
    return both.select("parent", F.when(F.col("fresh").isNull(), F.col("failed")).when(F.col("failed").isNull(), F.col("fresh")).otherwise(F.concat(old, new)).alias("failed"))


def with_rules(closed: DataFrame, singles: DataFrame, baskets: int, confidence: int = CONFIDENCE) -> DataFrame:
    """Each concept with its rules: `rules` has (item, rest, own): the item taken out, the support of the rest, that of the item.

    `closed` has `items` (ranks) and `support`, `singles` has `rank`, `item` and `support`.
    """
    taken = closed.where(F.size("items") > 1).select(F.col("items").alias("whole"), "support", F.explode("items").alias("rank"))
    taken = taken.withColumn("left", F.array_remove("whole", F.col("rank")))
    alone = singles.select(F.array("rank").alias("left"), F.col("support").alias("rest"))
    wider = closed.where(F.size("items") > 1).select(F.col("items").alias("left"), F.col("support").alias("rest"))
    exact = alone.unionByName(wider)
    open_ = taken.where(F.size("left") > 1).select("left").distinct().join(exact.select("left"), "left", "left_anti")
    above = closed.select("items", F.col("support").alias("n"), F.explode("items").alias("first"))
    within = open_.withColumn("first", F.col("left")[0]).join(above, "first").where(F.size(F.array_except("left", "items")) == 0)
    known = exact.unionByName(within.groupBy("left").agg(F.max("n").alias("rest")))
    rated = taken.join(known, "left").join(singles.select("rank", "item", F.col("support").alias("own")), "rank")
    kept = rated.where(
        (F.lit(100) * F.col("support") >= F.lit(confidence) * F.col("rest")) & (F.col("support") * F.lit(baskets) > F.col("rest") * F.col("own"))
    )
    rules = kept.groupBy("whole").agg(F.sort_array(F.collect_list(F.struct("item", "rest", "own"))).alias("rules"))
    return closed.join(rules, closed["items"] == rules["whole"], "left").select("items", "support", "rules")


def closed_itemsets(
    lines: DataFrame, basket_col: str, item_col: str, least: int = LEAST, share: int = SHARE, confidence: int = CONFIDENCE, task_rows: int = 0
) -> DataFrame:
    """`items` (whole numbers, ascending), `support` and `rules` of every closed itemset that is frequent.

    `rules` has (item, rest, own), ascending, of the rules "rest of the set, so item", with the supports of both sides; null where there are none.
    """
    spark = lines.sparkSession
    pairs = lines.select(col(basket_col).alias("basket"), col(item_col).cast("long").alias("item")).where("basket is not null and item is not null")
    baskets = pairs.select("basket").distinct().count()
    least = max(least, -(-baskets // share))
    with Scratch(spark) as save:
        supports = pairs.distinct().groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= least)
        # as many rows as there are frequent items: at most share * mean basket size
        singles = save(supports.select((F.row_number().over(Window.orderBy("support", "item")) - 1).alias("rank"), "item", "support"))
        held = pairs.join(singles.select("item", "rank"), "item").select("basket", "rank").distinct()
        rows = held.groupBy("basket").agg(F.sort_array(F.collect_list("rank")).alias("items")).groupBy("items").agg(F.count("*").alias("weight"))
        closed = save(concepts(save(rows), singles, baskets, least, save, task_rows))
        ruled = with_rules(closed, singles, baskets, confidence).withColumn("id", F.monotonically_increasing_id())
        ruled = save(ruled)
        names = ruled.select("id", F.explode("items").alias("rank")).join(singles.select("rank", "item"), "rank")
        names = names.groupBy("id").agg(F.sort_array(F.collect_list("item")).alias("items"))
        return save.keep(ruled.drop("items").join(names, "id").select("items", "support", "rules"))


def op12_closed_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed frequent itemsets of the sales' items, with their rules."""
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet").where("flag is distinct from 'returned'")
    found = closed_itemsets(lines, "sale_id", "item_id")
    rules = F.coalesce("rules", F.expr("cast(array() as array<struct<item: bigint, rest: bigint, own: bigint>>)"))
    best = F.array_min(F.transform(rules, lambda r: F.struct(r["rest"], r["item"])))["item"]
    said = F.array_join(F.transform(rules, lambda r: F.concat_ws(":", r["item"], r["rest"], r["own"])), ";")
    return found.select(
        F.array_join("items", ",").alias("items"),
        F.size("items").cast("long").alias("n_items"),
        "support",
        F.size(rules).cast("long").alias("n_rules"),
        best.alias("best_item"),
        F.sha2(said, 256).alias("rules_sha256"),
    )


#: All frequent itemsets level by level, with their baskets; closed are those whose extensions by one item have less support.
OP12_SQL = """
with recursive
lines as (select distinct sale_id, item_id from sale_lines where flag is distinct from 'returned' and sale_id is not null and item_id is not null),
total as (select count(distinct sale_id) as b from lines),
single as (
    select item_id, count(*) as n, list(sale_id) as held from lines group by item_id
    having count(*) >= 8 and count(*) * 2000 >= (select b from total)
),
sets as (
    select [item_id] as items, n, held, item_id as last from single
    union all
    select items, len(held) as n, held, last from (
        select list_append(s.items, x.item_id) as items, list_intersect(s.held, x.held) as held, x.item_id as last
        from sets s join single x on x.item_id > s.last
    ) where len(held) >= 8 and len(held) * 2000 >= (select b from total)
),
every as (select items, n from sets),
below as (
    select w.items as whole, w.n as n, unnest(w.items) as c, w.items as i from every w where len(w.items) > 1
),
parts as (select whole, n, c, list_filter(i, lambda x: x <> c) as rest from below),
rated as (select p.whole, p.n, p.c, p.rest, r.n as a, s.n as s from parts p join every r on r.items = p.rest join single s on s.item_id = p.c),
open as (select distinct rest from rated where n = a),
rules as (
    select whole, c, a, s from rated, total where 100 * n >= 10 * a and n * b > a * s
),
told as (
    select whole, count(*) as n_rules, arg_min(c, [a, c]) as best_item, string_agg(c || ':' || a || ':' || s, ';' order by c) as said
    from rules group by whole
)
select array_to_string(e.items, ',') as items, cast(len(e.items) as bigint) as n_items, cast(e.n as bigint) as support,
    cast(coalesce(t.n_rules, 0) as bigint) as n_rules, t.best_item, sha256(coalesce(t.said, '')) as rules_sha256
from every e left join told t on t.whole = e.items
where e.items not in (select rest from open)
"""
