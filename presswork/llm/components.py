"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch

MAX_ROUNDS = 60


def components(edges: DataFrame, store: Scratch | None = None) -> DataFrame:
    """`node`, `root` for every node of the edges `u`, `v`; the root is the smallest node of its component.

    Each round hangs the larger neighbours of a node on its smallest neighbour, then
    does the same with the smaller ones; only minima and the edges themselves are
    shuffled, so a node with very many edges is pre-aggregated or split like any other
    key. Every round is cut off by a written table, and the tables of the round before
    are deleted. Null ends and loops are ignored, but a node that has only loops keeps
    itself as root. An empty table gives an empty table. Without `store` the result stays for good.
    """
    keep = store.__call__ if store else Scratch(edges.sparkSession).keep
    with Scratch(edges.sparkSession) as save:
        known = save(edges.where("u is not null and v is not null"))
        apart = known.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now, mark = _marked(apart.distinct(), save)
        for _ in range(MAX_ROUNDS):
            if not mark[0]:
                break
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = save(large.distinct())
            save.drop(now)
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            was = mark
            now, mark = _marked(small.distinct(), save)
            save.drop(large)
            if was == mark:
                break
        else:
            raise RuntimeError("components did not settle")
        roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
        alone = known.where("u = v").select(F.col("u").alias("node")).distinct()
        tops = now.select(F.col("v").alias("node")).distinct().unionByName(alone).distinct().join(
            roots.select("node"), "node", "left_anti"
        )
        return keep(roots.unionByName(tops.select("node", F.col("node").alias("root"))))


def _marked(edges: DataFrame, save: Scratch) -> tuple[DataFrame, tuple[int, int]]:
    """The edges as a table, with their number and a hash of them all, taken while they are written."""
    seen = Observation()
    counted = edges.observe(seen, F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x"))
    table = save(counted)
    return table, (seen.get["n"], seen.get["x"])
