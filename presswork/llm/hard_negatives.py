"""Hard negatives for anchors, by a dual-tree search over integer vectors.

For each anchor: its best rows of the same label (*positives*), and for each of those the best
rows of another label whose score lies between two shares of the positive's (*hard negatives*).
A score is the inner product; ties go to the smaller id.

**Trees.** Hyperplane splits, fitted on a sample of about `SAMPLE` rows, deal all rows into at most
`MOST_REGIONS` regions; a region is cut into bundles of about `BUNDLE` rows (anchors: `ANCHORS`), and a
bundle into leaves of neighbours. Regions, bundles and leaves are balls: a centre and a
radius. The sample shapes the trees only; every row is in them, and the result is exact.

**Search.** The inner products of two balls lie within `|a| s + |b| r + r s` of that of their centres `a`, `b` (radii
`r`, `s`). A pair of nodes goes no further where that interval lies below what all anchors of
the one have found already, or above what any of them may take; so whole groups of anchors are
put aside at once: against a region, then a bundle, then a leaf. Pairs of leaves that are left are scored exactly.
Each search has two rounds: bundles of the anchors' own regions first, so that there is something to
measure by, then what the intervals leave of the others.

**Spark.** A task holds one bundle of rows and streams the bundles of anchors that have to meet it; what goes to
each meeting is a bundle of anchors, never more than `ANCHORS` rows, and what comes back are the best few for
each anchor. Only the regions' balls, no more than `MOST_REGIONS`, are sent to all tasks. A vector that a third of the rows share fills
many bundles. No pair of rows is ever a row of a table.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Shorter vectors
end in zeros. Repeated rows are rows of their own, repeated anchors are one anchor; rows with the anchor's id are
neither positives nor negatives of it. A positive with fewer negatives has fewer rows; one without any, as where its score is
negative, has none. Empty tables give empty results. Extra columns are not read. Scores must fit into 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, col

SAMPLE, MOST_REGIONS = 32_768, 1024
BUNDLE, ANCHORS = 4096, 256
LEAF, ANCHOR_LEAF = 64, 32
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is at least this and at most that many hundredths of the positive's.
LOWEST, HIGHEST = 30, 90
SCALE = 256

PLACED = "id bigint, label bigint, anchor boolean, q binary, region int, far double"
PACKED = "bundle bigint, region int, n int, centre binary, radius double, ids binary, labels binary, q binary, leaves binary"
FOUND = "bundle bigint, slot int, r int, id bigint, score bigint"


def vectors(df: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column) -> DataFrame:
    """`id`, `label`, `anchor` and the scaled whole-number vector `v` of the rows that take part."""
    v = col(vector_col)
    rows = df.select(col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), v.cast("array<double>").alias("x"))
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(~odd)
    return rows.select("id", "label", "anchor", F.transform("x", lambda c: F.floor(c * F.lit(float(SCALE)))).alias("v"))


class Regions:
    """Hyperplane splits fitted on a sample: a heap of directions and thresholds."""

    def __init__(self, sample: np.ndarray, rows: int, dims: int):
        depth = 0
        while 1 << depth < min(MOST_REGIONS, rows / BUNDLE) and len(sample) >> depth > 16:
            depth += 1
        self.depth, self.dims = depth, dims
        self.ways, self.cuts = np.zeros(((1 << depth) - 1, dims)), np.zeros((1 << depth) - 1)
        at = np.zeros(len(sample), np.int64)
        for node in range((1 << depth) - 1):
            own = sample[at == node]
            if len(own):
                far = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]
                self.ways[node] = far - own[np.argmax(((own - far) ** 2).sum(1))]
                self.cuts[node] = np.median(own @ self.ways[node])
            inside = at == node
            at[inside] = 2 * node + 1 + (sample[inside] @ self.ways[node] > self.cuts[node])
        place = at - len(self.ways)
        self.centres = np.array([sample[place == k].mean(0) if (place == k).any() else np.zeros(dims) for k in range(1 << depth)])

    def of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (np.einsum("ij,ij->i", x, self.ways[at]) > self.cuts[at])
        return (at - len(self.ways)).astype(np.int32)


def matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Lists as rows of a matrix; shorter ones end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def packed(q: np.ndarray) -> bytes:
    small = bool(len(q) == 0 or (q.min() >= -32768 and q.max() <= 32767))
    return (b"\x02" + q.astype("<i2").tobytes()) if small else (b"\x08" + q.astype("<i8").tobytes())


def unpacked(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(-1, dims).astype(np.int64)


def _place(regions: Regions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column("v"), regions.dims)
            where = regions.of(q.astype(float))
            far = np.sqrt(((q - regions.centres[where]) ** 2).sum(1)) if len(q) else np.zeros(0)
            data = pa.array([packed(r[None]) for r in q], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), b.column("anchor"), data, pa.array(where), pa.array(far)], names=["id", "label", "anchor", "q", "region", "far"]
            )

    return run


def _pack(dims: int, leaf: int):
    """A group of rows as one row, its members in the order of leaves."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        q = np.concatenate([unpacked(x, dims) for x in rows.column("q").to_pylist()])
        parts, leaves = [np.arange(len(q))], []
        while parts:
            part = parts.pop()
            if len(part) <= leaf:
                leaves.append(part)
                continue
            d = int(np.argmax(q[part].var(0)))
            order = part[np.argsort(q[part, d], kind="stable")]
            parts += [order[len(order) // 2 :], order[: len(order) // 2]]
        order = np.concatenate(leaves)
        q = q[order]
        centre = q.mean(0)
        one = {
            "bundle": rows.column("bundle")[0].as_py(),
            "region": rows.column("region")[0].as_py(),
            "n": len(q),
            "centre": centre.tobytes(),
            "radius": float(np.sqrt(((q - centre) ** 2).sum(1).max())),
            "ids": rows.column("id").to_numpy()[order].astype("<i8").tobytes(),
            "labels": rows.column("label").to_numpy()[order].astype("<i8").tobytes(),
            "q": packed(q),
            "leaves": np.array([len(x) for x in leaves], "<i4").tobytes(),
        }
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([v], k) for v, k in zip(one.values(), kinds)], names=list(one))

    return run


def bundles(placed: DataFrame, dims: int, size: int, leaf: int) -> DataFrame:
    """The rows of each region in bundles of about `size`."""
    counts = placed.groupBy("region").agg(F.count("*").alias("of"))
    parts = placed.join(F.broadcast(counts), "region")  # one row for each of at most MOST_REGIONS regions
    parts = parts.withColumn("part", F.expr(f"pmod(monotonically_increasing_id(), ceil(of / {size}))"))
    parts = parts.select(F.expr("shiftleft(cast(part as bigint), 12) + region").alias("bundle"), "region", "id", "label", "q")
    return parts.groupBy("bundle").applyInArrow(_pack(dims, leaf), PACKED)


def interval(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of members of every ball of `a` with members of every ball of `b`."""
    mid = a @ b.T
    wide = np.linalg.norm(a, axis=1)[:, None] * rb + ra[:, None] * np.linalg.norm(b, axis=1) + ra[:, None] * rb
    wide = wide * (1 + 1e-9) + 1e-9 * np.abs(mid) + 1e-3
    return mid - wide, mid + wide


class Bundle:
    """A bundle as arrays, with the balls of its leaves."""

    def __init__(self, ids: bytes, labels: bytes, q: bytes, leaves: bytes, dims: int):
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.q = unpacked(q, dims)
        self.sizes = np.frombuffer(leaves, "<i4").astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.x = self.q.astype(float)
        self.most = int(np.abs(self.q).max(initial=0))
        self.centres = np.add.reduceat(self.x, self.starts) / self.sizes[:, None]
        apart = ((self.x - np.repeat(self.centres, self.sizes, 0)) ** 2).sum(1)
        self.radii = np.sqrt(np.maximum.reduceat(apart, self.starts))

    def scores(self, other: Bundle, own: slice, rows: np.ndarray) -> np.ndarray:
        """Exact inner products; in doubles where no sum can leave their whole numbers."""
        if self.most * other.most * self.q.shape[1] < 1 << 53:
            return (self.x[own] @ other.x[rows].T).astype(np.int64)
        return self.q[own] @ other.q[rows].T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by smaller id."""
    at = np.arange(len(scores))
    if len(at) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _meet(rows: Bundle, anchors: Bundle, bounds: np.ndarray, same: bool, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each anchor and each of its windows the k best rows.

    `bounds` has, for each anchor and window, the least score worth having and the largest one allowed.
    """
    need = np.minimum.reduceat(bounds[:, :, 0].min(1), anchors.starts)
    most = np.maximum.reduceat(bounds[:, :, 1].max(1), anchors.starts)
    low, high = interval(anchors.centres, anchors.radii, rows.centres, rows.radii)
    left = (high >= need[:, None]) & (low <= most[:, None])
    for leaf in np.flatnonzero(left.any(1)).tolist():
        own = slice(int(anchors.starts[leaf]), int(anchors.starts[leaf] + anchors.sizes[leaf]))
        at = np.flatnonzero(np.repeat(left[leaf], rows.sizes))
        ids, labels, scores = rows.ids[at], rows.labels[at], anchors.scores(rows, own, at)
        for slot in range(own.start, own.stop):
            mine = scores[slot - own.start]
            fit = ((labels == anchors.labels[slot]) == same) & (ids != anchors.ids[slot])
            for r in range(bounds.shape[1]):
                least, limit = bounds[slot, r]
                if least <= limit:
                    inside = np.flatnonzero(fit & (mine >= least) & (mine <= limit))
                    if len(inside):
                        top = inside[best(mine[inside], ids[inside], k)]
                        yield slot, r, ids[top], mine[top]


def _search(dims: int, same: bool, k: int):
    """Streams (bundle of rows, then bundles of anchors), sorted so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = now = None
        for batch in batches:
            out = [[], [], [], [], []]
            for one in batch.to_pylist():
                block = Bundle(one["ids"], one["labels"], one["q"], one["leaves"], dims)
                if one["kind"] == 0:
                    rows, now = block, one["meets"]
                elif now == one["meets"]:
                    bounds = np.frombuffer(one["bounds"], "<i8").reshape(len(block.ids), -1, 2)
                    for slot, r, ids, scores in _meet(rows, block, bounds, same, k):
                        for column, v in zip(out, ([one["bundle"]] * len(ids), [slot] * len(ids), [r] * len(ids), ids.tolist(), scores.tolist())):
                            column.extend(v)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=["bundle", "slot", "r", "id", "score"])

    return run


LEAST_LONG, MOST_LONG = -(2**63), 2**63 - 1


def _bounds(windows: int):
    """Bounds of all anchors of a bundle as one row, with the least and the largest of them."""

    def run(rows: pa.Table) -> pa.Table:
        n = rows.column("n")[0].as_py()
        made = np.full((n, windows, 2), [MOST_LONG, LEAST_LONG], "<i8")
        slots, r = rows.column("slot").to_numpy(), rows.column("r").to_numpy()
        made[slots, r, 0], made[slots, r, 1] = rows.column("least").to_numpy(), rows.column("most").to_numpy()
        live = made[made[:, :, 0] <= made[:, :, 1]]
        low, high = (int(live[:, 0].min()), int(live[:, 1].max())) if len(live) else (MOST_LONG, LEAST_LONG)
        return pa.table([pa.array([v], t) for v, t in ((rows.column("bundle")[0].as_py(), pa.int64()), (made.tobytes(), pa.binary()), (float(low), pa.float64()), (float(high), pa.float64()))], names=["bundle", "bounds", "need", "most"])

    return run


def _near(regions: Regions, radii: dict[int, float]):
    """Bundles of anchors with the regions that they have to look into."""
    known = np.array(sorted(radii), np.int64)
    centres, far = regions.centres[known], np.array([radii[k] for k in known.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], []]
            for one in b.to_pylist():
                low, high = interval(np.frombuffer(one["centre"])[None], np.array([one["radius"]]), centres, far)
                for k in known[(high[0] >= one["need"]) & (low[0] <= one["most"])].tolist():
                    if k != one["region"]:
                        out[0].append(one["bundle"])
                        out[1].append(k)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32())], names=["bundle", "region"])

    return run


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of bundles whose interval meets what the anchors need."""
    for b in batches:
        keep = []
        for one in b.to_pylist():
            balls = [(np.frombuffer(one[c])[None], np.array([one[r]])) for c, r in (("centre", "radius"), ("other", "wide"))]
            low, high = interval(*balls[0], *balls[1])
            keep.append(bool(high[0, 0] >= one["need"] and low[0, 0] <= one["most"]))
        yield b.select(["bundle", "meets"]).filter(pa.array(keep, pa.bool_()))


class Search:
    """The two trees, and searches over them."""

    def __init__(self, rows: DataFrame, save: Scratch):
        self.save = save
        shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
        self.dims = max(1, shape.d or 1)
        every = max(1, shape.n // SAMPLE)
        sample = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(every)) == 0).select("v").limit(2 * SAMPLE).toArrow()
        points = matrix(sample.column("v").combine_chunks(), self.dims).astype(float) if len(sample) else np.zeros((0, self.dims))
        self.regions = Regions(points, shape.n, self.dims)
        placed = save(rows.mapInArrow(_place(self.regions), PLACED))
        self.radii = {r.region: r.far for r in placed.groupBy("region").agg(F.max("far").alias("far")).collect()}
        self.rows = save(bundles(placed, self.dims, BUNDLE, LEAF))
        asked = save(placed.where("anchor").dropDuplicates(["id", "label", "q"]))
        self.anchors = save(bundles(asked, self.dims, ANCHORS, ANCHOR_LEAF))

    def round(self, limits: DataFrame, windows: int, same: bool, k: int, home: bool) -> DataFrame:
        """The best rows of each (bundle, slot, r) of `limits` (with `least`, `most`): at home, or anywhere else."""
        bounds = limits.join(self.anchors.select("bundle", "n"), "bundle").groupBy("bundle").applyInArrow(
            _bounds(windows), "bundle bigint, bounds binary, need double, most double"
        )
        asking = self.save(self.anchors.join(bounds, "bundle"))
        rows = self.rows.select(F.col("bundle").alias("meets"), "region", F.col("centre").alias("other"), F.col("radius").alias("wide"))
        if home:
            pairs = asking.select("bundle", "region").join(rows.select("meets", "region"), "region").select("bundle", "meets")
        else:
            ball = asking.select("bundle", "region", "centre", "radius", "need", "most")
            looks = ball.mapInArrow(_near(self.regions, self.radii), "bundle bigint, region int")
            both = looks.join(rows, "region").drop("region").join(ball.drop("region"), "bundle")
            pairs = both.mapInArrow(_close, "bundle bigint, meets bigint")
        pairs = self.save(pairs)
        parts = "ids", "labels", "q", "leaves"
        held = self.rows.join(pairs.select(F.col("meets").alias("bundle")).distinct(), "bundle", "left_semi")
        held = held.select(F.col("bundle").alias("meets"), F.lit(0).alias("kind"), "bundle", *parts, F.lit(None).cast("binary").alias("bounds"))
        sent = pairs.join(asking.select("bundle", *parts, "bounds"), "bundle").select("meets", F.lit(1).alias("kind"), "bundle", *parts, "bounds")
        dealt = held.unionByName(sent).repartition("meets").sortWithinPartitions("meets", "kind")
        return self.save(dealt.mapInArrow(_search(self.dims, same, k), FOUND))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("bundle", "slot", "r").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """`anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`, `negative_score`.

    `rows` is what `vectors` gives.
    """
    with Scratch(rows.sparkSession) as save:
        search = Search(rows, save)
        members = search.anchors.select("bundle", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"))
        wide = members.select("bundle", "slot", F.lit(0).alias("r"), F.lit(LEAST_LONG).alias("least"), F.lit(MOST_LONG).alias("most"))
        home = search.round(wide, 1, True, positives, True)
        last = _best(home, positives).where(F.col("rank") == positives).select("bundle", "slot", F.col("score").alias("last"))
        # a score as good as the last one may win by its id
        above = wide.join(last, ["bundle", "slot"], "left").withColumn("least", F.coalesce("last", "least")).drop("last")
        away = search.round(above, 1, True, positives, False)
        liked = save(_best(home.unionByName(away), positives))
        liked_at = liked.select("bundle", "slot", (F.col("rank") - 1).alias("r"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        # a window below zero would be empty; for others `div` cuts down
        limits = liked_at.where("positive_score >= 0").select(
            "bundle", "slot", "r", F.expr(f"({lowest} * positive_score + 99) div 100").alias("least"), F.expr(f"({highest} * positive_score) div 100").alias("most")
        )
        home = search.round(limits, positives, False, negatives, True)
        last = _best(home, negatives).where(F.col("rank") == negatives).select("bundle", "slot", "r", F.col("score").alias("last"))
        above = limits.join(last, ["bundle", "slot", "r"], "left").withColumn("least", F.coalesce("last", "least")).drop("last")
        away = search.round(above, positives, False, negatives, False)
        hard = _best(home.unionByName(away), negatives)
        ids = search.anchors.select("bundle", "ids").mapInArrow(_ids, "bundle bigint, slot int, anchor_id bigint")
        made = hard.join(liked_at, ["bundle", "slot", "r"]).join(ids, ["bundle", "slot"])
        return save.keep(
            made.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        )


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for bundle, data in zip(*(c.to_pylist() for c in b.columns)):
            ids = np.frombuffer(data, "<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array([bundle] * len(ids), pa.int64()), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], names=["bundle", "slot", "anchor_id"]
            )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings; anchors are rows whose id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors(rows, "vec_id", "embedding", label, F.col("vec_id") % 100 == 0))


OP13_SQL = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
    select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_inner_product(a.q, b.q) as bigint) as score
    from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
),
positive as (
    select anchor_id, id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
),
negative as (
    select p.anchor_id, p.positive_id, s.id as negative_id, p.positive_score, s.score as negative_score,
        row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id) as rank
    from positive p join scored s on s.anchor_id = p.anchor_id and not s.same
        and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from negative where rank <= 10
"""
