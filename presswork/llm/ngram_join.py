"""N-gram Jaccard self-join by T-occurrence search.

Which documents can be linked is settled on short inverted lists, whether they are
is settled by counting occurrences in all lists of a small group:

1. A pass over the texts hashes each document's distinct 5-word shingles, keeps its
   size and a 128-bit signature of the set (equal sets are one class from here on),
   and adds the shingles up in a table of 2^18 counters. That table, of fixed size,
   gives all shingles one global order, rare ones first.
2. A class whose size is n must share at least T = ceil(0.75 n) shingles with any
   partner, so it can ignore its T - k most frequent ones and still meets each
   partner at least k times. The rest, its short lists, go to the inverted lists.
   Lists of up to `SHORT_LIST` members give pairs, which are counted; a pair stays
   if it meets as often as both sizes demand. Longer lists only tie their members
   together, and only members that have enough of such lists.
3. Components of these ties are groups: no link leaves a group. Each class goes once
   to its group, with all its shingles. Inside a group sets ask for their partners
   one after another by DivideSkip: a heap merges the query's short inverted lists and
   skips what can't reach T - L, the L longest ones are probed by binary search. A set
   that was reached is not looked for again, so a group of near copies costs about one
   query over its lists, not one for each member. A group of many sets or shingles is
   dealt to blocks, and every two blocks of it meet in a task, so that a task's memory
   and work have a bound whatever the size of the group.
4. Components of the links are the result. A task writes the links of a spanning
   forest only, so a group of copies gives as many as it has members.

The counters of step 1 and the filters have a fixed size. Where far more shingles than
counters exist, rare ones share theirs, and only frequent shingles still stand out from
the rest: that is what the order is for. A full filter lets all classes through to the
join behind it. Both change the time, never the result.

A null or empty text, or one without words, has no shingles and is linked with
nothing; its component is its own id. Fewer than five words make one shingle of
all words. Every row is judged by its own text, also where rows share an id; a component
is named by the smallest id of its rows. A null id has a link like any other and never names a component;
its own component is null if it is alone. Extra columns are not read, texts are read whole, nothing is capped.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SMALL_BATCHES, TIDY, UPPER, Marks, Scratch, col, documents, fresh, map_text, save, settings, slices
from .components import components

SHINGLE = 5
SKETCH_BITS = 18
SHORT_LIST = 24
#: A group of more sets or shingles is dealt to several blocks, up to `SPREAD` of them for the sake of its sets alone.
BLOCK_SHINGLES = 500_000
BLOCK_SETS = 256
SPREAD = 8
#: Weighs the probes of a long list against merging it.
MU = 0.0085

_U = np.uint64
#: A-Z become a-z, white space becomes a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Hasher:
    """Words and shingles of many texts at once, as numbers; one per Python worker."""

    _one: Hasher | None = None

    def __init__(self):
        draw = np.random.Generator(np.random.PCG64(71))
        self.bytes = [draw.integers(1, 2**63, 256, np.uint64) * _U(2) + _U(1) for _ in range(2)]
        self.bases = [0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1]
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []
        self._grow(1 << 21)
        self.odd = draw.integers(1, 2**63, SHINGLE, np.uint64) * _U(2) + _U(1)

    @classmethod
    def one(cls) -> Hasher:
        cls._one = cls._one or cls()
        return cls._one

    def _grow(self, size: int) -> None:
        self.size, self.powers = size, []
        for base in self.bases:
            up = np.full(size, base, np.uint64)
            up[0] = 1
            down = np.full(size, pow(base, -1, 2**64), np.uint64)
            down[0] = 1
            self.powers.append((np.multiply.accumulate(up), np.multiply.accumulate(down)))

    def words(self, raw: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, start, end) of the words of some bytes that begin and end with a blank; a code mixes hashes of that many bases."""
        flat = np.frombuffer(_FOLD, np.uint8)[raw]
        if len(flat) > self.size:
            self._grow(len(flat) + (len(flat) >> 1))
        word = flat != 32
        edge = np.diff(word.astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        codes = np.zeros(len(starts), np.uint64)
        for table, (up, down) in zip(self.bytes[:rounds], self.powers):
            total = np.zeros(len(flat) + 1, np.uint64)
            np.cumsum(np.where(word, table[flat] * up[: len(flat)], _U(0)), out=total[1:])
            codes = mix(codes + mix((total[ends] - total[starts]) * down[starts]))
        return codes, starts, ends

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The distinct shingles of each text, sorted."""
        data = [(t or "").encode() for t in texts]
        codes, starts, _ = self.words(np.frombuffer(b" ".join([b"", *data, b""]), np.uint8))
        ends_of = np.cumsum([len(d) + 1 for d in data])
        firsts = np.searchsorted(starts, np.concatenate([[0], ends_of]))
        grams = np.zeros(max(0, len(codes) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            grams = mix(grams + codes[k : k + len(grams)] * self.odd[k])
        out = []
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            if b - a >= SHINGLE:
                out.append(np.unique(grams[a : b - SHINGLE + 1]))
            elif b > a:
                short = np.array([b - a], np.uint64)
                for k in range(b - a):
                    short = mix(short + codes[a + k : a + k + 1] * self.odd[k])
                out.append(mix(short + _U(1)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def signature(grams: np.ndarray) -> bytes:
    """128 bits that tell sets of shingles apart."""
    size = np.array([len(grams)], np.uint64)
    a = mix(grams).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(mix(grams * _U(0xFF51AFD7ED558CCD))) if len(grams) else _U(0)
    return mix(a + size).tobytes() + mix(b ^ size).tobytes()


def short_id(sig: bytes) -> int:
    """The first half; two classes that share it are still told apart when they are compared."""
    return int.from_bytes(sig[:8], "little", signed=True)


def least_overlap(n: int) -> int:
    """Shingles that a class of size n shares with any partner, at least."""
    return -(-3 * n // 4)


def slack(n):
    """k: how often two linked classes meet in short lists, at least."""
    return 1 + n // 12


def profile(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, n, sig, class_id) of documents and rows (bucket, hits) of the counters."""
    source = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, hits = Hasher.one(), np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for at, size in slices(batch.column(1)):
                part = batch.slice(at, size)
                sets = hasher.sets(part.column(1).to_pylist())
                if sets:
                    every = np.concatenate(sets)
                    hits += np.bincount((every >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(hits))
                sigs = [signature(s) for s in sets]
                yield _batch(
                    doc_id=part.column(0),
                    n=pa.array([len(s) for s in sets], pa.int64()),
                    sig=pa.array(sigs, pa.binary()),
                    class_id=pa.array([short_id(x) for x in sigs], pa.int64()),
                    bucket=pa.nulls(len(sets), pa.int32()),
                    hits=pa.nulls(len(sets), pa.int64()),
                )
        used = np.flatnonzero(hits)
        none = len(used)
        yield _batch(
            doc_id=pa.nulls(none, pa.int64()),
            n=pa.nulls(none, pa.int64()),
            sig=pa.nulls(none, pa.binary()),
            class_id=pa.nulls(none, pa.int64()),
            bucket=pa.array(used, pa.int32()),
            hits=pa.array(hits[used], pa.int64()),
        )

    return source.mapInArrow(run, "doc_id long, n long, sig binary, class_id long, bucket int, hits long")


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def postings(docs: DataFrame, text_col: str, counters: np.ndarray) -> DataFrame:
    """(token, class, n): the short lists' share of every class that a task meets, once."""
    shared = docs.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts, seen = Hasher.one(), shared.value, set()
        for batch in batches:
            for at, size in slices(batch.column(0)):
                tokens, owners, sizes = [], [], []
                for grams in hasher.sets(batch.column(0).slice(at, size).to_pylist()):
                    n = len(grams)
                    sig = signature(grams)
                    if not n or sig in seen:
                        continue
                    seen.add(sig)
                    take = n - least_overlap(n) + slack(n)
                    if take < n:
                        often = counts[(grams >> _U(64 - SKETCH_BITS)).astype(np.int64)]
                        grams = grams[np.argsort(often, kind="stable")[:take]]
                    tokens.append(grams)
                    owners.append(np.full(len(grams), short_id(sig), np.int64))
                    sizes.append(np.full(len(grams), n, np.int32))
                if tokens:
                    yield _batch(
                        token=pa.array(np.concatenate(tokens).view(np.int64)),
                        class_id=pa.array(np.concatenate(owners)),
                        n=pa.array(np.concatenate(sizes)),
                    )

    return docs.select(col(text_col).cast("string").alias("text")).mapInArrow(run, "token long, class_id long, n int")


def meetings(lists: DataFrame) -> DataFrame:
    """From postings sorted by token: pairs (a, b, na, nb, met) of short lists, and (a, token as b, na) of long ones.

    A list is held until it is longer than `SHORT_LIST`; from there on its members are passed through.
    """

    def pairs(token: np.ndarray, who: np.ndarray, n: np.ndarray, bounds: np.ndarray, sizes: np.ndarray) -> tuple:
        a, b = [], []
        for size in np.unique(sizes):
            if 2 <= size <= SHORT_LIST:
                at = bounds[sizes == size]
                i, j = np.triu_indices(size, 1)
                a.append((at[:, None] + i).ravel())
                b.append((at[:, None] + j).ravel())
        if not a:
            return (np.zeros(0, np.int64),) * 5
        a, b = np.concatenate(a), np.concatenate(b)
        near = 4 * np.minimum(n[a], n[b]) >= 3 * np.maximum(n[a], n[b])
        a, b = a[near], b[near]
        both = np.stack([who[a], who[b], n[a], n[b]], 1).astype(np.int64)
        if not len(both):
            return (np.zeros(0, np.int64),) * 5
        order = np.lexsort((both[:, 1], both[:, 0]))
        both = both[order]
        new = np.concatenate([[True], (both[1:] != both[:-1]).any(1)])
        met = np.diff(np.append(np.flatnonzero(new), len(both)))
        return (*both[new].T, met)

    def out(a, b, na, nb, met) -> pa.RecordBatch:
        return _batch(a=pa.array(a), b=pa.array(b), na=pa.array(na), nb=pa.array(nb), met=pa.array(met))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        passing = None  # the token of a long list that goes on

        def work(cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, passing
            token, who, n = cols
            if len(token):  # copies of a class that several tasks have met
                once = np.concatenate([[True], (token[1:] != token[:-1]) | (who[1:] != who[:-1])])
                token, who, n = token[once], who[once], n[once]
            bounds = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(bounds, len(token)))
            long = sizes > SHORT_LIST
            if len(sizes) and passing is not None and token[0] == passing:
                long[0] = True
            held = [np.zeros(0, np.int64)] * 3
            if len(sizes):
                passing = token[-1] if long[-1] else None
                if not last and not long[-1]:
                    held = [x[bounds[-1] :] for x in (token, who, n)]
                    bounds, sizes, long = bounds[:-1], sizes[:-1], long[:-1]
            got = pairs(token, who, n, bounds[~long], sizes[~long])
            if len(got[0]):
                yield out(*got)
            if long.any():
                at = np.concatenate([np.arange(b, b + s) for b, s in zip(bounds[long], sizes[long])])
                nothing = np.zeros(len(at), np.int64)
                yield out(who[at], token[at], n[at], nothing, nothing)

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
            yield from work([np.concatenate([h, x]) for h, x in zip(held, new)], False)
        yield from work(held, True)

    ordered = lists.repartition("token").sortWithinPartitions("token", "class_id")
    return ordered.mapInArrow(run, "a long, b long, na long, nb long, met long")


def ties(met: DataFrame, save: Scratch) -> DataFrame:
    """Edges (u, v) between classes that may be linked, from saved meetings."""
    long = met.where("met = 0").select(F.col("a").alias("class_id"), F.col("b").alias("token"), F.col("na").alias("n"))
    per = long.groupBy("class_id").agg(F.count("*").alias("h"), F.min("n").alias("n"))
    per = save(per)
    # a partner has at least 3/4 of the size, and two linked classes meet as often as the smaller one's slack
    enough = per.where(F.col("h") >= 1 + F.floor(F.floor(F.col("n") * 0.75) / 12)).select("class_id")
    tied = save(long.select("class_id", "token").join(enough, "class_id", "left_semi"))
    leads = save(tied.groupBy("token").agg(F.min("class_id").alias("lead")))
    stars = tied.join(leads, "token").select(F.col("class_id").alias("u"), F.col("lead").alias("v")).distinct()

    pairs = met.where("met > 0").groupBy("a", "b", "na", "nb").agg(F.sum("met").alias("met"))
    ha = per.select(F.col("class_id").alias("a"), F.col("h").alias("ha"))
    hb = per.select(F.col("class_id").alias("b"), F.col("h").alias("hb"))
    pairs = pairs.join(ha, "a", "left").join(hb, "b", "left")

    def may(n: str) -> Column:  # of the first meetings, those that a class of size n sees in its short lists
        return F.expr(f"1 + {n} div 12 + {need} - cast(ceil(3 * {n} / 4) as long)")

    need = "cast(ceil(3 * (na + nb) / 7) as long)"
    most = F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    kept = pairs.where(F.col("met") + most >= F.least(may("na"), may("nb"), F.expr(need)))
    return stars.unionByName(kept.select(F.col("a").alias("u"), F.col("b").alias("v")))


def members(docs: DataFrame, text_col: str, groups: DataFrame) -> DataFrame:
    """(class_id, sig, grams) of classes that are in a group; others may be among them."""
    shared = docs.sparkSession.sparkContext.broadcast(Marks.of(groups, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known, seen = Hasher.one(), shared.value, set()
        for batch in batches:
            for at, size in slices(batch.column(0)):
                got = []
                for grams in hasher.sets(batch.column(0).slice(at, size).to_pylist()):
                    sig = signature(grams)
                    if len(grams) and sig not in seen and short_id(sig) in known:
                        seen.add(sig)
                        got.append((short_id(sig), sig, grams))
                yield _batch(
                    class_id=pa.array([g[0] for g in got], pa.int64()),
                    sig=pa.array([g[1] for g in got], pa.binary()),
                    n=pa.array([len(g[2]) for g in got], pa.int64()),
                    grams=pa.array([g[2].tobytes() for g in got], pa.binary()),
                )

    texts = docs.select(col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "class_id long, sig binary, n long, grams binary")


def merge_skip(lists: list[tuple[list[int], int, int]], least: int) -> Iterator[tuple[int, int]]:
    """(id, count) of the ids that stand in at least `least` of the sorted lists, each from one place up to another; ids rising.

    A heap holds a cursor for each list. Where the smallest id stands in too few lists, the
    `least` - 1 smallest cursors can't bring it up, and all skip to the next cursor's id.
    """
    heap = [(ids[a], k, a) for k, (ids, a, _) in enumerate(lists)]
    heapify(heap)
    while len(heap) >= least:
        top, out = heap[0][0], []
        while heap and heap[0][0] == top:
            out.append(heappop(heap))
        if len(out) >= least:
            yield top, len(out)
            for _, k, a in out:
                ids, _, b = lists[k]
                if a + 1 < b:
                    heappush(heap, (ids[a + 1], k, a + 1))
            continue
        while heap and len(out) < least - 1:
            out.append(heappop(heap))
        if not heap:
            return
        ahead = heap[0][0]
        for _, k, a in out:
            ids, _, b = lists[k]
            a = bisect_left(ids, ahead, a, b)
            if a < b:
                heappush(heap, (ids[a], k, a))


class Lists:
    """The inverted lists of some sets, sets numbered by size. Lists of one set tell nothing and are left out."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = [len(s) for s in sets]
        _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = often > 1
        number, ends = np.cumsum(shared) - 1, np.cumsum(self.size).tolist()
        self.lists: list[list[int]] = [[] for _ in range(int(shared.sum()))]
        self.of: list[list[list[int]]] = []
        for i, end in enumerate(ends):
            mine = token[end - self.size[i] : end]
            mine = [self.lists[t] for t in number[mine[shared[mine]]].tolist()]
            for ids in mine:
                ids.append(i)
            self.of.append(mine)
        self.open = [True] * len(sets)
        self.left = self.indexed = len(sets)

    def close(self, one: int) -> None:
        """Look for a set no more; the lists lose such sets whenever half of them are gone."""
        self.open[one] = False
        self.left -= 1

    def _shorten(self) -> None:
        self.indexed, still = self.left, self.open
        for ids in self.lists:
            ids[:] = [i for i in ids if still[i]]

    def partners(self, q: int) -> Iterator[int]:
        """Sets still looked for that are linked with set q."""
        if 2 * self.left < self.indexed:
            self._shorten()
        n = self.size[q]
        least = -(-3 * n // 4)
        if len(self.of[q]) < least:
            return
        lo, hi = bisect_left(self.size, least), bisect_right(self.size, 4 * n // 3)
        lists = []
        for ids in self.of[q]:
            a, b = bisect_left(ids, lo), bisect_left(ids, hi)
            if a < b:
                lists.append((ids, a, b))
        if len(lists) < least:
            return
        lists.sort(key=lambda x: x[2] - x[1])
        longest = lists[-1][2] - lists[-1][1]
        long = min(least - 1, int(least / (MU * math.log2(longest + 1) + 1)))
        short, probed = lists[: len(lists) - long], lists[len(lists) - long :]
        for one, met in merge_skip(short, least - long):
            if not self.open[one]:
                continue
            missing = -(-3 * (n + self.size[one]) // 7) - met
            rest = long
            for ids, a, b in probed:
                if missing <= 0 or missing > rest:
                    break
                a = bisect_left(ids, one, a, b)
                missing -= a < b and ids[a] == one
                rest -= 1
            if missing <= 0:
                yield one


def forest(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links (i, j) that span the components of some sets of distinct numbers, none of them empty."""
    if len(sets) < 2:
        return
    if len(sets) == 2:  # one merge
        both = np.sort(np.concatenate(sets))
        if 7 * np.count_nonzero(both[1:] == both[:-1]) >= 3 * len(both):
            yield 0, 1
        return
    rank = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    lists = Lists([sets[i] for i in rank])
    for start in range(len(sets)):
        if not lists.open[start]:
            continue
        lists.close(start)
        asking = [start]
        while asking and lists.left:
            q = asking.pop()
            for one in list(lists.partners(q)):
                lists.close(one)
                asking.append(one)
                yield rank[q], rank[one]


def links(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """Links (u, v) of signatures: a spanning forest of what each task finds."""
    spread = groups.groupBy("root").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
    by_sets = F.least(F.ceil(F.col("m") / BLOCK_SETS), F.lit(SPREAD))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_SHINGLES), by_sets).cast("long")
    wide = spread.select("root", blocks.alias("blocks")).where("blocks > 1")
    dealt = groups.select(F.col("node").alias("class_id"), "root").join(wide, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = parts.join(dealt, "class_id").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")))
    # every two blocks meet; a group of one block meets itself
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: (o != F.col("block")) | (F.col("blocks") == 1))
    placed = placed.withColumn("other", F.explode(others))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    placed = placed.select(F.hash("root", lo, hi).alias("task"), "root", lo.alias("lo"), hi.alias("hi"), "sig", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            order = sorted(rows)
            got = list(forest([np.frombuffer(rows[s], np.uint64) for s in order]))
            if got:
                u, v = ([order[x[k]] for x in got] for k in range(2))
                yield _batch(u=pa.array(u, pa.binary()), v=pa.array(v, pa.binary()))

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(1, 6)]
            for root, lo, hi, sig, grams in zip(*cols):
                if (root, lo, hi) != key:
                    yield from done()
                    key, rows = (root, lo, hi), {}
                rows[sig] = grams
        yield from done()

    tasks = placed.repartition("task").sortWithinPartitions("root", "lo", "hi")
    return tasks.mapInArrow(run, "u binary, v binary")


#: Joins of the steps have one plan at every size.
SHUFFLED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, component_id, sig) of every row, component_id being the smallest id of its component."""
    with settings(docs.sparkSession, SMALL_BATCHES | TIDY | SHUFFLED), Scratch(docs.sparkSession) as save:
        return save.keep(_linked(docs, id_col, text_col, save))


def _linked(docs: DataFrame, id_col: str, text_col: str, save: Scratch) -> DataFrame:
    seen = save(profile(docs, id_col, text_col))
    each = seen.where("sig is not null").select("doc_id", "n", "sig", "class_id")
    counters = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in seen.where("bucket is not null").groupBy("bucket").agg(F.sum("hits").alias("hits")).collect():
        counters[r.bucket] = r.hits
    met = save(meetings(postings(docs, text_col, counters)))
    groups = components(ties(met, save), save)
    save.drop(met)
    # sizes of the classes, to deal large groups out
    classes = save(each.where("n > 0").groupBy("sig", "class_id", "n").agg(F.min("doc_id").alias("first")))
    sizes = classes.groupBy(F.col("class_id").alias("node")).agg(F.max("n").alias("n"))
    groups = save(groups.join(sizes, "node"))
    found = components(links(groups, members(docs, text_col, groups)), save)
    found = found.select(F.col("node").alias("sig"), "root")
    rooted = save(classes.join(found, "sig", "left").withColumn("root", F.coalesce("root", "sig")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("sig", "component_id")
    alone = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return each.join(named, "sig", "left").select("doc_id", "n", alone.alias("component_id"), "sig")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the rows whose id names their component; rows without shingles or without an id stay.

    Rows are judged one by one: of several texts under one id some may go and others stay. Of rows that share id
    and text all stay: they cannot be told apart.
    """
    found = linked(docs, id_col, text_col)
    goes = (F.col("n") > 0) & F.coalesce(F.col("doc_id") != F.col("component_id"), F.lit(False))
    # tables of ids only, whose size Spark sees before it decides whether the texts must be shuffled
    gone = save(found.where(goes).select("doc_id").distinct())
    mixed = save(found.where(~goes).join(gone, "doc_id", "left_semi").select("doc_id").distinct())
    named = lambda ids: ids.select(F.col("doc_id").alias(id_col))
    rest = docs.join(named(gone), id_col, "left_anti").select(*[col(c) for c in docs.columns])
    if not mixed.head(1):
        return rest
    sig = fresh("sig", docs.columns)

    def signed(texts: list[str | None]) -> dict[str, list]:
        return {"sig": [signature(s) for s in Hasher.one().sets(texts)]}

    some = docs.join(named(mixed), id_col, "left_semi").select(*[col(c) for c in docs.columns])
    some = map_text(some, text_col, signed, T.StructType([T.StructField("sig", T.BinaryType())]), docs.columns, sig)
    out = found.where(goes).select(F.col("doc_id").alias("gone_id"), F.col("sig").alias("gone_sig")).distinct()
    stays = some.join(out, (col(id_col) == F.col("gone_id")) & (col(sig)["sig"] == F.col("gone_sig")), "left_anti")
    return rest.unionByName(stays.select(*[col(c) for c in docs.columns]))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir)).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


OP10_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*)::bigint AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), c AS (SELECT a AS doc_id, min(b)::bigint AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::bigint AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
