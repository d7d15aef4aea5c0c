"""Substring deduplication: content-defined paragraphs by MinHash banding, verified exactly.

Texts are cut into fine and coarse paragraphs (`paragraphs.py`), which do not depend on
lines. A first pass hashes every text once. It writes, for each coarse paragraph, the
hashes of its MinHash bands over 5-word shingles; `tune` picks rows and bands so that
two paragraphs of Jaccard similarity 0.75 share a band with a probability of at least
`RECALL`. A fine paragraph has a dozen shingles or less, so that two similar ones are
equal but for a word at an end; it has one band, the hash of all its words. Rows of
one band meet: coarse paragraphs are tied to the first one, fine ones are counted.
A second pass gives the places of the fine paragraphs that repeat, and the sets of the
tied coarse ones. Two results come of it, told apart by `unit`:

- `equal`: stretches of `SHORTEST` words or more that stand word for word elsewhere. Fine
  paragraphs in a row that repeat another row of them are one run; a run is extended word by
  word over the paragraphs at its ends, as far as its source agrees. The first
  occurrence (by doc_id, then place) of each fine paragraph stays, the others can be removed.
- `near`: coarse paragraphs of `SHORTEST` words or more in clusters. Inside a group of ties the
  pairs are compared exactly, by T-occurrence, so that a tie never stands for a link; components
  of the links are clusters. The first occurrence of a cluster stays.

Rows of the two units may overlap; what a row that is not removed covers stays, also in
a removed one. So a passage always stays somewhere, as a whole or similar to it.

Null and empty texts have no paragraphs. Copies of a text, also under the same id,
are occurrences like any other. A null id sorts before the others. Extra columns are
not read, texts are read whole, no group is capped or sampled. Words are compared by
64-bit hashes, those at the ends of a run by 32 bits of them. A passage shorter than
50 words may lie between two cuts of its surroundings and is then not found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL_BATCHES, TIDY, Marks, Scratch, col, documents, settings, slices
from .components import components
from .ngram_join import SHINGLE, _batch, links, mix
from .paragraphs import Cuts, Recent, binaries, ranges

THRESHOLD = 0.75
RECALL = 0.985
PERMUTATIONS = 24
SHORTEST = 30
#: Words that a run may be extended by; few fine paragraphs are longer.
CONTEXT = 64
_U = np.uint64


def tune(threshold: float = THRESHOLD, recall: float = RECALL, permutations: int = PERMUTATIONS) -> tuple[int, int]:
    """(bands, rows): most rows a band for which the threshold's recall is met within the permutations."""
    best = permutations, 1
    for rows in range(1, permutations + 1):
        bands = permutations // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            best = bands, rows
    return best


def banded(docs: DataFrame, text_col: str, bands: int, rows: int, seed: int = 7) -> DataFrame:
    """(key, class_id, n): the bands of the paragraphs that a task meets; n counts a fine one, 0 is a coarse one."""
    draw = np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, bands * rows, np.uint64) * _U(2) + _U(1)

    def of_coarse(cuts: Cuts, recent: Recent) -> tuple[np.ndarray, np.ndarray]:
        begin, end = cuts.coarse
        long = end - begin >= SHINGLE  # fewer words are one shingle: equal or not similar at all
        begin, end = begin[long], end[long]
        who, _ = cuts.hashes((begin, end))
        new = recent.new(who)
        who, size = who[new], (end - begin)[new] - SHINGLE + 1
        if not len(who):
            return np.zeros(0, _U), np.zeros(0, _U)
        flat = cuts.shingles()[ranges(begin[new], size)]
        starts = np.cumsum(size) - size
        key = np.broadcast_to(np.arange(1, bands + 1).astype(_U), (len(who), bands)).copy()
        for k, d in enumerate(draw):
            band = k % bands
            key[:, band] = mix(key[:, band] * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(flat * d, starts))
        return key.ravel(), np.repeat(who, bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent, once, twice = Recent(), Recent(), Recent()
        for batch in batches:
            for at, size in slices(batch.column(0)):
                cuts = Cuts(batch.column(0).slice(at, size).to_pylist())
                fine, n = np.unique(cuts.hashes(cuts.fine)[0], return_counts=True)
                n[once.told(fine)] = 2  # what is remembered from before has been counted
                again = twice.told(fine)
                once.new(fine)
                twice.new(fine[n > 1])
                fine, n = fine[~again], n[~again]  # and what was told to repeat need not be told again
                key, who = of_coarse(cuts, recent)
                yield _batch(
                    key=pa.array(np.concatenate([mix(fine), key]).view(np.int64)),
                    class_id=pa.array(np.concatenate([fine, who]).view(np.int64)),
                    n=pa.array(np.concatenate([n, np.zeros(len(who), n.dtype)]).astype(np.int32)),
                )

    return docs.select(col(text_col).cast("string").alias("text")).mapInArrow(run, "key long, class_id long, n int")


def met(bands: DataFrame) -> DataFrame:
    """(u, v): ties of coarse paragraphs to the smallest of their band, and (u, null) for fine ones that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = lead = None
        count = 0  # of the key that may go on

        def one(u: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
            return _batch(u=pa.array(u, pa.int64()), v=pa.nulls(len(u), pa.int64()) if v is None else pa.array(v, pa.int64()))

        for batch in batches:
            if not batch.num_rows:
                continue
            k, c, n = (batch.column(i).to_numpy() for i in range(3))
            new = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
            if new[0] and count > 1:
                yield one(np.array([lead]), None)
            starts = np.flatnonzero(new)
            lead_of = np.concatenate([[0 if lead is None else lead], c[starts]])[np.cumsum(new)]
            bounds = starts if new[0] else np.concatenate([[0], starts])
            totals = np.add.reduceat(n.astype(np.int64), bounds)
            totals[0] += 0 if new[0] else count
            again = totals[:-1] > 1
            if again.any():
                yield one(lead_of[bounds[:-1][again]], None)
            apart = (lead_of != c) & (n == 0)
            if apart.any():
                pairs = np.unique(np.stack([c[apart], lead_of[apart]], 1), axis=0)
                yield one(pairs[:, 0], pairs[:, 1])
            key, lead, count = k[-1], lead_of[-1], int(totals[-1])
        if count > 1:
            yield one(np.array([lead]), None)

    return bands.repartition("key").sortWithinPartitions("key", "class_id").mapInArrow(run, "u long, v long")


PLACES = (
    "kind int, h1 long, h2 long, row long, doc_id long, at int, n int, begin int, end int, open int, "
    "left binary, right binary, left_at binary, right_at binary, prev long, next long, sig binary, size long, grams binary"
)


def places(docs: DataFrame, id_col: str, text_col: str, repeated: Marks, tied: Marks) -> DataFrame:
    """Rows of `PLACES`: fine paragraphs that repeat (kind 0) and coarse ones with a tie (1).

    `at` and `n` are words, `begin` and `end` code points. left and right hold hashes of the words of the
    neighbours; `open` says on which sides (1 left, 2 right) there is one that does not repeat, and
    left_at and right_at hold where those words begin and end. prev and next are the hashes of the neighbours. The filters let a few others through.
    """
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")
    )
    share = docs.sparkSession.sparkContext.broadcast
    repeated_, tied_ = share(repeated), share(tied)
    names = [f.split()[0] for f in PLACES.split(", ")]

    def ints(x: np.ndarray) -> pa.Array:
        return pa.array(x.astype(np.int32))

    def common(part: pa.RecordBatch, cuts: Cuts, chars: np.ndarray, begin: np.ndarray, end: np.ndarray) -> dict:
        own = cuts.owner[begin]
        base, took = chars[cuts.byte_at[own]], pa.array(own)
        return dict(
            row=part.column(0).take(took), doc_id=part.column(1).take(took), at=ints(begin - cuts.word_at[own]), n=ints(end - begin),
            begin=ints(chars[cuts.starts[begin]] - base), end=ints(chars[cuts.ends[end - 1]] - base),
        )

    def full(columns: dict, n: int) -> pa.RecordBatch:
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        return _batch(**{f.split()[0]: columns.get(f.split()[0], pa.nulls(n, kinds[f.split()[1]])) for f in PLACES.split(", ")})

    def of_fine(part: pa.RecordBatch, cuts: Cuts, chars: np.ndarray) -> pa.RecordBatch | None:
        begin, end = cuts.fine
        h1, h2 = cuts.hashes(cuts.fine)
        again = repeated_.value.has(h1)
        i = np.flatnonzero(again)
        if not len(i):
            return None
        own = cuts.owner[begin]
        joined = np.concatenate([[False], own[1:] == own[:-1], [False]])  # to the one before
        before, behind = joined[i], joined[i + 1]
        prev, next_ = np.maximum(i - 1, 0), np.minimum(i + 1, len(begin) - 1)
        lo = np.where(before, np.maximum(begin[prev], begin[i] - CONTEXT), begin[i])
        hi = np.where(behind, np.minimum(end[next_], end[i] + CONTEXT), end[i])
        open_left, open_right = before & ~again[prev], behind & ~again[next_]
        short = (cuts.codes >> _U(32)).astype(np.uint32)
        n_left, n_right = begin[i] - lo, hi - end[i]
        shown = (begin[i], end[i])
        base = chars[cuts.byte_at[own[i]]]
        lefts, rights = ranges(lo[open_left], n_left[open_left]), ranges(shown[1][open_right], n_right[open_right])
        left_at = chars[cuts.starts[lefts]] - np.repeat(base[open_left], n_left[open_left])
        right_at = chars[cuts.ends[rights]] - np.repeat(base[open_right], n_right[open_right])
        return full(
            dict(
                kind=ints(np.zeros(len(i))), h1=pa.array(h1[i].view(np.int64)), h2=pa.array(h2[i].view(np.int64)),
                **common(part, cuts, chars, *shown), open=ints(open_left + 2 * open_right),
                prev=pa.array(h1[prev].view(np.int64), mask=~before), next=pa.array(h1[next_].view(np.int64), mask=~behind),
                left=binaries(short[ranges(lo, n_left)], n_left), right=binaries(short[ranges(end[i], n_right)], n_right),
                left_at=binaries(left_at.astype(np.int32), np.where(open_left, n_left, 0)),
                right_at=binaries(right_at.astype(np.int32), np.where(open_right, n_right, 0)),
            ),
            len(i),
        )

    def of_coarse(part: pa.RecordBatch, cuts: Cuts, chars: np.ndarray, recent: Recent) -> pa.RecordBatch | None:
        begin, end = cuts.coarse
        h1, h2 = cuts.hashes(cuts.coarse)
        i = np.flatnonzero(tied_.value.has(h1) & (end - begin >= SHINGLE))
        if not len(i):
            return None
        begin, end, h1, h2 = begin[i], end[i], h1[i], h2[i]
        grams = cuts.shingles()
        sets: list = [None] * len(i)
        sizes: list = [None] * len(i)
        for k in recent.new(h1).tolist():
            one = np.unique(grams[begin[k] : end[k] - SHINGLE + 1])
            sets[k], sizes[k] = one.tobytes(), len(one)
        sig = np.stack([h1, h2], 1).ravel()
        return full(
            dict(
                kind=ints(np.ones(len(i))), h1=pa.array(h1.view(np.int64)), h2=pa.array(h2.view(np.int64)), **common(part, cuts, chars, begin, end),
                sig=binaries(sig, np.full(len(i), 2)), size=pa.array(sizes, pa.int64()), grams=pa.array(sets, pa.binary()),
            ),
            len(i),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for batch in batches:
            for at, size in slices(batch.column(2)):
                part = batch.slice(at, size)
                cuts = Cuts(part.column(2).to_pylist())
                chars = cuts.chars()
                for made in (of_fine(part, cuts, chars), of_coarse(part, cuts, chars, recent)):
                    if made is not None:
                        yield made

    assert names[0] == "kind"
    return source.mapInArrow(run, PLACES)


RUNS = (
    "row long, doc_id long, at int, n int, begin int, end int, src_row long, src_doc long, src_at int, removed boolean, "
    "left_at array<int>, right_at array<int>, left_n int, left_begin int, right_n int, right_end int"
)


def alike(mine: bytes, theirs: bytes, from_end: bool) -> int:
    """How many words two contexts have in common, from their ends or their starts on."""
    a, b = (np.frombuffer(x or b"", np.uint32) for x in (mine, theirs))
    n = min(len(a), len(b))
    if not n:
        return 0
    same = (a[len(a) - n :] == b[len(b) - n :])[::-1] if from_end else a[:n] == b[:n]
    return n if same.all() else int(np.argmin(same))


def same_hash(rows: pa.Table, mine: str, theirs: str) -> np.ndarray:
    """Where two columns hold the same number; nulls are never the same."""
    return pc.fill_null(pc.equal(rows.column(mine), rows.column(theirs)), False).to_numpy()


def runs(placed: DataFrame) -> DataFrame:
    """Rows of `RUNS` from places of fine paragraphs with their sources: paragraphs in a row with sources in a row are one.

    A run that can be removed is extended at its ends: word by word into a paragraph that doesn't repeat, and over a whole
    neighbour that repeats too, but came first from elsewhere, where the run's own source goes on with it. Then runs
    of one source that meet are one, so a passage is judged as a whole; runs inside others are left out. Of what stays, left_at and right_at
    say where the words around it begin and end; the last four columns tell that of whole neighbours.
    """
    ints = ("row", "at", "n", "begin", "end", "open", "src_row", "src_at")

    def close(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        c = {k: t.column(k).to_numpy().astype(np.int64) for k in ints}
        first = (c["row"] == c["src_row"]) & (c["at"] == c["src_at"])
        shift = c["src_at"] - c["at"]
        joint = (c["row"][1:] == c["row"][:-1]) & (c["at"][1:] == (c["at"] + c["n"])[:-1])
        joint &= (c["src_row"][1:] == c["src_row"][:-1]) & (shift[1:] == shift[:-1]) & (first[1:] == first[:-1])
        head = np.flatnonzero(np.concatenate([[True], ~joint]))
        tail = np.append(head[1:], t.num_rows) - 1
        row, at, begin, src_at = (c[k][head] for k in ("row", "at", "begin", "src_at"))
        stop, end = (c["at"] + c["n"])[tail], c["end"][tail].copy()
        removed = ~first[head]
        blobs = {k: t.column(k) for k in ("left", "src_left", "left_at", "right", "src_right", "right_at")}
        pick = lambda k, i: blobs[k][int(i)].as_py()
        on_left, on_right = same_hash(t, "prev", "src_prev"), same_hash(t, "next", "src_next")
        for r in np.flatnonzero(removed).tolist():
            h, e = head[r], tail[r]
            if c["open"][h] & 1 and (more := alike(pick("left", h), pick("src_left", h), True)):
                if r and row[r - 1] == row[r]:  # the run before may have taken some of them
                    more = min(more, at[r] - stop[r - 1])
                if more > 0:
                    where = np.frombuffer(pick("left_at", h), np.int32)
                    at[r], src_at[r], begin[r] = at[r] - more, src_at[r] - more, where[len(where) - more]
            elif on_left[h] and h and c["row"][h - 1] == c["row"][h] and c["at"][h - 1] + c["n"][h - 1] == c["at"][h]:
                at[r], src_at[r], begin[r] = at[r] - c["n"][h - 1], src_at[r] - c["n"][h - 1], c["begin"][h - 1]
            if c["open"][e] & 2 and (more := alike(pick("right", e), pick("src_right", e), False)):
                stop[r], end[r] = stop[r] + more, np.frombuffer(pick("right_at", e), np.int32)[more - 1]
            elif on_right[e] and e + 1 < t.num_rows and c["row"][e + 1] == c["row"][e] and c["at"][e + 1] == c["at"][e] + c["n"][e]:
                stop[r], end[r] = stop[r] + c["n"][e + 1], c["end"][e + 1]
        src_row, keep = c["src_row"][head], np.ones(len(head), bool)
        order = np.lexsort((at, src_at - at, src_row, row, ~removed))[: int(removed.sum())]
        for r, q in zip(order[1:].tolist(), order[:-1].tolist()):  # runs of one source that meet become the later one
            if (row[r], src_row[r], src_at[r] - at[r]) == (row[q], src_row[q], src_at[q] - at[q]) and at[r] <= stop[q]:
                if stop[q] > stop[r]:
                    stop[r], end[r] = stop[q], end[q]
                at[r], begin[r], src_at[r], keep[q] = at[q], begin[q], src_at[q], False
        within, far = -1, 0
        for r in np.lexsort((-stop, at, row))[:].tolist():
            if removed[r] and keep[r]:
                if row[r] == within and stop[r] <= far:
                    keep[r] = False
                elif stop[r] - at[r] >= SHORTEST:
                    within, far = row[r], max(stop[r], far if row[r] == within else 0)
        took = np.flatnonzero(keep)
        beside = np.full((len(head), 4), -1)
        for r in np.flatnonzero(~removed).tolist():  # whole neighbours of what stays
            h, e = head[r], tail[r]
            if h and c["row"][h - 1] == c["row"][h] and c["at"][h - 1] + c["n"][h - 1] == c["at"][h]:
                beside[r, :2] = c["n"][h - 1], c["begin"][h - 1]
            if e + 1 < t.num_rows and c["row"][e + 1] == c["row"][e] and c["at"][e + 1] == c["at"][e] + c["n"][e]:
                beside[r, 2:] = c["n"][e + 1], c["end"][e + 1]
        around = [[None if removed[r] or (v := pick(k, i[r])) is None else np.frombuffer(v, np.int32) for r in took.tolist()] for k, i in (("left_at", head), ("right_at", tail))]
        place = pa.array(head[took])
        return _batch(
            row=pa.array(row[took]), doc_id=t.column("doc_id").take(place).combine_chunks(), at=pa.array(at[took].astype(np.int32)),
            n=pa.array((stop - at)[took].astype(np.int32)), begin=pa.array(begin[took].astype(np.int32)), end=pa.array(end[took].astype(np.int32)),
            src_row=pa.array(src_row[took]), src_doc=t.column("src_doc").take(place).combine_chunks(),
            src_at=pa.array(src_at[took].astype(np.int32)), removed=pa.array(removed[took]),
            left_at=pa.array(around[0], pa.list_(pa.int32())), right_at=pa.array(around[1], pa.list_(pa.int32())),
            **{k: pa.array(v[took].astype(np.int32), mask=v[took] < 0) for k, v in zip(("left_n", "left_begin", "right_n", "right_end"), beside.T)},
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch.column(0).to_numpy()
            cut = int(np.searchsorted(row, row[-1]))  # the last text may go on in the next batch
            if held and (cut or held[-1].column(0)[-1].as_py() != row[-1]):
                yield close([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield close([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield close(held)

    return placed.repartition("row").sortWithinPartitions("row", "at").mapInArrow(run, RUNS)


FOUND = ("unit", "doc_id", "first_word", "n_words", "begin", "end", "cluster_doc_id", "cluster_word", "removed")


def equal(found: DataFrame, save: Scratch) -> DataFrame:
    """Rows of `FOUND` of the unit `equal`, from saved places."""
    fine = found.where("kind = 0")
    src = F.struct("doc_id", "row", "at", "left", "right", "prev", "next")
    firsts = fine.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(src).alias("src")).where("times > 1")
    side = lambda bit, c: F.when(F.col("open").bitwiseAND(F.lit(bit)) > 0, F.col(c)).alias(c.replace(".", "_"))
    placed = fine.join(firsts, ["h1", "h2"]).select(
        "row", "doc_id", "at", "n", "begin", "end", "open", F.col("src.row").alias("src_row"), F.col("src.doc_id").alias("src_doc"),
        F.col("src.at").alias("src_at"), side(1, "left"), side(1, "src.left"), "left_at", side(2, "right"), side(2, "src.right"), "right_at",
        "prev", "next", F.col("src.prev").alias("src_prev"), F.col("src.next").alias("src_next"),
    )
    every = save(runs(placed))
    gone = every.where(F.col("removed") & (F.col("n") >= SHORTEST))
    # what stays is told where a removed run rests on it, as far as removed runs do, into paragraphs that don't repeat
    wanted = gone.select("src_row", F.col("src_at").alias("src_from"), (F.col("src_at") + F.col("n")).alias("src_to")).distinct()
    wanted = wanted.withColumnRenamed("src_row", "wanted_row")
    meets = (F.col("row") == F.col("wanted_row")) & (F.col("src_from") < F.col("at") + F.col("n")) & (F.col("src_to") > F.col("at"))
    first = every.where(~F.col("removed"))
    reach = first.join(wanted, meets).groupBy("row", "at").agg(F.min("src_from").alias("src_from"), F.max("src_to").alias("src_to"))
    ahead, after = F.col("at") - F.col("src_from"), F.col("src_to") - F.col("at") - F.col("n")
    stays = first.join(reach, ["row", "at"]).withColumns(
        {
            "before": F.when(F.col("left_n") <= ahead, F.col("left_n")).otherwise(F.greatest(F.least(ahead, F.coalesce(F.size("left_at"), F.lit(0))), F.lit(0))),
            "behind": F.when(F.col("right_n") <= after, F.col("right_n")).otherwise(F.greatest(F.least(after, F.coalesce(F.size("right_at"), F.lit(0))), F.lit(0))),
        }
    )
    stays = stays.withColumns(
        {
            "begin": F.when(F.col("before") == F.col("left_n"), F.col("left_begin")).when(F.col("before") > 0, F.element_at("left_at", -F.col("before"))).otherwise(F.col("begin")),
            "end": F.when(F.col("behind") == F.col("right_n"), F.col("right_end")).when(F.col("behind") > 0, F.element_at("right_at", F.col("behind"))).otherwise(F.col("end")),
            "at": F.col("at") - F.col("before"),
            "src_at": F.col("at") - F.col("before"),
            "n": F.col("n") + F.col("before") + F.col("behind"),
        }
    )
    both = gone.unionByName(stays.select(*gone.columns))
    return both.select(
        F.lit("equal").alias("unit"), "doc_id", F.col("at").alias("first_word"), F.col("n").alias("n_words"), "begin", "end",
        F.col("src_doc").alias("cluster_doc_id"), F.col("src_at").alias("cluster_word"), "removed",
    )


def near(found: DataFrame, groups: DataFrame, save: Scratch) -> DataFrame:
    """Rows of `FOUND` of the unit `near`, from saved places and the groups of ties."""
    coarse = found.where("kind = 1")
    sizes = coarse.groupBy(F.col("h1").alias("node")).agg(F.max("size").alias("n"))
    parts = coarse.where("grams is not null").select(F.col("h1").alias("class_id"), "sig", "grams")
    linked = components(links(save(groups.join(sizes, "node")), parts), save)
    placed = coarse.join(linked.withColumnRenamed("node", "sig"), "sig").select("root", "row", "doc_id", "at", "n", "begin", "end")
    placed = save(placed)
    firsts = placed.groupBy("root").agg(F.min(F.struct("doc_id", "row", "at")).alias("first"))
    removed = (F.col("row") != F.col("first.row")) | (F.col("at") != F.col("first.at"))
    return placed.join(firsts, "root").where(F.col("n") >= SHORTEST).select(
        F.lit("near").alias("unit"), "doc_id", F.col("at").alias("first_word"), F.col("n").alias("n_words"), "begin", "end",
        F.col("first.doc_id").alias("cluster_doc_id"), F.col("first.at").alias("cluster_word"), removed.alias("removed"),
    )


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `FOUND`: every repeated stretch and every similar paragraph, its first occurrence, and whether it can be removed."""
    spark = docs.sparkSession
    with settings(spark, SMALL_BATCHES | TIDY), Scratch(spark) as save:
        pairs = save(met(banded(docs, text_col, *tune())))
        groups = components(pairs.where("v is not null"), save)
        repeated, tied = Marks.of(pairs.where("v is null"), "u"), Marks.of(groups, "node")
        save.drop(pairs)
        found = save(places(docs, id_col, text_col, repeated, tied))
        return save.keep(equal(found, save).unionByName(near(found, groups, save)))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir))
