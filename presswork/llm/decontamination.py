"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. A text streams through it
word by word, and the state keeps the longest run that ends at the current word
and occurs in some item. A match of ten words or more means that a window of an
item ends here; items shorter than that count as one window. Runs of hit words
are removed if they are long enough, and a text with too large a share of hit
words goes as a whole.

An automaton takes some 135 bytes for each character of its items, on the driver and in
every Python worker. So items are dealt to blocks of about `BLOCK_CHARS` characters, which are built
and broadcast one at a time. With one block the texts pass once. With more, a first pass finds
the texts that may hold a window at all, by a filter of fixed size over the hashes of the items' windows;
only those pass the blocks, and what the blocks find is put together before anything is cut or
judged: results are the same for any number of blocks. A single item longer than a block is a block of its own.

A null text or one without words has no hit. Items with a null id or text, or
without words, are left out; items with one id count once. Repeated rows are
kept; extra columns of either table are not read. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_TABLE, SMALL_BATCHES, TIDY, Marks, Scratch, col, documents, fresh, map_text, settings, slices
from .native_spans import non_overlapping
from .ngram_join import Hasher, mix

WINDOW = 10
BLOCK_CHARS = 1_000_000
#: Of the removing operator: runs of at least so many hit words are cut out, texts with this share of hit words go.
MIN_SPAN = 3
MAX_COVERAGE = 0.8

RUN = T.StructType([T.StructField("begin", T.LongType(), False), T.StructField("end", T.LongType(), False)])
FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("longest", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN, False)),
        T.StructField("items", T.ArrayType(T.StringType(), False)),
        T.StructField("clean", T.StringType()),
    ]
)


def words(text: str) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text with A-Z lower-cased, as UTF-8."""
    return text.encode().translate(ALNUM_TABLE).split()


@dataclass
class Automaton:
    """States are numbers; 0 is the empty run."""

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    #: state that holds the last `window` words, for states that are long enough
    frame: list[int] = field(default_factory=list)
    #: items by that state
    items: dict[int, list[str]] = field(default_factory=dict)
    #: (words, item) of whole short items that end in a state
    shorts: dict[int, list[tuple[int, str]]] = field(default_factory=dict)
    #: fewest words that can make a hit
    least: int = 0
    pairs: np.ndarray | None = None

    def _state(self, length: int) -> int:
        self.length.append(length)
        self.link.append(0)
        self.step.append({})
        return len(self.length) - 1

    def _split(self, at: int, word: int) -> int:
        """The state reached from `at` by `word`, cut so that its longest run is one word longer than `at`'s."""
        to = self.step[at][word]
        if self.length[to] == self.length[at] + 1:
            return to
        twin = self._state(self.length[at] + 1)
        self.step[twin] = dict(self.step[to])
        self.link[twin], self.link[to] = self.link[to], twin
        while at >= 0 and self.step[at].get(word) == to:
            self.step[at][word] = twin
            at = self.link[at]
        return twin

    def _append(self, last: int, word: int) -> int:
        if word in self.step[last]:  # another item has this run
            return self._split(last, word)
        new = self._state(self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        self.link[new] = self._split(at, word) if at >= 0 else 0
        return new

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int = WINDOW) -> Automaton:
        self = cls(window)
        texts = [(name, words(text)) for name, text in items]
        texts = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for name, ws in texts if ws]
        for _, ws in texts:
            last = 0
            for w in ws:
                last = self._append(last, w)
        n = len(self.length)
        self.frame = [-1] * n
        for s in sorted(range(n), key=self.length.__getitem__):
            if self.length[s] >= window:
                up = self.frame[self.link[s]]
                self.frame[s] = up if up >= 0 else s
        found: dict[int, set[str]] = {}
        whole: dict[int, set[tuple[int, str]]] = {}
        for name, ws in texts:
            state = 0
            for i, w in enumerate(ws):
                state = self.step[state][w]
                if i + 1 >= window:
                    found.setdefault(self.frame[state], set()).add(name)
            if len(ws) < window:
                while self.length[self.link[state]] >= len(ws):
                    state = self.link[state]
                whole.setdefault(state, set()).add((len(ws), name))
        self.items = {s: sorted(x) for s, x in found.items()}
        if whole:
            for s in sorted(range(1, n), key=self.length.__getitem__):  # a state also ends what its links end
                mine = [*self.shorts.get(self.link[s], []), *sorted(whole.get(s, ()))]
                if mine:
                    self.shorts[s] = mine
        self.least = min((min(len(ws), window) for _, ws in texts), default=0)
        v = len(self.vocabulary)
        self.pairs = np.unique(np.array([a * v + b for _, ws in texts for a, b in zip(ws, ws[1:])], np.int64))
        return self

    def _stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words that may hold a hit: long enough, all known, all neighbours known as a pair."""
        known = ids >= 0
        if self.least >= 2:
            v = len(self.vocabulary)
            both = np.flatnonzero(known[:-1] & known[1:])
            code = ids[both] * v + ids[both + 1]
            place = np.searchsorted(self.pairs, code)
            place[place == len(self.pairs)] = 0
            linked = np.zeros(len(ids) + 1, np.int8)
            linked[both[self.pairs[place] == code] + 1] = 1  # word i follows word i - 1 somewhere
            edge = np.diff(linked, prepend=np.int8(0))
            starts, ends = np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1)
        else:
            edge = np.diff(known.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - starts >= self.least
        return list(zip(starts[long].tolist(), ends[long].tolist()))

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], list[str], int]:
        """Maximal runs of hit words, the items hit, and the length of the longest match seen."""
        if not self.least or len(ws) < self.least:
            return [], [], 0
        ids = np.fromiter(map(self.vocabulary.get, ws, repeat(-1)), np.int64, len(ws))
        runs: list[tuple[int, int]] = []
        names: set[str] = set()
        longest, length, link, step, window = 0, self.length, self.link, self.step, self.window

        def hit(begin: int, end: int) -> None:
            while runs and runs[-1][1] >= begin:
                begin = min(begin, runs.pop()[0])
            runs.append((begin, end))

        for start, end in self._stretches(ids):
            state = size = 0
            for i, w in enumerate(ids[start:end].tolist(), start):
                while w not in step[state]:
                    state = link[state]
                    size = length[state]
                state = step[state][w]
                size += 1
                longest = max(longest, size)
                if size >= window:
                    names.update(self.items[self.frame[state]])
                    hit(i + 1 - window, i + 1)
                for n, name in self.shorts.get(state, ()):
                    if n <= size:
                        names.add(name)
                        hit(i + 1 - n, i + 1)
        return runs, sorted(names), longest


#: The same words in a text that is not lower-cased.
_word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text: str, runs: list[tuple[int, int]], min_span: int) -> str:
    """The text without the runs of at least `min_span` words; a blank stands where one was."""
    runs = [r for r in runs if r[1] - r[0] >= min_span]
    if not runs:
        return text
    places = [m.span() for m in _word.finditer(text)]
    out, at = [], 0
    for begin, end in runs:
        out.append(text[at : places[begin][0]])
        at = places[end - 1][1]
    return " ".join([*out, text[at:]])


def dealt(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(item, body, part) of the items that have an id and a text, and the number of parts."""
    used = items.select(col(id_col).cast("string").alias("item"), col(text_col).cast("string").alias("body")).dropna()
    chars = used.agg(F.sum(F.length("body")).alias("n")).first().n or 0
    count = 1 if chars <= BLOCK_CHARS else math.ceil(2 * chars / BLOCK_CHARS)  # half full on average, as a hash deals them out unevenly
    return used.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(count))), count


def automaton_of(parts: DataFrame, part: int, window: int) -> Automaton:
    """The automaton of one part, whose items come to the driver."""
    return Automaton.of([(r.item, r.body) for r in parts.where(F.col("part") == part).select("item", "body").collect()], window)


def scan(
    df: DataFrame,
    automaton: Automaton,
    text_col: str,
    keep: tuple[str, ...],
    out: str,
    clean_from: int | None = None,
) -> DataFrame:
    """One pass of the texts through one automaton."""
    shared = df.sparkSession.sparkContext.broadcast(automaton)

    def run(texts: list[str | None]) -> dict[str, list]:
        one = shared.value
        made: dict[str, list] = {f.name: [] for f in FIELDS}
        for text in texts:
            ws = words(text or "")
            runs, names, longest = one.match(ws)
            made["n_words"].append(len(ws))
            made["longest"].append(longest)
            made["runs"].append([{"begin": b, "end": e} for b, e in runs])
            made["items"].append(names)
            made["clean"].append(cut(text, runs, clean_from) if clean_from is not None and runs else None)
        return made

    return map_text(df, text_col, run, FIELDS, keep, out)


def hit_words(runs: Column) -> Column:
    """Number of words in the runs."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])


class Windows:
    """The hashes of all runs of some lengths of words, of many texts at once."""

    def __init__(self, texts: list[str | None]):
        data = [(t or "").encode().translate(ALNUM_TABLE) for t in texts]
        raw = np.frombuffer(b" ".join([b"", *data, b""]), np.uint8)
        self.codes, starts, _ = Hasher.one().words(raw, 1)
        self.first = np.searchsorted(starts, np.cumsum([1, *(len(d) + 1 for d in data)]))
        self.n_words = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(data)), self.n_words)
        self.up, self.down = (x[: len(self.codes)] for x in Hasher.one().powers[0])
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.codes * self.up)])

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of the runs of `size` words."""
        n = max(0, len(self.codes) - size + 1)
        inside = self.owner[:n] == self.owner[size - 1 : size - 1 + n]
        made = mix((self.total[size : size + n] - self.total[:n]) * self.down[:n] + np.uint64(size))
        return made[inside], self.owner[:n][inside]


def window_marks(parts: DataFrame, window: int, save: Scratch) -> tuple[Marks, list[int]]:
    """A filter of the hashes of the items' windows, and the numbers of words that these have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, size in slices(batch.column(0)):
                w = Windows(batch.column(0).slice(at, size).to_pylist())
                for words_ in range(1, window + 1):
                    fits = w.n_words >= window if words_ == window else w.n_words == words_
                    h, owner = w.of(words_)
                    h = np.unique(h[fits[owner]])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), words_, np.int32))], names=["h", "words"])

    found = save(parts.select("body").mapInArrow(run, "h long, words int").distinct())
    return Marks.of(found, "h"), sorted(r.words for r in found.select("words").distinct().collect())


def by_blocks(
    df: DataFrame, parts: DataFrame, count: int, text_col: str, keep: tuple[str, ...], out: str, clean_from: int | None, window: int, save: Scratch
) -> DataFrame:
    """As `scan` of one automaton with all items, block by block."""
    names = {n: fresh(n, (*keep, out)) for n in ("row_number", "body_in", "first_look")}
    row, body, look = names.values()
    marks, sizes = window_marks(parts, window, save)
    shared = df.sparkSession.sparkContext.broadcast(marks)
    fields = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("may", T.BooleanType())])

    def first(texts: list[str | None]) -> dict[str, list]:
        w = Windows(texts)
        may = np.zeros(len(texts), bool)
        for size in sizes:
            h, owner = w.of(size)
            may[owner[shared.value.has(h)]] = True
        return {"n_words": w.n_words.tolist(), "may": may.tolist()}

    now = df.select(*[col(k) for k in keep], col(text_col).cast("string").alias(body), F.monotonically_increasing_id().alias(row))
    every = save(map_text(now, body, first, fields, (*keep, body, row), look))
    some = every.where(col(look)["may"]).select(col(row).alias("row"), col(body).alias("body"))
    found = []
    for part in range(count):
        automaton = automaton_of(parts, part, window)
        hits = scan(some, automaton, "body", ("row",), "o").where(F.size("o.runs") > 0).select("row", "o.longest", "o.runs", "o.items")
        found.append(save(hits))
    joined = found[0]
    for more in found[1:]:
        joined = joined.unionByName(more)
    joined = joined.groupBy("row").agg(
        F.max("longest").alias("longest"), F.flatten(F.collect_list("runs")).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    runs = non_overlapping(F.transform("runs", lambda r: F.struct(r["begin"].cast("int").alias("start"), r["end"].cast("int").alias("end"))))
    runs = F.transform(runs, lambda r: F.struct(r["start"].cast("long").alias("begin"), r["end"].cast("long").alias("end")))
    joined = joined.withColumn("runs", runs)
    clean = F.lit(None).cast("string")
    if clean_from is not None:
        clean = F.pandas_udf(lambda t, r: t.combine(r, lambda x, y: cut(x, [(z["begin"], z["end"]) for z in y], clean_from)), "string")("body", "runs")
    joined = save(joined.join(some, "row").select("row", "longest", "runs", "items", clean.alias("clean")))
    hit = fresh("hit", (*keep, out))
    back = joined.select(F.col("row").alias(row), F.struct("longest", "runs", "items", "clean").alias(hit))
    h, none = col(hit), F.array()
    made = F.struct(
        col(look)["n_words"].alias("n_words"), F.coalesce(h["longest"], F.lit(0)).alias("longest"),
        F.coalesce(h["runs"], none.cast("array<struct<begin:bigint,end:bigint>>")).alias("runs"),
        F.coalesce(h["items"], none.cast("array<string>")).alias("items"), h["clean"].alias("clean"),
    )
    return every.join(back, row, "left").select(*[col(k) for k in keep], made.alias(out))


def scan_all(
    df: DataFrame, items: DataFrame, text_col: str, keep: tuple[str, ...], out: str, id_col: str, item_text: str, window: int, clean_from: int | None
) -> DataFrame:
    """`keep` columns and a struct `out` of `FIELDS` over all items."""
    parts, count = dealt(items, id_col, item_text)
    if count == 1:
        return scan(df, automaton_of(parts, 0, window), text_col, keep, out, clean_from)
    with settings(df.sparkSession, SMALL_BATCHES | TIDY), Scratch(df.sparkSession) as save:
        return save.keep(by_blocks(df, parts, count, text_col, keep, out, clean_from, window, save))


def find_overlaps(
    df: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    id_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    out: str = "overlap",
) -> DataFrame:
    """`keep` columns and a struct `out`: n_words, n_hit, longest, items (ids as strings, sorted); renamed on a clash."""
    out = fresh(out, keep)
    now = scan_all(df, items, text_col, keep, out, id_col, item_text, window, None)
    o = col(out)
    made = F.struct(o["n_words"].alias("n_words"), hit_words(o["runs"]).alias("n_hit"), o["longest"].alias("longest"), o["items"].alias("items"))
    return now.select(*[col(k) for k in keep], made.alias(out))


def decontaminate(
    df: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    id_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    min_span: int = MIN_SPAN,
    max_coverage: float = MAX_COVERAGE,
) -> DataFrame:
    """All columns of `df`, its texts without hit runs of `min_span` words or more.

    Rows whose share of hit words, by all items together, is at least `max_coverage` go.
    """
    out = fresh("overlap", df.columns)
    now = scan_all(df, items, text_col, tuple(df.columns), out, id_col, item_text, window, min_span)
    o = col(out)
    now = now.where(hit_words(o["runs"]) < F.greatest(o["n_words"], F.lit(1)) * F.lit(max_coverage))
    text = F.coalesce(o["clean"], col(text_col)).alias(text_col)
    return now.select(*[text if c == text_col else col(c) for c in df.columns])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    o = F.col("overlap")
    return find_overlaps(documents(spark, sf_dir), bench).select(
        "doc_id",
        o["n_words"].alias("n_words"),
        o["n_hit"].alias("n_hit"),
        F.size(o["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", o["items"]), 256).alias("items_sha256"),
        (o["n_hit"] > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM bw), hits AS (
  SELECT row_id, i, bw.k, item_id
  FROM (SELECT row_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
        FROM (SELECT row_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM d, sizes)) x
  JOIN bw ON bw.k = x.k AND bw.win = x.win
), n_hit AS (
  SELECT row_id, count(DISTINCT j)::bigint AS n FROM (SELECT row_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY row_id
), names AS (
  SELECT row_id, count(*)::bigint AS n, string_agg(s, ',' ORDER BY s) AS said
  FROM (SELECT DISTINCT row_id, item_id::varchar AS s FROM hits) GROUP BY row_id
)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit.n, 0)::bigint AS n_hit, coalesce(names.n, 0)::bigint AS n_items,
       sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (row_id) LEFT JOIN names USING (row_id)
"""
