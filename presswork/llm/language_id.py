"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a seed and its code
point. A trigram is the product of its three letters' vectors, the first rotated
by two places and the second by one (so that order counts); a text is the sum of
its trigrams. A language prototype is the sum of the unit-length vectors of its
training texts, and a text gets the language whose prototype has the largest
cosine with it.

Training reads every labelled training text. Partial sums are whole numbers
(fixed point), so that any order of summation gives the same prototypes, and they
are added per (language, dimension) across the cluster; only languages x
dimensions numbers reach the driver, and `MAX_LANGUAGES` bounds them.

Letters are lower-cased; each run of anything else is one blank. A null text, or
one without a letter, is `und` with score 0; so is every text when there is
nothing to learn from. Ties go to the first language by name. Repeated rows are
kept, extra columns are not read. Long texts are read whole: what is counted at once
is a slice of the symbols, and each slice begins with the last two of the one before,
so that no trigram is lost or added at a cut.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, documents, fresh, map_text, slices

DIMENSIONS = 1024
SEED = 20_011
FIXED_POINT = 1 << 20
MAX_LANGUAGES = 4096
SLICE = 1 << 20
DENSE = 1 << 21

FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


class Encoder:
    """Texts to vectors; one per Python worker and number of dimensions."""

    _open: dict[tuple[int, int], Encoder] = {}

    def __init__(self, dimensions: int, seed: int):
        self.d, self.seed = dimensions, seed
        table = np.full(sys.maxunicode + 1, 32, np.int32)
        for c in range(sys.maxunicode + 1):
            if chr(c).isalpha():
                table[c] = c
        self.table = table
        self.letters: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, dimensions: int, seed: int) -> Encoder:
        key = dimensions, seed
        if key not in cls._open:
            cls._open[key] = cls(*key)
        return cls._open[key]

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            draw = np.random.Generator(np.random.PCG64([self.seed, code]))
            self.letters[code] = draw.integers(0, 2, self.d, np.int8) * np.int8(2) - np.int8(1)
        return self.letters[code]

    def symbols(self, text: str) -> np.ndarray:
        """Code points of letters, with single blanks around and between runs of them; empty without a letter."""
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.int32)
        codes = self.table[raw]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        codes = codes[keep]
        if not (codes != 32).any():
            return codes[:0]
        return np.concatenate([[32] * int(codes[0] != 32), codes, [32] * int(codes[-1] != 32)]).astype(np.int32)

    def vectors(self, texts: list[str]) -> np.ndarray:
        """A row for each text: the sum of its trigrams' vectors."""
        out = np.zeros((len(texts), self.d), np.float64)
        rows, parts = [], []
        for i, text in enumerate(texts):
            whole = self.symbols(text)
            for at in range(0, max(len(whole) - 2, 0), SLICE):
                rows.append(i)
                parts.append(whole[at : at + SLICE + 2])
                if sum(map(len, parts)) > SLICE:
                    self._add(out, rows, parts)
                    rows, parts = [], []
        if parts:
            self._add(out, rows, parts)
        return out

    def _add(self, out: np.ndarray, rows: list[int], parts: list[np.ndarray]) -> None:
        owner = np.repeat(np.array(rows), [len(p) - 2 for p in parts])
        flat = np.concatenate(parts)
        alphabet = np.unique(flat)
        size = len(alphabet)
        number = np.zeros(int(alphabet[-1]) + 1, np.int64)
        number[alphabet] = np.arange(size)
        coded = number[flat]
        tri = coded[:-2] * (size * size) + coded[1:-1] * size + coded[2:]
        stops = np.cumsum([len(p) for p in parts])[:-1]
        if len(stops):
            inside = np.ones(len(tri), bool)
            inside[stops - 1] = inside[stops - 2] = False
            tri = tri[inside]
        if size**3 <= DENSE:
            present = np.flatnonzero(np.bincount(tri, minlength=size**3))
            place = np.zeros(size**3, np.int64)
            place[present] = np.arange(len(present))
            tri = place[tri]
        else:
            present, tri = np.unique(tri, return_inverse=True)
        letters = np.stack([self.letter(int(c)) for c in alphabet])
        first, second = np.roll(letters, 2, 1), np.roll(letters, 1, 1)
        used, local = np.unique(owner, return_inverse=True)
        block = 4096
        for lo in range(0, len(present), block):
            p = present[lo : lo + block]
            book = first[p // (size * size)] * second[p // size % size] * letters[p % size]
            here = (tri >= lo) & (tri < lo + block) if len(present) > block else slice(None)
            counts = np.bincount(local[here] * len(p) + (tri[here] - lo), minlength=len(used) * len(p))
            out[used] += counts.reshape(len(used), len(p)).astype(np.float32) @ book.astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def prototypes(
    training: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED
) -> tuple[list[str], np.ndarray]:
    """Language names, sorted, and their unit prototypes, from all rows with both text and language."""
    source = training.select(col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text"))
    schema = "lang string, dim int, value long"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = Encoder.of(dimensions, seed), {}
        for batch in batches:
            for at, n in slices(batch.column(1)):
                part = batch.slice(at, n)
                rows = unit(encoder.vectors(part.column(1).to_pylist()))
                langs = np.array(part.column(0).to_pylist(), object)
                for lang in set(langs):
                    add = np.rint(rows[langs == lang] * FIXED_POINT).astype(np.int64).sum(0)
                    total[lang] = total.get(lang, 0) + add
                if len(total) > 64:
                    yield from emit(total)
                    total = {}
        yield from emit(total)

    def emit(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, values in total.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(values), pa.string()),
                    "dim": pa.array(np.arange(len(values)), pa.int32()),
                    "value": pa.array(values, pa.int64()),
                }
            )

    summed = (
        source.where("text is not null and lang is not null")
        .mapInArrow(sums, schema)
        .groupBy("lang", "dim")
        .agg(F.sum("value").alias("value"))
    )
    rows = summed.limit(MAX_LANGUAGES * dimensions + 1).toArrow()  # 20 bytes a number or so, 80 MB at most
    if rows.num_rows > MAX_LANGUAGES * dimensions:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; this method keeps a prototype of each in memory")
    coded = rows.column("lang").combine_chunks().dictionary_encode()
    names = sorted(coded.dictionary.to_pylist())
    place = np.array([names.index(n) for n in coded.dictionary.to_pylist()], np.int64)
    out = np.zeros((len(names), dimensions))
    if names:
        out[place[coded.indices.to_numpy()], rows.column("dim").to_numpy()] = rows.column("value").to_numpy()
    return names, unit(out)


def predict(
    df: DataFrame,
    model: tuple[list[str], np.ndarray],
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    out: str = "language",
    seed: int = SEED,
) -> DataFrame:
    """`keep` columns and a struct `out` of the predicted language and its cosine (0 if negative); renamed on a clash."""
    names, protos = model
    out = fresh(out, keep)
    dimensions = protos.shape[1]

    def run(texts: list[str | None]) -> dict[str, list]:
        rows = unit(Encoder.of(dimensions, seed).vectors([t or "" for t in texts]))
        none = ~rows.any(axis=1)
        if not names:
            return {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)}
        cosines = rows @ protos.T
        best = cosines.argmax(1)
        score = np.clip(cosines[np.arange(len(texts)), best], 0, 1)
        return {
            "lang_pred": ["und" if n else names[b] for b, n in zip(best, none)],
            "score": np.where(none, 0.0, score).tolist(),
        }

    return map_text(df, text_col, run, FIELDS, keep, out)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(col(doc_id).cast("string")) % 4 == 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    # without an id there is no remainder; such rows are neither held out nor learned from
    model = prototypes(docs.where(~held_out()))
    got = predict(docs, model)
    out = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    return got.select("doc_id", out, F.col("language.lang_pred"), F.col("language.score"))
