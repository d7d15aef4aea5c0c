"""Free text found through an index of trigrams: a search reads the postings of its terms and the rows that have them all.

The index is a table (gram, ids), dealt to `BUCKETS` folders by the gram's hash and sorted by it, so that a
term opens as many folders as it has grams, and in them only the row groups that hold these. Tasks turn some megabytes of texts
at a time into one row for each gram, so what is shuffled and sorted are lists, not a row for each gram of each text.
What the postings give is verified with the terms themselves. Terms of fewer than three characters have no gram; the search then scans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
#: Characters that are turned into lists at once.
PIECE = 1 << 21


def lists(ids: pa.Array, texts: list[str]) -> Iterator[tuple[list[str], pa.Array]]:
    """The distinct trigrams of texts, and with each the ids of the texts that have it, for pieces of `PIECE` characters at most.

    A longer text is cut where both sides keep the trigrams across, so its id can stand in the lists of several pieces.
    """
    size, n = sum(map(len, texts)), len(texts)
    if size <= PIECE:
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        seen = np.zeros(0x110000, bool)
        seen[codes] = True
        letters = np.flatnonzero(seen)
        if len(letters) ** 3 * n < 1 << 63:  # a trigram and a row fit one number, which they always do for one row
            if made := _sorted_lists(ids, texts, letters, (np.cumsum(seen) - 1)[codes]):
                yield made
            return
    if n > 1:
        yield from lists(ids[: n // 2], texts[: n // 2])
        yield from lists(ids[n // 2 :], texts[n // 2 :])
    else:
        yield from lists(ids, [texts[0][: size // 2 + 2]])
        yield from lists(ids, [texts[0][size // 2 :]])


def _sorted_lists(ids: pa.Array, texts: list[str], letters: np.ndarray, at: np.ndarray) -> tuple[list[str], pa.Array] | None:
    """The same for one piece, whose k-th character is `letters[at[k]]`."""
    a, n = len(letters), len(texts)
    row = np.repeat(np.arange(n), np.fromiter(map(len, texts), np.int64, n))
    key = ((at[:-2] * a + at[1:-1]) * a + at[2:]) * n + row[:-2]
    key = np.sort(key[row[:-2] == row[2:]])
    if not len(key):
        return None
    gram, row = np.divmod(key[np.r_[True, key[1:] != key[:-1]]], n)
    starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    gram = gram[starts]
    said = letters[np.stack([gram // (a * a), gram // a % a, gram % a], 1)].astype("<u4").tobytes().decode("utf-32-le")
    offsets = np.r_[starts, len(row)].astype(np.int32)
    return [said[k : k + 3] for k in range(0, len(said), 3)], pa.ListArray.from_arrays(offsets, ids.take(pa.array(row)))


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for said, ids in lists(batch.column("id"), batch.column("text").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(said), ids], ["gram", "ids"])


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


class Postings:
    """The index of a table's texts in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, df: DataFrame, id_col: str, text: Column) -> None:
        """Write the postings of the lower-case text; a gram that most rows have is split over files of its folder."""
        each = df.select(F.col(id_col).alias("id"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))
        kind = T.StructType().add("gram", T.StringType()).add("ids", T.ArrayType(each.schema["id"].dataType))
        dealt = each.mapInArrow(_inverted, kind).withColumn("bucket", _bucket(F.col("gram"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(self.path)

    def candidates(self, terms: list[str]) -> DataFrame | None:
        """`id` of the rows that have every gram of the terms, or None where no term has one."""
        wanted = sorted({t[k : k + 3] for t in map(str.lower, terms) for k in range(len(t) - 2)})
        if not wanted:
            return None
        buckets = [r.b for r in self.spark.createDataFrame([(g,) for g in wanted], "g string").select(_bucket(F.col("g")).alias("b")).distinct().collect()]
        rows = self.spark.read.parquet(self.path).where(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
        return rows.select("gram", F.explode("ids").alias("id")).groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select("id")

    def search(self, df: DataFrame, id_col: str, text: Column, terms: list[str]) -> DataFrame:
        """Rows whose lower-case text has every term."""
        low = F.lower(F.coalesce(text, F.lit("")))
        found = self.candidates(terms)
        some = df if found is None else df.join(found.withColumnRenamed("id", id_col), id_col, "left_semi").select(*df.columns)
        for t in terms:
            some = some.where(low.contains(t.lower()))
        return some
