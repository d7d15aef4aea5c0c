"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes that separate words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` become spaces, A-Z become a-z.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, taken: Iterable[str]) -> str:
    """`name`, with underscores before it until no column has it (Spark ignores case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def map_text(
    df: DataFrame,
    text_col: str,
    fn: Callable[[list[str | None]], dict[str, Sequence]],
    fields: T.StructType,
    keep: Sequence[str],
    out: str,
) -> DataFrame:
    """`keep` columns of `df` and a struct column `out` that `fn` derives from the texts; `out` must be none of `keep`.

    `fn` gets the texts of a slice of a batch and returns a list for each field.
    Rows stay where they are: one narrow Arrow pass, no shuffle, and slices of
    about a million characters bound what Python holds at once. A text that is kept goes to Python once.
    """
    once = text_col in keep and isinstance(df.schema[text_col].dataType, T.StringType)
    source = [] if once else [col(text_col).cast("string").alias(fresh("text_in", keep))]
    at_text = list(keep).index(text_col) if once else len(keep)
    inner = df.select(*[col(k) for k in keep], *source)
    schema = T.StructType([inner.schema[k] for k in keep] + [T.StructField(out, fields, True)])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            for at, size in slices(batch.column(at_text)):
                part = batch.slice(at, size)
                got = fn(part.column(at_text).to_pylist())
                made = pa.StructArray.from_arrays(
                    [pa.array(got[n], type=k) for n, k in zip(names, kinds)], names=names
                )
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], made], names=[*keep, out])

    return inner.mapInArrow(run, schema)


def slices(texts: pa.Array, chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows with about `chars` bytes of text; one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > chars:
            yield at, i - at
            at, total = i, 0
        total += n
    if len(sizes) > at:
        yield at, len(sizes) - at


#: Long texts else fill 64 MB a batch and task.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: A query's shuffle files go when it has ended, not when the driver happens to collect its garbage.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for the queries that are run inside.

    They hold for the whole session while that lasts: queries of other threads should use a session of their own.
    """
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir` of the session.

    Only on one machine (as in tests) a folder below the warehouse stands in where that is unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints").rstrip("/")


class Scratch:
    """Tables that cut the lineage of an operator's steps, written in the shared folder.

    Each call writes a table and gives it back as it is read, so executors may be
    lost at any time. `drop` deletes what is done with; leaving the block deletes all
    but the tables handed to `keep`, on which the operator's result rests.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/presswork-{uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.count = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[df for df, _ in self.paths.values()])

    def __call__(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        with settings(self.spark, TIDY):
            df.write.parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(made)] = made, path
        return made

    def drop(self, *tables: DataFrame) -> None:
        """Delete some of the tables; others are left alone."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in tables:
            if id(df) in self.paths:
                target = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df))[1])
                target.getFileSystem(conf).delete(target, True)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write a table, or leave one that was written, for good."""
        made = df if id(df) in self.paths else self(df)
        del self.paths[id(made)]
        return made


def save(df: DataFrame) -> DataFrame:
    """A table of its own in the shared folder, for good."""
    return Scratch(df.sparkSession).keep(df)


#: Filters have a bit for every `SPARSE` ids, and no more than 2^`MOST_BITS` bits (32 MB), whatever the number of ids.
SPARSE = 32
MOST_BITS = 28


class Marks:
    """A filter of 64-bit ids: the low bits of each are set. It lets others through, but never loses one."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    @classmethod
    def of(cls, ids: DataFrame, column: str) -> Marks:
        """A filter sized by the number of ids; blocks of 2^15 bits are put together where their ids meet."""
        bits = min(MOST_BITS, max(16, (SPARSE * ids.count()).bit_length()))
        low = ids.select(col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias("p"))
        low = low.select(F.expr("p div 32768").alias("k"), F.expr("p % 32768").alias("p")).repartition("k")
        table = np.zeros((1 << bits) // 8, np.uint8)
        for r in low.groupBy("k").agg(F.bitmap_construct_agg("p").alias("map")).collect():
            table[r.k * 4096 : (r.k + 1) * 4096] = np.frombuffer(r.map, np.uint8)
        return cls(bits, table)

    def __contains__(self, one: int) -> bool:
        p = one & ((1 << self.bits) - 1)
        return bool(self.table[p >> 3] >> (p & 7) & 1)

    def has(self, ids: np.ndarray) -> np.ndarray:
        """Which of some unsigned 64-bit ids may be among them."""
        p = ids & np.uint64((1 << self.bits) - 1)
        return (self.table[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
