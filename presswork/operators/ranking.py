"""Row numbers and deep pages of a total order, without a task that sees all rows.

Rows are dealt to tasks by ranges of the order and sorted there. How many rows stand in each range is a table of
as many rows as there are ranges; its running sums, added to a row's place in its own range, are the row's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.operators.cluster import save

#: A partition's rows are numbered from 0 in the low bits.
BITS = 33


def numbered(df: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """All rows with their number, from 1; the keys should order them totally. Saved once, so that all steps see one order."""
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ordered = save(ordered.withColumn("_part", F.shiftright("_at", BITS)))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each range: that many a single task can add up
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.col("_at").bitwiseAND(F.lit((1 << BITS) - 1)) + F.coalesce("_before", F.lit(0)) + 1
    return ordered.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, place).select(*df.columns, name)


def first(df: DataFrame, keys: list[Column], limit: int, name: str = "rank") -> DataFrame:
    """The first rows with their number: a bounded top-k, which alone is numbered in one task."""
    return df.orderBy(*keys).limit(limit).withColumn(name, F.row_number().over(Window.orderBy(*keys)))


def page(df: DataFrame, keys: list[Column], number: int = 1, size: int = 48) -> DataFrame:
    """One page of the ordered rows, however deep; numbers beyond the ends give the nearest page."""
    rows = numbered(df, keys, "_rank")
    size = max(1, size)
    pages = max(1, -(-rows.count() // size))
    first = (min(max(1, number), pages) - 1) * size
    return rows.where(F.col("_rank").between(first + 1, first + size)).orderBy("_rank").drop("_rank")
