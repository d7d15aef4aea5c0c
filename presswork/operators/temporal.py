"""Joins by time: the last row at or before a moment, and moments that lie within intervals.

Neither needs a task that holds all rows of a key: both cut time into pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, order: list[str] = (), hours: int = 24, within: int | None = None) -> DataFrame:
    """Each left row with `match`, the right row of its keys that is the last at or before its time, or null.

    Of right rows of one time the one that is last by `order` counts; `within` seconds limits how old it may be. Rows of both sides are put together and
    carried along in time, in pieces of `hours` for each key: a piece begins with what the pieces before it have
    left, which is one row for each piece. So a key that holds most rows is as many tasks as it has pieces. Left rows
    without a key or a time have no match; right ones take no part. Repeated left rows stay.
    """
    step = hours * 3_600_000_000
    by = [F.col(k) for k in keys]
    given = F.struct(*[F.col(c) for c in right.columns])
    known = right.where(F.col(right_at).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    at, tie = _micros(F.col(right_at)), F.struct(F.lit(1).alias("side"), *[F.col(c) for c in order]) if order else F.struct(F.lit(1).alias("side"))
    r = known.select(*by, at.alias("_at"), tie.alias("_tie"), given.alias("_right"))
    none = r.schema["_right"].dataType
    whole = F.col(left_at).isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    mine = left.select(*by, F.when(whole, _micros(F.col(left_at))).alias("_at"), F.struct(*[F.col(c) for c in left.columns]).alias("_left"), whole.alias("_whole"))
    rows = r.select(*keys, "_at", "_tie", "_right", F.lit(None).cast(mine.schema["_left"].dataType).alias("_left")).unionByName(
        mine.where("_whole").select(*keys, "_at", F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(none).alias("_right"), "_left")
    )
    rows = rows.withColumn("_piece", F.floor(F.col("_at") / step))
    # what each piece leaves behind, and so what the next one that has rows begins with
    best = F.struct("_at", "_tie")
    ends = rows.groupBy(*keys, "_piece").agg(F.max_by(F.struct("_at", "_right"), F.when(F.col("_right").isNotNull(), best)).alias("_end"))
    over = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_piece", F.last("_end", True).over(over).alias("_start"))
    inside = Window.partitionBy(*keys, "_piece").orderBy(F.col("_at"), F.col("_left").isNotNull(), F.col("_tie"))
    seen = F.last(F.when(F.col("_right").isNotNull(), F.struct("_at", "_right")), True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    carried = rows.withColumn("_seen", seen).where("_left is not null").drop("_right")
    found = carried.join(ends, [*keys, "_piece"], "left").withColumn("_last", F.coalesce("_seen", "_start"))
    match = F.col("_last._right")
    if within is not None:
        match = F.when(F.col("_at") - F.col("_last._at") <= within * 1_000_000, match)
    out = found.select(F.col("_left"), match.alias("match"))
    rest = mine.where("not _whole").select("_left", F.lit(None).cast(none).alias("match"))
    return out.unionByName(rest).select("_left.*", "match")


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """`point` and `span` of every point and interval of the same keys with start <= point < end.

    An interval is put into the pieces of time that it meets, on the finest level where those are at most two; a level's
    pieces are twice as long as those of the level before. A point looks into one piece of each level that there is, at most `LEVELS`.
    So both sides meet by equality, long intervals are not copied often, and a key with many rows is many pieces.
    Rows with a null key, time or bound, and intervals that are empty, take no part.
    """
    p = points.select(*keys, _micros(F.col(at)).alias("_at"), F.struct(*[F.col(c) for c in points.columns]).alias("point")).where("_at is not null")
    s = spans.select(*keys, _micros(F.col(start)).alias("_a"), _micros(F.col(end)).alias("_b"), F.struct(*[F.col(c) for c in spans.columns]).alias("span"))
    s = s.where("_a < _b")
    # an interval no longer than a piece meets two of them at most
    level = F.greatest(F.lit(FINEST), F.ceil(F.log2((F.col("_b") - F.col("_a")).cast("double"))).cast("int"))
    s = s.withColumn("_level", level)
    length = F.pow(F.lit(2.0), F.col("_level")).cast("long")
    s = s.withColumn("_piece", F.explode(F.sequence(F.floor(F.col("_a") / length), F.floor((F.col("_b") - 1) / length))))
    levels = sorted(r[0] for r in s.select("_level").distinct().collect())  # at most LEVELS of them
    looks = F.array(*[F.struct(F.lit(k).alias("_level"), F.floor(F.col("_at") / float(1 << k)).alias("_piece")) for k in levels])
    if not levels:
        return p.join(s.limit(0), keys).select("point", "span")
    p = p.select("*", F.inline(looks))
    met = p.join(s, [*keys, "_level", "_piece"])
    return met.where((F.col("_a") <= F.col("_at")) & (F.col("_at") < F.col("_b"))).select("point", "span")


#: Pieces of the finest level last about a second; those of the coarsest hold all times.
FINEST, LEVELS = 20, 44
