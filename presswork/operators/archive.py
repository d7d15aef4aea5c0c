"""The day-partitioned archive: upsert, moves between days, retention, audits, re-keying.

State is a Parquet table partitioned by day, and an index of (id, day) dealt to buckets by
the id's hash. A batch looks its ids up in the index, and then meets only the partitions
it touches: the days that it has stories in, and those that a story leaves. They are
written to a staging folder first and replaced dynamically, so nothing reads what it overwrites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswork.functions.scalars import clean_title, story_id

ID_SHAPE = "^s[0-9a-f]{8}$"


def storable(df: DataFrame) -> DataFrame:
    """Rows with a well-formed id and a day."""
    return df.where(F.col("id").rlike(ID_SHAPE) & F.col("day").isNotNull())


def merge(stored: DataFrame, incoming: DataFrame, key: str = "id", version: str = "updated") -> DataFrame:
    """Latest version of each key over both inputs, with its `action`.

    A stored row stays unless an incoming one is newer; of several incoming rows the
    last version counts. The day of a story is that of its latest version, so a story
    that moved leaves its old day. Actions: inserted, updated, unchanged, kept (not in the batch).
    One aggregation, with partial results before the shuffle.
    """
    rest = [c for c in stored.columns if c != key]
    both = stored.select(key, F.struct(*rest).alias("_row"), F.lit(0).alias("_new"))
    both = both.unionByName(incoming.select(key, F.struct(*rest).alias("_row"), F.lit(1).alias("_new")))
    # a missing version is the oldest; ties keep what is stored
    when = F.col("_row")[version]
    rank = F.struct(when.isNotNull(), when, -F.col("_new"))
    per = both.groupBy(key).agg(
        F.max_by(F.struct("_row", "_new"), rank).alias("_best"), F.min("_new").alias("_first"), F.max("_new").alias("_last")
    )
    action = F.when(F.col("_first") == 1, "inserted").when(F.col("_best._new") == 1, "updated").when(F.col("_last") == 1, "unchanged").otherwise("kept")
    made = per.select(key, *[F.col("_best._row")[c].alias(c) for c in rest], action.alias("action"))
    return made.select(*stored.columns, "action")


def moves(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Ids whose day in the batch differs from the stored one."""
    old = stored.select("id", F.col("day").alias("from_day"))
    return incoming.select("id", F.col("day").alias("to_day")).join(old, "id").where("from_day <> to_day")


def prune(df: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Rows of the last `days` days; on a partitioned table this only drops partitions."""
    return df.where(F.col("day") >= F.date_sub(F.to_date(as_of), days))


def remove(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose id is not in `gone`."""
    return df.join(gone.select("id"), "id", "left_anti")


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Ids that stand in more than one day."""
    per = df.groupBy("id").agg(F.countDistinct("day").alias("days"), F.count("*").alias("n"))
    return per.where("days > 1")


def clean_id(aliases: list[str]) -> Column:
    return story_id(clean_title(F.col("title"), aliases)["title"], F.col("url"))


def inconsistent_ids(df: DataFrame, aliases: list[str]) -> DataFrame:
    """Rows whose id is not that of their cleaned title and URL."""
    return df.withColumn("clean_id", clean_id(aliases)).where("id <> clean_id")


def rekey(df: DataFrame, aliases: list[str]) -> DataFrame:
    """One row per clean id: the survivor's fields, what it lacks from the others, and how many went in.

    The survivor is the latest, then the one with the longest description, then the smallest id.
    """
    order = Window.partitionBy("clean_id").orderBy(F.desc("updated"), F.length("description").desc_nulls_last(), "id")
    ranked = df.withColumn("clean_id", clean_id(aliases)).withColumn("_n", F.row_number().over(order))
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("_n"))).alias(c)
    return ranked.groupBy("clean_id").agg(
        F.min_by("title", "_n").alias("title"),
        first("description"),
        F.min_by("day", "_n").alias("day"),
        F.array_sort(F.collect_set("source_id")).alias("sources"),
        F.count("*").alias("merged"),
        F.count_if(F.col("id") != F.col("clean_id")).alias("rekeyed"),
    )


#: Lists of stories that are joined when they turn out to be one, and fields that are filled from the others.
LISTS = ("sources", "relatedStoryIds", "tags", "companies", "people", "models", "technologies", "countries")
FILLED = ("description", "image", "author")


def rekeyed(df: DataFrame, aliases: list[str], by_address: bool = True) -> DataFrame:
    """The archive's rows under the ids of their cleaned titles, with `fate` and how they came about.

    Rows of one clean id and one address are one story: the survivor (see `rekey`) takes the clean id, title and
    fingerprint, the union of all lists in order of survival, and what fields it lacks. Where a clean id has rows of several addresses, only
    those of the most frequent one (then the one with the first day and id) are joined; the others are `danger` and keep their ids.
    Without `by_address` a clean id alone is one story; ids have 32 bits, so in large archives some stories of several addresses share one.
    `fate` is kept or danger; `dropped` counts rows that went into one, `rekeyed` and `moved` tell whether its id and its day changed.
    Rows that then share day and id are a collision: `collision` numbers them from 1, all but the first of them should go.
    """
    from presswork.functions.scalars import canonical_url_key, fingerprint

    lists, filled = ([c for c in some if c in df.columns] for some in (LISTS, FILLED))
    key = F.coalesce(F.nullif(canonical_url_key(F.col("url")), F.lit("")), F.col("url"), F.lit("")) if by_address else F.lit("")
    rows = df.withColumns({"_title": clean_title(F.col("title"), aliases)["title"], "_key": key})
    rows = rows.withColumn("_title", F.coalesce(F.nullif("_title", F.lit("")), F.col("title"))).withColumn("clean_id", story_id(F.col("_title"), F.col("url")))
    sizes = rows.groupBy("clean_id", "_key").agg(F.count("*").alias("n"), F.min(F.struct("day", "id")).alias("first"))
    main = sizes.groupBy("clean_id").agg(F.min_by("_key", F.struct(-F.col("n"), F.col("first"))).alias("_main"))
    rows = rows.join(main, "clean_id").withColumn("_is_main", F.col("_key") == F.col("_main"))
    survival = F.struct(-F.coalesce(F.unix_micros(F.col("updated").cast("timestamp")), F.lit(0)), -F.length(F.coalesce("description", F.lit(""))), F.col("id"))
    rest = [c for c in df.columns if c not in (*lists, *filled)]
    home = F.coalesce(F.to_date("published"), F.col("day")) if "published" in df.columns else F.col("day")
    rows = rows.withColumns({"_rank": survival, "_home": home})
    taken = rows.where("_is_main").groupBy("clean_id").agg(
        F.min_by(F.struct(*rest, "_title", "_home"), "_rank").alias("w"),
        *[F.min_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("_rank"))).alias(c) for c in filled],
        *[F.sort_array(F.collect_list(F.struct(F.col("_rank").alias("r"), F.col(c).alias("v")))).alias(c) for c in lists],
        (F.count("*") - 1).alias("dropped"),
    )
    joined = lambda c: F.array_distinct(F.flatten(F.filter(F.transform(c, lambda x: x["v"]), lambda v: v.isNotNull())))
    kind = dict(df.dtypes)
    fields = {c: F.col(f"w.{c}") for c in rest} | {c: F.col(c) for c in filled} | {c: joined(c) for c in lists}
    fields |= {"id": F.col("clean_id"), "title": F.col("w._title"), "day": F.col("w._home")}
    if "fingerprint" in kind:
        fields["fingerprint"] = fingerprint(F.col("w._title"), F.col("w.url"))
    if "reportedBy" in kind and "sources" in lists:
        fields["reportedBy"] = F.size(joined("sources")).cast(kind["reportedBy"])
    shown = [fields[c].alias(c) for c in df.columns]
    kept = taken.select(
        *shown, F.lit("kept").alias("fate"), "clean_id", "dropped", (F.col("w.id") != F.col("clean_id")).alias("rekeyed"), (F.col("w.day") != F.col("w._home")).alias("moved")
    )
    strays = rows.where("not _is_main").select(
        *[F.col("_home").alias(c) if c == "day" else F.col(c) for c in df.columns], F.lit("danger").alias("fate"), "clean_id",
        F.lit(0).cast("long").alias("dropped"), F.lit(False).alias("rekeyed"), (F.col("day") != F.col("_home")).alias("moved"),
    )
    per = Window.partitionBy("day", "id").orderBy(F.desc("fate"), "clean_id")
    return kept.unionByName(strays).withColumn("collision", F.row_number().over(per))


def rekey_statistics(done: DataFrame) -> DataFrame:
    """What `rekeyed` did: input rows, rows unchanged, re-keyed, merged away, moved, in danger, and collisions."""
    kept = F.col("fate") == "kept"
    plain = kept & ~F.col("rekeyed") & ~F.col("moved") & (F.col("dropped") == 0)
    return done.agg(
        (F.count("*") + F.coalesce(F.sum("dropped"), F.lit(0))).alias("input_rows"), F.count_if(plain).alias("unchanged"),
        F.count_if(kept & F.col("rekeyed")).alias("rekeyed"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("merged"),
        F.count_if(kept & F.col("moved")).alias("moved"), F.count_if(~kept).alias("danger"), F.count_if(F.col("collision") > 1).alias("collisions"),
    )


def unified(df: DataFrame) -> DataFrame:
    """One row for each id: the latest version, then the one of the last day."""
    rest = [c for c in df.columns if c != "id"]
    best = df.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("updated", "day")).alias("_row"))
    return best.select("id", *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def stale_copies(df: DataFrame, index: DataFrame) -> DataFrame:
    """(id, day) of rows whose id also stands in its home day: the one that the index tells, else its first day."""
    twice = df.groupBy("id").agg(F.min("day").alias("first_day"), F.countDistinct("day").alias("days")).where("days > 1")
    home = twice.join(index.select("id", F.col("day").alias("home")), "id", "left").select("id", F.coalesce("home", "first_day").alias("home"))
    return df.select("id", "day").join(home, "id").where("day <> home").select("id", "day").distinct()


def id_index(df: DataFrame) -> DataFrame:
    """(id, day, source_id, updated) of the stories, as the index tells them."""
    return df.select("id", "day", *[c for c in ("source_id", "updated") if c in df.columns])


def days_with_ids(df: DataFrame) -> DataFrame:
    """The ids of each day, sorted: an export of the index; a day's stories are one row."""
    return df.groupBy("day").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("id")).alias("ids"))


def day_index(df: DataFrame) -> DataFrame:
    """Stories and first and last id of each day."""
    return df.groupBy("day").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def metrics(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("day").alias("days"), F.count("*").alias("stories"))


BUCKETS = 16


class Archive:
    """The table in a folder that Spark can read and write; its index lies beside it."""

    def __init__(self, spark: SparkSession, path: str, schema=None):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _table(self, path: str) -> DataFrame | None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(place) or not any(not x.getPath().getName().startswith(("_", ".")) for x in files.listStatus(place)):
            return None  # not there yet, or its last partition is gone
        return self.spark.read.parquet(path)

    def read(self) -> DataFrame | None:
        rows = self._table(self.path)
        return rows if rows is None else rows.withColumn("day", F.col("day").cast("date"))

    def read_day(self, day) -> DataFrame | None:
        """The rows of one day, of its partition only."""
        rows = self.read()
        return rows if rows is None else rows.where(F.col("day") == F.lit(day).cast("date")).orderBy("id")

    def read_by_id(self, id_: str) -> DataFrame | None:
        """The row of an id, from the partition that the index tells."""
        index = self.index()
        if index is None:
            return None
        found = index.where((F.col("bucket") == bucket_of(F.lit(id_))) & (F.col("id") == id_)).select("day").first()
        return None if found is None else self.read_day(found.day).where(F.col("id") == id_)

    def days(self) -> list[str]:
        """The days that have a partition, by their names."""
        rows = self._table(self.path)
        return [] if rows is None else sorted(str(r.day) for r in rows.select("day").distinct().collect())

    def index(self) -> DataFrame | None:
        """(id, day, bucket) of all rows."""
        rows = self._table(self.path + "_index")
        return rows if rows is None else rows.withColumn("day", F.col("day").cast("date"))

    def rebuild_index(self) -> None:
        rows = self.read()
        if rows is not None:
            self._write(rows.select("id", "day").withColumn("bucket", bucket_of(F.col("id"))), self.path + "_index", "bucket")

    def _write(self, rows: DataFrame, path: str, by: str) -> None:
        """Replace the partitions that the rows have."""
        rows.write.mode("overwrite").parquet(path + "_staged")
        ready = self.spark.read.parquet(path + "_staged")
        ordered = ready.repartition(by).sortWithinPartitions("id")
        ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)

    def _reindex(self, gone: DataFrame | None, new: DataFrame) -> None:
        """Take (id, day) rows out of the index and put rows in, whose ids leave their old days; other buckets are not read."""
        index = self.index()
        new = new.select("id", "day").withColumn("bucket", bucket_of(F.col("id")))
        if index is None:
            return self._write(new, self.path + "_index", "bucket")
        ids = new.select("id") if gone is None else new.select("id").unionByName(gone.select("id"))
        buckets = [r.b for r in ids.select(bucket_of(F.col("id")).alias("b")).distinct().collect()]
        left = index.where(F.col("bucket").isin(buckets)).join(new.select("id"), "id", "left_anti")
        if gone is not None:
            left = left.join(gone.select("id", "day").distinct(), ["id", "day"], "left_anti")
        left = left.select("id", "day", "bucket").unionByName(new)
        full = {r.bucket for r in left.select("bucket").distinct().collect()}
        self._write(left, self.path + "_index", "bucket")
        for bucket in set(buckets) - full:
            self._delete(f"{self.path}_index/bucket={bucket}")

    def touched(self, ids: DataFrame) -> DataFrame:
        """(id, day) of ids that are stored, from their buckets of the index."""
        buckets = [r.b for r in ids.select(bucket_of(F.col("id")).alias("b")).distinct().collect()]
        return self.index().where(F.col("bucket").isin(buckets)).join(ids.select("id").distinct(), "id", "left_semi").select("id", "day")

    def upsert(self, batch: DataFrame, as_of: Column | None = None, retention: int | None = None) -> DataFrame:
        """Merge a batch; what the retention would drop is never written.

        Returns one row: inserted, updated, unchanged, upserted (the first two), days and total (days written, rows in
        them) and skipped (rows that can't be stored or are too old).
        """
        given = batch.count()
        batch = storable(batch)
        if retention is not None and as_of is not None:
            batch = prune(batch, as_of, retention)
        used = batch.count()
        stored = self.read()
        if stored is None:
            met, days = batch.limit(0), {r.day for r in batch.select("day").distinct().collect()}
        else:
            if self.index() is None:
                self.rebuild_index()
            old = self.touched(batch)
            days = {r.day for r in batch.select("day").unionByName(old.select("day")).distinct().collect()}
            met = stored.where(F.col("day").isin(days)).select(*batch.columns)  # these partitions only
        merge(met, batch).write.mode("overwrite").parquet(self.path + "_merged")
        merged = self.spark.read.parquet(self.path + "_merged")
        full = {r.day for r in merged.select("day").distinct().collect()}
        self._write(merged.drop("action"), self.path, "day")
        for day in days - full:  # a partition that lost its last story
            self._delete(f"{self.path}/day={day}")
        self._reindex(None, merged.where("action in ('inserted', 'updated')"))
        n = {a: F.count_if(F.col("action") == a) for a in ("inserted", "updated", "unchanged")}
        return merged.agg(
            *[c.alias(a) for a, c in n.items()], (n["inserted"] + n["updated"]).alias("upserted"), F.lit(len(full)).alias("days"),
            F.count("*").alias("total"), F.lit(given - used).alias("skipped"),
        )

    def remove(self, gone: DataFrame) -> int:
        """Delete rows by id, or by (id, day) if `gone` has both; returns how many went. Other partitions are not read."""
        stored = self.read()
        if stored is None:
            return 0
        if self.index() is None:
            self.rebuild_index()
        keys = ["id", "day"] if "day" in gone.columns else ["id"]
        gone = gone.select(*keys).distinct()
        days = {r.day for r in (gone if len(keys) == 2 else self.touched(gone)).select("day").distinct().collect()}
        met = stored.where(F.col("day").isin(days))
        lost = met.join(gone, keys, "left_semi").select("id", "day")
        lost.write.mode("overwrite").parquet(self.path + "_lost")
        lost = self.spark.read.parquet(self.path + "_lost")
        n = lost.count()
        if n:
            left = met.join(gone, keys, "left_anti")
            full = {r.day for r in left.select("day").distinct().collect()}
            self._write(left.select(*stored.columns), self.path, "day")
            for day in days - full:
                self._delete(f"{self.path}/day={day}")
            self._reindex(lost, lost.limit(0))
        return n

    def cleanup(self) -> int:
        """Delete copies of ids outside their home day; returns how many."""
        rows = self.read()
        if rows is None:
            return 0
        index = self.index()
        home = rows.limit(0).select("id", "day") if index is None else index.groupBy("id").agg(F.min("day").alias("day"))
        stale_copies(rows, home).write.mode("overwrite").parquet(self.path + "_stale")
        return self.remove(self.spark.read.parquet(self.path + "_stale"))

    def rekey(self, aliases: list[str], write: bool = True) -> DataFrame:
        """`rekeyed` over the archive, statistics of it, and its rows and index written anew; without `write` a dry run."""
        rows = self.read()
        rekeyed(rows, aliases).write.mode("overwrite").parquet(self.path + "_rekeyed")
        done = self.spark.read.parquet(self.path + "_rekeyed")
        if write:
            before = set(self.days())
            final = done.where("collision = 1").select(*rows.columns)
            full = {str(r.day) for r in final.select("day").distinct().collect()}
            self._write(final, self.path, "day")
            for day in before - full:
                self._delete(f"{self.path}/day={day}")
            self._delete(self.path + "_index")
            self.rebuild_index()
        return rekey_statistics(done)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def prune(self, as_of: str, days: int = 90) -> list[str]:
        """Drop partitions before the retention limit, by their names only, and their ids from the index."""
        rows = self.read()
        if rows is None:
            return []
        old = rows.select("day").distinct().where(F.col("day") < F.date_sub(F.to_date(F.lit(as_of)), days))
        gone = [r.day for r in old.collect()]
        if gone:
            lost = rows.where(F.col("day").isin(gone)).select("id", "day")
            lost.write.mode("overwrite").parquet(self.path + "_lost")
            for day in gone:
                self._delete(f"{self.path}/day={day}")
            if self.index() is not None:
                lost = self.spark.read.parquet(self.path + "_lost")
                self._reindex(lost, lost.limit(0))
        return sorted(map(str, gone))

    def check(self, aliases: list[str] | None = None) -> None:
        """Raise if an id stands in two days, or does not fit its title."""
        rows = self.read()
        if rows is None:
            return
        if not duplicate_ids(rows).isEmpty():
            raise ValueError("ids in more than one day")
        if aliases is not None and not inconsistent_ids(rows, aliases).isEmpty():
            raise ValueError("ids that do not fit their titles")


def bucket_of(id_: Column) -> Column:
    """The part of the index that an id is in."""
    return F.pmod(F.xxhash64(id_), F.lit(BUCKETS)).cast("int")
