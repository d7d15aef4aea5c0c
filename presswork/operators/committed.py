"""An archive whose every change is one commit.

Below its folder lie

    data/day=…/_version=…/     the rows of a day, as some version wrote them
    index/bucket=…/_version=…/ (id, day, seq): where an id went; a null day: it is gone
    commits/<n>.json    version n: for each day the `_version` that counts, for each bucket of the index its parts

A change writes new folders beside the old ones, and counts when its manifest is renamed into `commits`; that
fails where another writer was first, and the change is then made again on what the other one left. So a driver or executor may be lost at any
moment: the last version stays readable, and what the lost change wrote is read by nobody and goes with `vacuum`.

The index is an extendible hash: a bucket holds the ids whose hash ends in its bits, and is split when it has more
than `bucket_rows` rows; the directory of the low bits stands in the manifest. A change appends one small part to each bucket
that it has ids in; a bucket with more than `most_parts` parts is written anew, alone. Parts carry Parquet's Bloom filters of their
ids, so that a point read opens few of them. So what a batch writes is bounded by the batch and the days it touches.
"""

from __future__ import annotations

import json
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.operators.archive import merge, prune, rekey_statistics, rekeyed, storable

INDEX = "id string, day date, seq long, bucket string, _version string"


class CommitConflict(RuntimeError):
    """Another writer has made this version."""


class CommittedArchive:
    """The archive in a folder that Spark can read and write."""

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = 1_000_000, most_parts: int = 8, attempts: int = 5):
        self.spark, self.path = spark, path.rstrip("/")
        self.bucket_rows, self.most_parts, self.attempts = bucket_rows, most_parts, attempts

    # -- files -------------------------------------------------------------

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, path: str) -> list[str]:
        files, place = self._place(path)
        return [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []

    def _delete(self, path: str) -> None:
        files, place = self._place(path)
        files.delete(place, True)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.path}/commits") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What counts at a version, by default the last one; without any, nothing does."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "days": {}, "depth": 0, "buckets": {"0-0": {"parts": [], "rows": 0}}, "schema": None}
        files, place = self._place(f"{self.path}/commits/{version}.json")
        stream = files.open(place)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _commit(self, new: dict) -> None:
        """One rename that never replaces a file."""
        files, made = self._place(f"{self.path}/commits/.{uuid4().hex}")
        out = files.create(made, False)
        out.write(json.dumps(new).encode())
        out.close()
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{new['version']}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(made, place, none)
        except Py4JJavaError as e:
            files.delete(made, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise CommitConflict(str(new["version"])) from e
            raise

    def _again(self, change):
        """Make a change, and make it anew where another writer was first."""
        for k in range(self.attempts):
            try:
                return change(self.manifest(), f"{uuid4().hex}")
            except CommitConflict:
                if k + 1 == self.attempts:
                    raise

    # -- reading -----------------------------------------------------------

    def _rows(self, m: dict, days=None) -> DataFrame | None:
        """The rows of the days that count; only these folders are listed."""
        if m["schema"] is None:
            return None
        schema = T.StructType.fromJson(m["schema"])
        paths = [f"{self.path}/data/day={d}/_version={x['v']}" for d, x in sorted(m["days"].items()) if days is None or d in days]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(T.StructType(schema.fields).add("_version", "string")).option("basePath", f"{self.path}/data").parquet(*paths)
        return rows.drop("_version")

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version, by default the last one."""
        return self._rows(self.manifest(version))

    def days(self) -> list[str]:
        return sorted(self.manifest()["days"])

    def read_day(self, day) -> DataFrame | None:
        rows = self._rows(self.manifest(), {str(day)})
        return rows if rows is None else rows.orderBy("id")

    def read_by_id(self, id_: str) -> DataFrame | None:
        """The row of an id, from the day that its bucket of the index tells."""
        m = self.manifest()
        name = self.spark.range(1).select(self._bucket(m, F.lit(id_)).alias("b")).first().b
        found = latest(self._index(m, [name]).where(F.col("id") == id_)).where("day is not null").first()
        return None if found is None else self._rows(m, {str(found.day)}).where(F.col("id") == id_)

    def index(self) -> DataFrame:
        """(id, day) of all ids."""
        m = self.manifest()
        return latest(self._index(m, list(m["buckets"]))).where("day is not null")

    # -- the index ---------------------------------------------------------

    @staticmethod
    def _bucket(m: dict, id_: Column) -> Column:
        """The bucket of an id: the directory has an entry for every end of a hash."""
        names = {}
        for name in m["buckets"]:
            depth, bits = map(int, name.split("-"))
            for k in range(bits, 1 << m["depth"], 1 << depth):
                names[k] = name
        directory = F.lit([names[k] for k in range(1 << m["depth"])])
        return F.element_at(directory, (F.xxhash64(id_).bitwiseAND(F.lit((1 << m["depth"]) - 1)) + 1).cast("int"))

    def _index(self, m: dict, names: list[str]) -> DataFrame:
        paths = [f"{self.path}/index/bucket={n}/_version={v}" for n in names for v in m["buckets"][n]["parts"]]
        if not paths:
            return self.spark.createDataFrame([], INDEX)
        return self.spark.read.schema(INDEX).option("basePath", f"{self.path}/index").parquet(*paths)

    def _find(self, m: dict, ids: DataFrame) -> DataFrame:
        """(id, day) of ids that are stored, from their buckets."""
        names = [r.b for r in ids.select(self._bucket(m, F.col("id")).alias("b")).distinct().collect()]
        return latest(self._index(m, names).join(ids.select("id").distinct(), "id", "left_semi")).where("day is not null")

    def _write_index(self, rows: DataFrame, v: str) -> dict[str, int]:
        """Parts of the index from (id, day, seq, bucket); their rows by bucket."""
        dealt = rows.withColumn("_version", F.lit(v)).repartition("bucket").sortWithinPartitions("bucket", "id")
        dealt.write.mode("append").option("parquet.bloom.filter.enabled#id", "true").partitionBy("bucket", "_version").parquet(f"{self.path}/index")
        return {r.bucket: r.n for r in rows.groupBy("bucket").agg(F.count("*").alias("n")).collect()}

    def _append(self, m: dict, changes: DataFrame, v: str) -> None:
        """Tell the index of m where ids are now; buckets with many parts or rows are written anew, and split."""
        rows = changes.select("id", "day", F.lit(m["version"] + 1).cast("long").alias("seq"), self._bucket(m, F.col("id")).alias("bucket"))
        for name, n in self._write_index(rows, v).items():
            b = m["buckets"][name]
            b["parts"], b["rows"] = [*b["parts"], v], b["rows"] + n
        full = [n for n, b in m["buckets"].items() if v in b["parts"] and (len(b["parts"]) > self.most_parts or b["rows"] > self.bucket_rows)]
        if not full:
            return
        now = self._index(m, full)
        now = now.groupBy("bucket", "id").agg(F.max_by("day", "seq").alias("day"), F.max("seq").alias("seq")).where("day is not null")
        sizes = {r.bucket: r.n for r in now.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        for name in full:
            del m["buckets"][name]
            depth, bits = map(int, name.split("-"))
            deeper = max(0, (sizes.get(name, 0) // self.bucket_rows).bit_length())
            for k in range(1 << deeper):
                m["buckets"][f"{depth + deeper}-{bits + (k << depth)}"] = {"parts": [], "rows": 0}
            m["depth"] = max(m["depth"], depth + deeper)
        for name, n in self._write_index(now.select("id", "day", "seq", self._bucket(m, F.col("id")).alias("bucket")), v + "c").items():
            m["buckets"][name] = {"parts": [v + "c"], "rows": n}

    # -- changes -----------------------------------------------------------

    def _staged(self, rows: DataFrame, v: str, name: str) -> DataFrame:
        """A table of this change alone: what is computed once can't differ later."""
        rows.write.parquet(f"{self.path}/work/{v}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/work/{v}/{name}")

    def _write_days(self, m: dict, rows: DataFrame, days: set[str], v: str) -> int:
        """New versions of some days; a large day is written by several tasks, a day without rows goes."""
        kept = {str(r.day): r.n for r in rows.groupBy("day").agg(F.count("*").alias("n")).collect()}
        m["schema"] = m["schema"] or json.loads(rows.select(*[F.col(c) for c in rows.columns]).schema.json())
        if kept:
            dealt = rows.hint("rebalance", "day").sortWithinPartitions("day", "id").withColumn("_version", F.lit(v))
            dealt.write.mode("append").partitionBy("day", "_version").parquet(f"{self.path}/data")
        for day in days:
            if day in kept:
                m["days"][day] = {"v": v, "rows": kept[day]}
            else:
                m["days"].pop(day, None)
        return sum(kept.values())

    def upsert(self, batch: DataFrame, as_of: Column | None = None, retention: int | None = None) -> DataFrame:
        """Merge a batch; what the retention would drop is never written.

        Returns one row: inserted, updated, unchanged, upserted (the first two), days and total (days written, rows in
        them) and skipped (rows that can't be stored or are too old).
        """

        def change(m: dict, v: str) -> DataFrame:
            given = self._staged(batch, v, "batch")
            fit = storable(given)
            if retention is not None and as_of is not None:
                fit = prune(fit, as_of, retention)
            old = self._staged(self._find(m, fit), v, "old")
            days = {str(r.day) for r in fit.select("day").unionByName(old.select("day")).distinct().collect()}
            stored = self._rows(m, days)
            met = fit.limit(0) if stored is None else stored.select(*fit.columns)
            merged = self._staged(merge(met, fit), v, "merged")
            total = self._write_days(m, merged.drop("action"), days, v)
            went = merged.where("action in ('inserted', 'updated')").select("id", "day").join(old.withColumnRenamed("day", "was"), "id", "left")
            self._append(m, went.where("was is null or was <> day").select("id", "day"), v)
            n = {a: F.count_if(F.col("action") == a) for a in ("inserted", "updated", "unchanged")}
            counts = merged.agg(*[c.alias(a) for a, c in n.items()]).first()
            lost = given.count() - fit.count()
            m["version"] += 1
            self._commit(m)
            self._delete(f"{self.path}/work/{v}")
            written = sum(d in m["days"] for d in days)
            return self.spark.createDataFrame(
                [(counts.inserted, counts.updated, counts.unchanged, counts.inserted + counts.updated, written, total, lost)],
                "inserted long, updated long, unchanged long, upserted long, days int, total long, skipped long",
            )

        return self._again(change)

    def remove(self, gone: DataFrame) -> int:
        """Delete rows by id, or by (id, day) if `gone` has both; returns how many went. Other days are not read."""
        keys = ["id", "day"] if "day" in gone.columns else ["id"]

        def change(m: dict, v: str) -> int:
            if m["schema"] is None:
                return 0
            asked = self._staged(gone.select(*keys).distinct(), v, "gone")
            at = self._staged(self._find(m, asked), v, "at")
            days = {str(r.day) for r in (asked if len(keys) == 2 else at).select("day").distinct().collect()} & set(m["days"])
            met = self._rows(m, days)
            n = met.join(asked, keys, "left_semi").count()
            if n:
                self._write_days(m, met.join(asked, keys, "left_anti"), days, v)
                # an id leaves the index where the index's own day is taken
                out = at if len(keys) == 1 else at.join(asked, keys, "left_semi")
                self._append(m, out.select("id", F.lit(None).cast("date").alias("day")), v)
                m["version"] += 1
                self._commit(m)
            self._delete(f"{self.path}/work/{v}")
            return n

        return self._again(change)

    def prune(self, as_of: str, days: int = 90) -> list[str]:
        """Drop the days before the retention limit, by their names, and their ids from the index."""

        def change(m: dict, v: str) -> list[str]:
            limit = str(self.spark.sql(f"select date_sub(date('{as_of}'), {int(days)}) as d").first().d)
            old = sorted(d for d in m["days"] if d < limit)
            if old:
                lost = self._staged(self._rows(m, set(old)).select("id", "day"), v, "lost")
                home = self._find(m, lost).join(lost, ["id", "day"], "left_semi")
                self._append(m, home.select("id", F.lit(None).cast("date").alias("day")), v)
                for day in old:
                    del m["days"][day]
                m["version"] += 1
                self._commit(m)
                self._delete(f"{self.path}/work/{v}")
            return old

        return self._again(change)

    def rekey(self, aliases: list[str], write: bool = True) -> DataFrame:
        """The rows under the ids of their clean titles (`rekeyed`), in one commit; without `write` a dry run. Returns statistics.

        The version before stays, so it is the backup: `restore` brings it back.
        """

        def change(m: dict, v: str) -> DataFrame:
            rows = self._rows(m)
            done = self._staged(rekeyed(rows, aliases), v, "rekeyed")
            told = rekey_statistics(done).first()
            if write:
                final = done.where("collision = 1").select(*rows.columns)
                days = set(m["days"]) | {str(r.day) for r in final.select("day").distinct().collect()}
                old, new = rows.select("id", "day"), final.select("id", "day")
                gone = old.join(new, "id", "left_anti").select("id", F.lit(None).cast("date").alias("day")).distinct()
                changes = self._staged(gone.unionByName(new.join(old, ["id", "day"], "left_anti")), v, "changes")
                self._write_days(m, final, days, v)
                self._append(m, changes, v)
                m["version"] += 1
                self._commit(m)
            self._delete(f"{self.path}/work/{v}")
            return self.spark.createDataFrame([told])

        return self._again(change)

    def restore(self, version: int) -> None:
        """Make a version that is still there the last one again, by a commit of its own."""

        def change(m: dict, _: str) -> None:
            self._commit({**self.manifest(version), "version": m["version"] + 1})

        self._again(change)

    def check(self) -> None:
        """Raise if an id stands in two days, or the index tells other places than the rows."""
        rows = self.read()
        if rows is None:
            return
        if rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").head(1):
            raise ValueError("ids in more than one day")
        told = self.index().select("id", "day")
        if rows.select("id", "day").exceptAll(told).head(1) or told.exceptAll(rows.select("id", "day")).head(1):
            raise ValueError("the index and the rows differ")

    def vacuum(self, keep: int = 1) -> int:
        """Delete what none of the last `keep` versions needs, when no writer is at work; returns how many folders went."""
        versions = self.versions()
        kept = [self.manifest(n) for n in versions[-keep:]]
        used = {f"data/day={d}/_version={x['v']}" for m in kept for d, x in m["days"].items()}
        used |= {f"index/bucket={n}/_version={v}" for m in kept for n, b in m["buckets"].items() for v in b["parts"]}
        there = [f"{top}/{a}/{b}" for top in ("data", "index") for a in self._names(f"{self.path}/{top}") if "=" in a for b in self._names(f"{self.path}/{top}/{a}")]
        there += [f"work/{v}" for v in self._names(f"{self.path}/work")] + [f"commits/{n}.json" for n in versions[:-keep]]
        gone = [p for p in there if p not in used]
        for p in gone:
            self._delete(f"{self.path}/{p}")
        return len(gone)


def latest(index: DataFrame) -> DataFrame:
    """(id, day) as the last part tells it."""
    return index.groupBy("id").agg(F.max_by("day", "seq").alias("day"))
