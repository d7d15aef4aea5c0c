"""The latest version of every story as the state of a stream, with timers that let old ones go."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MICROS, BUCKET = "_version_micros", "_key_bucket"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts of the state; a checkpoint keeps the number that it was begun with.
BUCKETS = 4_096


class Latest(StatefulProcessor):
    """Keeps one version for each key. A row replaces it if its version is newer; ties keep what is there.

    Keys are kept by buckets of their hash: a bucket is read, written and timed as one, so that a batch has a few calls to the
    state store for each bucket that it meets, not for each key. The bucket's timer stands at its oldest version, and a story goes when the
    watermark has passed its own. Rows of the output are the key, the version that now counts, and what happened: inserted,
    updated, unchanged or evicted; one row for each key of a batch.
    """

    def __init__(self, key: str, version: str, stories: T.StructType):
        self.version, self.stories = version, stories
        self.key_at, self.version_at = stories.names.index(key), stories.names.index(version)
        self.made = Row(*stories.names, "action")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("stories", T.StructType([T.StructField("stories", T.ArrayType(self.stories))]))

    def _load(self) -> dict[object, tuple]:
        held = self.bucket.get()
        return {} if held is None else {row[self.key_at]: tuple(row) for row in held[0]}

    def _store(self, stories: dict[object, tuple]) -> None:
        if stories:
            self.bucket.update((list(stories.values()),))
        else:
            self.bucket.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        due = [row[self.version_at] for row in stories.values() if row[self.version_at] is not None]
        if due:
            self.handle.registerTimer(min(due) // 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, stories, actions = self.version_at, self._load(), {}
        for row in rows:
            now = tuple(row[n] for n in self.stories.names)
            one = now[self.key_at]
            before = stories.get(one)
            if before is None:
                stories[one], actions[one] = now, "inserted"
                continue
            actions.setdefault(one, "unchanged")
            if now[at] is not None and (before[at] is None or now[at] > before[at]):
                stories[one] = now
                actions[one] = "inserted" if actions[one] == "inserted" else "updated"
        if any(action != "unchanged" for action in actions.values()):
            self._store(stories)
        return iter([self.made(*stories[one], action) for one, action in actions.items()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed, at, stories = timerValues.getCurrentWatermarkInMs(), self.version_at, self._load()
        gone = [row for row in stories.values() if row[at] is not None and row[at] // 1000 <= passed]
        for row in gone:
            del stories[row[self.key_at]]
        self._store(stories)
        return iter([self.made(*row, "evicted") for row in gone])

    def close(self) -> None:
        pass


def latest(stream: DataFrame, key: str = "id", version: str = "updated", retention: str = "90 days", buckets: int = BUCKETS) -> DataFrame:
    """Changes of the latest version of each key; versions that the newest one is `retention` ahead of are evicted, or never taken.

    The state is a version of each key, in RocksDB, in `buckets` parts that are dealt to tasks. A batch reads and writes the parts that its
    keys are in, so there should be many enough for a part to stay small. `version` is a timestamp.
    Rows with a null key are left out. The state store of the session must be RocksDB's (`PROVIDER`).
    """
    rows = stream.where(F.col(key).isNotNull()).withColumn(version, F.col(version).cast("timestamp")).withWatermark(version, retention)
    rows = rows.withColumn(MICROS, F.unix_micros(version))  # numbers compare, whatever zone a time was read with
    stories = T.StructType([T.StructField(f.name, f.dataType, True) for f in [rows.schema[key], *(f for f in rows.schema.fields if f.name != key)]])
    out = T.StructType([*stories.fields, T.StructField("action", T.StringType(), True)])
    dealt = rows.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).groupBy(BUCKET)
    return dealt.transformWithState(Latest(key, MICROS, stories), out, "Update", "EventTime").drop(MICROS)
