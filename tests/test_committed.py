"""Commits of the archive: lost writers, several writers, growth of the index, and the same results as the plain one."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from presswork.operators.archive import Archive
from presswork.operators.committed import CommitConflict, CommittedArchive

SCHEMA = "id string, day date, updated timestamp, title string"


def story(n, day=1, hour=0, title="t"):
    at = datetime(2026, 1, 1) + timedelta(days=day - 1, hours=hour)
    return (f"s{n:08x}", at.date(), at, title)


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def state(box, version=None):
    rows = box.read() if version is None else box.read(version)
    return set() if rows is None else {tuple(r) for r in rows.select("id", "day", "updated", "title").collect()}


def test_batches_give_what_the_plain_archive_has(spark, make, tmp_path):
    rnd = random.Random(3)
    plain, box = Archive(spark, f"{tmp_path}/plain"), CommittedArchive(spark, f"{tmp_path}/box", bucket_rows=10, most_parts=2)
    for k in range(4):
        one = {n: story(n, rnd.randint(1, 5), rnd.randint(0, 23), f"v{k}") for n in rnd.sample(range(60), 25)}
        batch = make([*one.values(), ("bad", date(2026, 1, 1), None, "x"), (f"s{900 + k:08x}", None, None, "x")])
        assert box.upsert(batch).first() == plain.upsert(batch).first()
        assert state(box) == state(plain)
        box.check()
    assert box.manifest()["depth"] > 1 and len(box.manifest()["buckets"]) > 2
    gone = spark.createDataFrame([(f"s{n:08x}",) for n in range(0, 60, 7)], "id string")
    assert box.remove(gone) == plain.remove(gone) and state(box) == state(plain)
    box.check()
    assert box.prune("2026-01-06", 3) == plain.prune("2026-01-06", 3) == ["2026-01-01", "2026-01-02"] and state(box) == state(plain)
    box.check()
    some = next(iter(state(box)))
    assert [tuple(r) for r in box.read_by_id(some[0]).select("id", "day", "updated", "title").collect()] == [some]
    assert box.read_by_id("sffffffff") is None and box.days() == plain.days()
    assert box.read_day(some[1]).count() == plain.read_day(some[1]).count()


@pytest.mark.parametrize("step", ["_write_days", "_write_index", "_append", "_commit"])
def test_a_writer_that_is_lost_leaves_the_old_state(spark, make, tmp_path, monkeypatch, step):
    box = CommittedArchive(spark, f"{tmp_path}/box")
    box.upsert(make([story(n, 1 + n % 3) for n in range(9)]))
    before, versions = state(box), box.versions()
    real = getattr(CommittedArchive, step)

    def lost(self, *args):
        if step in ("_write_days", "_write_index"):
            real(self, *args)  # the files are there, and then it goes
        raise OSError("lost")

    batch = make([story(n, 2, 5, "new") for n in range(4, 14)])
    with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
        m.setattr(CommittedArchive, step, lost)
        box.upsert(batch)
    again = CommittedArchive(spark, f"{tmp_path}/box")
    assert state(again) == before and again.versions() == versions
    again.check()
    assert again.upsert(batch).first().upserted == 8  # two are older than what is stored
    again.check()
    assert len(state(again)) == 14 and state(again, 1) == before
    assert again.vacuum() > 0 and len(state(again)) == 14
    again.check()


def test_two_writers_do_not_mix(spark, make, tmp_path, monkeypatch):
    one, two = (CommittedArchive(spark, f"{tmp_path}/box") for _ in range(2))
    one.upsert(make([story(1), story(2)]))
    real, came = CommittedArchive._commit, []

    def late(self, new):
        if not came:  # while the first is about to commit, the second one does
            came.append(1)
            two.upsert(make([story(1, 1, 9, "two"), story(3, 1, 0, "two")]))
        real(self, new)

    monkeypatch.setattr(CommittedArchive, "_commit", late)
    done = one.upsert(make([story(2, 1, 8, "one"), story(4, 2, 0, "one")])).first()
    assert (done.inserted, done.updated) == (1, 1) and one.versions() == [1, 2, 3]
    assert {(r[0][-1], r[3]) for r in state(one)} == {("1", "two"), ("2", "one"), ("3", "two"), ("4", "one")}
    one.check()
    monkeypatch.undo()
    with pytest.raises(CommitConflict):
        one._commit(one.manifest(2))


def files(tmp_path, top):
    return {p for p in (tmp_path / "box" / top).rglob("*.parquet")}


def test_a_small_batch_writes_few_files(spark, make, tmp_path):
    box = CommittedArchive(spark, f"{tmp_path}/box", bucket_rows=40)
    rows = spark.range(2_000).select(
        F.format_string("s%08x", "id").alias("id"), F.expr("date_add(date'2026-01-01', cast(id % 40 as int))").alias("day"),
        F.lit(datetime(2026, 1, 1)).alias("updated"), F.lit("t").alias("title"),
    )
    box.upsert(rows)
    buckets = len(box.manifest()["buckets"])
    assert buckets >= 50
    data, index = files(tmp_path, "data"), files(tmp_path, "index")
    box.upsert(make([("s00000000", date(2026, 1, 5), datetime(2026, 3, 1), "moved"), ("s0000ffff", date(2026, 1, 5), datetime(2026, 3, 1), "new")]))
    assert len(files(tmp_path, "data") - data) <= 4 and 1 <= len(files(tmp_path, "index") - index) <= 2
    index = files(tmp_path, "index")
    box.upsert(make([("s00000001", date(2026, 1, 2), datetime(2026, 3, 1), "same day")]))
    assert files(tmp_path, "index") == index  # where it is has not changed
    box.check()
    assert box.read_by_id("s00000000").first().title == "moved" and box.index().count() == 2_001


def test_buckets_are_compacted(spark, make, tmp_path):
    box = CommittedArchive(spark, f"{tmp_path}/box", most_parts=2)
    for k in range(4):
        box.upsert(make([story(k, 1)]))
    assert len(box.manifest()["buckets"]["0-0"]["parts"]) <= 2 and box.index().count() == 4
    box.check()


def test_nothing_there(spark, make, tmp_path):
    box = CommittedArchive(spark, f"{tmp_path}/box")
    assert box.read() is None and box.days() == [] and box.index().count() == 0 and box.read_by_id("s00000001") is None
    assert box.remove(spark.createDataFrame([("s00000001",)], "id string")) == 0 and box.prune("2026-01-01") == []
    assert box.upsert(make([])).first().upserted == 0 and state(box) == set()


def test_a_stream_goes_into_it(spark, make, tmp_path):
    from presswork.streaming import stories as streams

    for k in range(2):
        make([story(n, 1 + n % 2, k, f"v{k}") for n in range(4 * k, 4 * k + 6)]).write.parquet(f"{tmp_path}/in/part{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    box = CommittedArchive(spark, f"{tmp_path}/box")
    streams.upsert(stream, box, f"{tmp_path}/state").awaitTermination()
    assert len(state(box)) == 10
    box.check()


def test_rekeying_is_one_commit_and_can_be_taken_back(spark, tmp_path):
    from presswork.functions import lexicons as lex
    from presswork.functions.scalars import story_id

    url, at = "https://x.example/a", lambda d: datetime(2026, 1, d)
    ids = spark.range(1).select(*[story_id(F.lit(t), F.lit(url)).alias(n) for n, t in (("clean", "Model ships"), ("other", "Quiet day"))]).first()
    rows = [
        ("s00000001", date(2026, 1, 1), at(1), "Model ships - Reuters", url, "long description", ["r"]),
        ("s00000002", date(2026, 1, 2), at(2), "Model ships | Axios", url, None, ["x", "r"]),
        (ids.other, date(2026, 1, 3), at(3), "Quiet day", url, None, []),
    ]
    box = CommittedArchive(spark, f"{tmp_path}/box")
    box.upsert(spark.createDataFrame(rows, "id string, day date, updated timestamp, title string, url string, description string, sources array<string>"))
    dry = box.rekey(lex.publisher_aliases(), write=False).first()
    assert (dry.input_rows, dry.unchanged, dry.rekeyed, dry.merged) == (3, 1, 1, 1) and box.versions() == [1]
    box.rekey(lex.publisher_aliases())
    got = {r.id: r for r in box.read().collect()}
    assert set(got) == {ids.clean, ids.other} and got[ids.clean].description == "long description" and got[ids.clean].sources == ["x", "r"]
    box.check()
    assert box.days() == ["2026-01-02", "2026-01-03"] and box.read_by_id("s00000001") is None and box.read_by_id(ids.clean).count() == 1
    assert box.rekey(lex.publisher_aliases()).first().rekeyed == 0
    box.restore(1)
    assert {r.id for r in box.read().collect()} == {"s00000001", "s00000002", ids.other}
    box.check()
