"""Token ids in length-delimited binary files, with an offset index for shuffled reads.

**The format.** A file is a run of frames; all numbers are little-endian:

    8 bytes   length n of the payload
    4 bytes   masked CRC-32 of those 8 bytes
    n bytes   payload
    4 bytes   masked CRC-32 of the payload

A checksum `c` is masked as `(c >> 15 | c << 17) + 0xA282EAD8` modulo 2^32, so that a
checksum stored inside checked data doesn't check itself. A payload is a flag byte
(1: the key is null), the key as 8 bytes, and the token ids, `width` bytes each.
Beside each `.rec` file lies an `.idx` file with a row of three 64-bit numbers for each record:
its offset, its number of ids, and how many ids of the file stand before it.
`manifest.json` lists the files in order of the keys, with their numbers of records and ids;
it is written last, by one rename, and a reader takes no file that it doesn't list. So a
write that fails, a lost executor or a task that runs twice leaves files that nobody reads.

**Writing** is a Spark data source, `token_records`. Rows go to files by ranges of (key,
hash of the text); the bounds come from the keys alone, so texts are encoded once, and only ids are
shuffled. A file is streamed from its sorted partition and holds no more than a batch in
memory. Rows with one key and one text stay in one range.

**Reading** is the same data source: a partition for every run of about `RUN` bytes of records, cut by
the index, so that a large file is read by many tasks. With the option `seed` the runs
come in a random order and the records inside each, by their offsets, in another. Every length and
checksum is checked; a wrong one raises `ValueError`.

**Encoding**: the library's ids, an end id behind each text. A text is cut at blanks, tabs
and line ends only, where its normaliser and pre-tokeniser can't look across, and ids of words
are remembered, twice `REMEMBERED` words at most; a new word with capitals, or with marks around it, is put together from its parts.
Other tokenizer files, whose pre-tokeniser keeps blanks, are encoded text by text.

Null and empty texts have only the end id; a null key comes first. Repeated rows are repeated
records. An empty table gives a manifest without files, and no rows are read. Extra columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import SMALL_BATCHES, col, documents, settings, shared_folder, slices

MASK_DELTA = 0xA282EAD8
#: Bytes of records in a reader's partition.
RUN = 16 << 20
#: Bytes of records in a batch that is read.
BATCH = 4 << 20
REMEMBERED = 1 << 19
#: Longer words are forgotten first; so many characters of a text are cut at once.
LONG_WORD, PIECE = 64, 1 << 20
#: Bytes of text that one range of keys should hold, on average.
RANGE = 32 << 20
MOST_RANGES = 1 << 15
#: The end of the Latin letters that the normaliser leaves as they are.
LATIN = "\u0250"
#: A symbol for every byte: its own character where that is visible, else the next one from 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SYMBOLS = [chr(b) if b in SHOWN else chr(256 + b - sum(x < b for x in SHOWN)) for b in range(256)]
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

READ = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)
WRITTEN = T.StructType([T.StructField("key", T.LongType()), T.StructField("ids", T.BinaryType())])


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, masked(size).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def payload_at(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the frame that begins at `at`, and where the next one begins."""
    size = bytes(data[at : at + 8])
    if len(size) < 8 or masked(size) != int.from_bytes(data[at + 8 : at + 12], "little"):
        raise ValueError(f"broken length of a record at {at}")
    end = at + 12 + int.from_bytes(size, "little")
    payload = data[at + 12 : end]
    if end + 4 > len(data) or masked(payload) != int.from_bytes(data[end : end + 4], "little"):
        raise ValueError(f"broken record at {at}")
    return payload, end + 4


def _opened(path: str):
    """The file system and the path in it; any that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _delete(fs, root: str, names: list[str]) -> None:
    for place in (f"{root}/{name}.{kind}" for name in names for kind in ("rec", "idx")):
        if fs.get_file_info(place).type.name != "NotFound":
            fs.delete_file(place)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: one file, or none."""

    partition: int
    name: str
    records: int
    ids: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, width: int, overwrite: bool):
        self.path, self.width, self.overwrite, self.run = path, width, overwrite, uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _opened(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.run}-{task.taskAttemptId()}"
        out = index = None
        offset = before = records = 0
        try:
            for batch in iterator:
                frames, rows = [], []
                for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                    part = frame(bytes([key is None]) + (key or 0).to_bytes(8, "little", signed=True) + ids)
                    rows.append((offset, len(ids) // self.width, before))
                    frames.append(part)
                    offset, before = offset + len(part), before + len(ids) // self.width
                if rows:
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out, index = fs.open_output_stream(f"{root}/{name}.rec"), fs.open_output_stream(f"{root}/{name}.idx")
                    out.write(b"".join(frames))
                    index.write(np.array(rows, "<i8").tobytes())
                    records += len(rows)
        finally:
            for f in (out, index):
                if f is not None:
                    f.close()
        return Written(task.partitionId(), name if out is not None else "", records, before)

    def commit(self, messages: list[Written | None]) -> None:
        """The manifest, moved into place: from then on, and only then, the files count."""
        fs, root = _opened(self.path)
        fs.create_dir(root, recursive=True)
        place, made = f"{root}/manifest.json", f"{root}/manifest-{self.run}.json"
        old = []
        if fs.get_file_info(place).type.name != "NotFound":
            if not self.overwrite:
                raise ValueError(f"{self.path} holds records already")
            with fs.open_input_stream(place) as f:
                old = json.loads(f.read())["files"]
        files = sorted((m for m in messages if m and m.name), key=lambda m: m.partition)
        listed = [{"name": m.name, "records": m.records, "ids": m.ids} for m in files]
        with fs.open_output_stream(made) as out:
            out.write(json.dumps({"width": self.width, "files": listed}).encode())
        fs.move(made, place)
        _delete(fs, root, [f["name"] for f in old])

    def abort(self, messages: list[Written | None]) -> None:
        _delete(*_opened(self.path), [m.name for m in messages if m and m.name])


class Run(InputPartition):
    """Records `first` to `last` of a file, in whose front `before` ids stand in other files."""

    def __init__(self, name: str, first: int, last: int, before: int):
        super().__init__((name, first, last, before))
        self.name, self.first, self.last, self.before = name, first, last, before


class Reader(DataSourceReader):
    def __init__(self, path: str, seed: int | None):
        self.path, self.seed = path, seed
        fs, root = _opened(path)
        with fs.open_input_stream(f"{root}/manifest.json") as f:
            found = json.loads(f.read())
        self.width, self.files = found["width"], found["files"]

    def partitions(self) -> list[Run]:
        """Runs of records of about `RUN` bytes, by the mean size of a file's records: no index is read here."""
        runs, before = [], 0
        for f in self.files:
            mean = 25 + f["ids"] * self.width // max(1, f["records"])
            step = max(1, RUN // mean)
            runs += [Run(f["name"], a, min(a + step, f["records"]), before) for a in range(0, f["records"], step)]
            before += f["ids"]
        if self.seed is not None:
            np.random.default_rng(self.seed).shuffle(runs)
        return runs

    def read(self, run: Run | None) -> Iterator[pa.RecordBatch]:
        if run is None:  # Spark's stand-in where there are no partitions
            return
        fs, root = _opened(self.path)
        with fs.open_input_file(f"{root}/{run.name}.idx") as f:
            f.seek(24 * run.first)
            index = np.frombuffer(f.read(24 * (run.last - run.first)), "<i8").reshape(-1, 3)
        if len(index) != run.last - run.first:
            raise ValueError(f"the index of {run.name} is too short")
        order = np.arange(len(index))
        if self.seed is not None:
            np.random.default_rng([self.seed, run.first, zlib.crc32(run.name.encode())]).shuffle(order)
        with fs.open_input_file(f"{root}/{run.name}.rec") as f:
            sizes = 25 + self.width * index[:, 1]
            at = 0
            while at < len(order):
                stop = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[order[at:]]), BATCH)))
                part, at = order[at:stop], stop
                yield self._batch(f, index[part], run.before)

    def _batch(self, f, rows: np.ndarray, before: int) -> pa.RecordBatch:
        keys, ids = [], []
        together = bool((np.diff(rows[:, 0]) == 25 + self.width * rows[:-1, 1]).all())
        if together:  # one read for neighbours, one for each where they are shuffled
            f.seek(int(rows[0, 0]))
            data = memoryview(f.read(int(rows[-1, 0] - rows[0, 0]) + 25 + self.width * int(rows[-1, 1])))
        for offset, n, _ in rows.tolist():
            if together:
                payload, _ = payload_at(data, offset - int(rows[0, 0]))
            else:
                f.seek(offset)
                payload, _ = payload_at(memoryview(f.read(25 + self.width * n)), 0)
            if len(payload) != 9 + self.width * n:
                raise ValueError(f"the record at {offset} isn't as long as the index says")
            keys.append(None if payload[0] else int.from_bytes(payload[1:9], "little", signed=True))
            ids.append(np.frombuffer(payload, f"<u{self.width}", offset=9).astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(before + rows[:, 2]), pa.array(rows[:, 1]), pa.array(ids, pa.binary())],
            names=READ.names,
        )


class TokenRecords(DataSource):
    """`spark.read.format("token_records").load(path)`; options `seed` to read and `width` (2 or 4) to write."""

    @classmethod
    def name(cls) -> str:
        return "token_records"

    def schema(self) -> T.StructType:
        return READ

    def reader(self, schema: T.StructType) -> Reader:
        seed = self.options.get("seed")
        return Reader(self.options["path"], None if seed is None else int(seed))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("width", 4)), overwrite)


def parted(word: str) -> tuple[str, ...]:
    """A word cut where letters meet marks at its ends, the letters in small ones: its ids are those of the parts.

    Only where that is sure: Latin letters, which need no normalising, and marks but the apostrophe of contractions.
    """
    core = word.strip(MARKS)
    if "<|" in word or not core or not (core[0].isalpha() and core[-1].isalpha() and max(core) < LATIN and "\u0130" not in core):
        return (word,)
    at = word.index(core)
    return tuple(p for p in (word[:at], core.lower(), word[at + len(core) :]) if p)


class Words(dict):
    """Ids of words, as bytes, of two generations: the older one goes when the younger is full, but for what was used again."""

    _open: dict[tuple[str, int], Words] = {}

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        super().__init__()
        self.tokenizer, self.dtype, self.code = Tokenizer.from_file(path), f"<u{width}", "H" if width == 2 else "I"
        self.old = {}
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        lowered = str(rules.get("normalizer")).find("'Lowercase'") >= 0
        splits = [x for x in steps if x["type"] == "Split" and x["behavior"] == "Removed" and x["invert"] and "^\\s" in x["pattern"].get("Regex", "")]
        #: Blanks are dropped, and nothing is added in front of words.
        self.by_words = bool(splits and lowered) and not any(x.get("add_prefix_space") for x in steps)

    @classmethod
    def of(cls, path: str, width: int) -> Words:
        if (path, width) not in cls._open:
            cls._open[path, width] = cls(path, width)
        return cls._open[path, width]

    def encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() if len(x.ids) > 8 else array(self.code, x.ids).tobytes() for x in found]

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.old[word]
        return ids

    def letters(self, word: str) -> bytes:
        """Ids of small Latin letters: nothing to normalise or cut, so the library's model takes them as they are, as symbols of bytes."""
        seen = word if word.isascii() else "".join([SYMBOLS[b] for b in word.encode()])
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(seen)]).tobytes()

    def learn(self, new: set[str]) -> None:
        """Remember words: their middle in small letters is encoded if it is new, and so are the marks around it."""
        cut, other = [], set()
        for w in new:
            if w.isalpha() and w.islower() and max(w) < LATIN:
                self[w] = self.letters(w)
            else:
                cut.append((w, ps := parted(w)))
                for p in ps:
                    if p not in self and p not in self.old:
                        if p.isalpha() and p.islower() and max(p) < LATIN:
                            self[p] = self.letters(p)
                        else:
                            other.add(p)
        if other:
            ordered = list(other)
            self.update(zip(ordered, self.encoded(ordered)))
        for w, ps in cut:
            if len(ps) > 1 or w not in self:
                self[w] = b"".join([self[p] for p in ps])

    def text(self, text: str) -> bytes:
        if not self.by_words:
            return self.encoded([text])[0]
        out, at = [], 0
        while at < len(text):
            end = len(text) if at + PIECE >= len(text) else text.rfind(" ", at + 1, at + PIECE)
            end = len(text) if end < 0 else end
            words = text[at:end].replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            if len(self) > REMEMBERED:
                self.old = {w: ids for w, ids in self.items() if len(w) <= LONG_WORD}
                self.clear()
            ids = list(map(self.get, words))
            gaps = [i for i, known in enumerate(ids) if known is None]
            if gaps:
                self.learn({words[i] for i in gaps if words[i] not in self.old})
                for i in gaps:
                    ids[i] = self[words[i]]
            out.append(b"".join(ids))
            at = end
        return b"".join(out)


def encoded(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    text_col: str = "text",
    key_col: str = "doc_id",
    width: int = 2,
    bounds: tuple[tuple[int, int], ...] = (),
) -> DataFrame:
    """`key`, `tie` (a hash of the text), `range` (its place among the bounds) and `ids` (`width` bytes each) of every text."""
    inner = docs.select(col(key_col).cast("long").alias("key"), F.xxhash64(col(text_col)).alias("tie"), col(text_col).cast("string").alias("text"))
    end, keys, ties = end_id.to_bytes(width, "little"), [k for k, _ in bounds], [h for _, h in bounds]

    def place(key: int | None, tie: int) -> int:
        if key is None:
            return 0
        return bisect_right(ties, tie, bisect_left(keys, key), bisect_right(keys, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.of(located(tokenizer), width)
        for whole in batches:
            for at, size in slices(whole.column(2)):
                batch = whole.slice(at, size)
                ids = [words.text(t or "") + end for t in batch.column(2).to_pylist()]
                where = [place(k, h) for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(where, pa.int32()), pa.array(ids, pa.binary())], names=["key", "tie", "range", "ids"]
                )

    return inner.mapInArrow(run, "key long, tie long, range int, ids binary")


def located(tokenizer: str) -> str:
    """A tokenizer file by its path, or by its name among the installed public ones."""
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def id_width(tokenizer: str) -> int:
    """Bytes that every id of the tokenizer fits into."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(located(tokenizer)).get_vocab_size() <= 1 << 16 else 4


def ranges(docs: DataFrame, key_col: str, text_col: str) -> list[tuple[int, int]]:
    """Lower bounds of all ranges of (key, hash of the text) but the first, from Spark's own range partitioning of the keys alone."""
    keys = docs.select(col(key_col).cast("long").alias("k"), F.xxhash64(col(text_col)).alias("h"), F.octet_length(col(text_col)).alias("b"))
    size = keys.agg(F.sum("b")).first()[0] or 0
    n = min(MOST_RANGES, max(1, size // RANGE, min(8, size >> 16)))
    if n == 1:
        return []
    dealt = keys.where("k is not null").select("k", "h").repartitionByRange(n, "k", "h")
    least = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("k", "h")).alias("low"))
    return sorted((r.low.k, r.low.h) for r in least.collect())[1:]


def write_token_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, key_col: str = "doc_id", text_col: str = "text", overwrite: bool = False) -> None:
    """Write the ids of every text to `path`, in ascending order of the keys (nulls first, ties by a hash of the text)."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenRecords)
    width = id_width(tokenizer)
    bounds = ranges(docs, key_col, text_col)
    rows = encoded(docs, tokenizer, end_id, text_col, key_col, width, tuple(bounds))
    rows = rows.repartitionById(len(bounds) + 1, "range")
    rows = rows.sortWithinPartitions(F.asc_nulls_first("key"), "tie").select("key", "ids")
    with settings(spark, SMALL_BATCHES):
        rows.write.format("token_records").option("width", str(width)).mode("overwrite" if overwrite else "append").save(path)


def read_token_records(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    """`key`, `start`, `n_tokens` and `ids` (unsigned 32-bit, little-endian) of every record; shuffled with a seed."""
    spark.dataSource.register(TokenRecords)
    reader = spark.read.format("token_records")
    return (reader if seed is None else reader.option("seed", str(seed))).load(path)


TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def op11_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the ids of every document stand in the files, how many they are, and their CRC-32."""
    path = f"{shared_folder(spark)}/presswork-{uuid4().hex}/records"
    write_token_records(documents(spark, sf_dir), path, TOKENIZER, END_ID)
    return read_token_records(spark, path).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
