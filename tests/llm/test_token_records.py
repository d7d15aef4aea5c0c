"""Token record files against the library, byte for byte, and what happens to broken or lost ones."""

import json
import os
import zlib

import numpy as np
import pytest

from presswork.llm import token_records as tr

from .conftest import ODD

TOKENIZER = "word_bpe_49k.json"
HARD = [
    "Word, WORD! don't DON'T, x's. <|endoftext|> <|ENDOFTEXT|> <|endoftext|>, a<|startoftext|>b",
    "é e ́x a b　c d \x1c \x85 ΣΑΣ ΣΑΣ, İ ß ﬁ 한글 하 !!, .,, a., 1,2. \ttab\r\nline",
    "\U0001f600 zero‍width \x00 12345 ½ x_y __a__ ...",
]


def truth(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tr.located(TOKENIZER))
    return [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def written(df, path, **more):
    tr.write_token_records(df, str(path), TOKENIZER, 2, **more)
    return tr.read_token_records(df.sparkSession, str(path))


def test_ids_offsets_and_order(spark, table, prose, tmp_path):
    rows = prose + [(1000 + k, t) for k, t in enumerate(HARD)] + ODD[:-2] + [(7, "x" * 5_000)]
    got = written(table(rows).repartition(3), tmp_path / "r").collect()
    want = sorted(zip([i for i, _ in rows], truth([t for _, t in rows])), key=lambda r: (r[0] is not None, r[0] or 0))
    flat = [(r.key, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in sorted(got, key=lambda r: r.start)]
    assert [k for k, _ in flat] == [k for k, _ in want]
    assert sorted(flat, key=repr) == sorted(((k, tuple(ids)) for k, ids in want), key=repr)
    starts = [r.start for r in sorted(got, key=lambda r: r.start)]
    assert starts == np.cumsum([0] + [len(ids) for _, ids in flat])[:-1].tolist()
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)


def test_many_ranges_and_one_key_on_a_third_of_the_rows(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(tr, "RANGE", 1 << 11)
    rows = [(5 if k % 3 == 0 else k, f"text {k} " * 20) for k in range(300)]
    got = written(table(rows), tmp_path / "r").orderBy("start").collect()
    assert [r.key for r in got] == sorted(i for i, _ in rows)
    manifest = json.loads((tmp_path / "r" / "manifest.json").read_text())
    assert len(manifest["files"]) > 10 and max(f["records"] for f in manifest["files"]) < 50
    assert sum(f["records"] for f in manifest["files"]) == 300


def test_shuffled_reads_give_the_same_records(spark, table, prose, tmp_path, monkeypatch):
    monkeypatch.setattr(tr, "RUN", 1 << 9)
    plain = written(table(prose), tmp_path / "r").collect()
    one, same, other = [[(r.key, r.start, bytes(r.ids)) for r in tr.read_token_records(spark, str(tmp_path / "r"), s).collect()] for s in (1, 1, 2)]
    assert one == same != other and sorted(one) == sorted(other) == sorted((r.key, r.start, bytes(r.ids)) for r in plain)
    assert one != sorted(one)


def test_frames_by_hand(table, tmp_path):
    written(table([(3, None)]), tmp_path / "r")
    name = json.loads((tmp_path / "r" / "manifest.json").read_text())["files"][0]["name"]
    data = (tmp_path / "r" / f"{name}.rec").read_bytes()
    payload = b"\x00" + (3).to_bytes(8, "little") + (2).to_bytes(2, "little")
    mask = lambda c: (((c >> 15) | (c << 17)) + 0xA282EAD8) % 2**32
    size = len(payload).to_bytes(8, "little")
    assert data == size + mask(zlib.crc32(size)).to_bytes(4, "little") + payload + mask(zlib.crc32(payload)).to_bytes(4, "little")
    assert np.frombuffer((tmp_path / "r" / f"{name}.idx").read_bytes(), "<i8").tolist() == [0, 1, 0]


@pytest.mark.parametrize("place", [3, 9, 20, -2])
def test_broken_bytes_are_found(spark, table, tmp_path, place):
    written(table([(1, "some words here"), (2, "and more")]), tmp_path / "r")
    name = json.loads((tmp_path / "r" / "manifest.json").read_text())["files"][0]["name"]
    file = tmp_path / "r" / f"{name}.rec"
    data = bytearray(file.read_bytes())
    data[place] ^= 4
    file.write_bytes(data)
    with pytest.raises(Exception, match="broken"):
        tr.read_token_records(spark, str(tmp_path / "r")).collect()


def test_only_listed_files_count(spark, table, tmp_path):
    before = written(table([(1, "some words"), (2, None)]), tmp_path / "r").collect()
    (tmp_path / "r" / "part-00000-other-9.rec").write_bytes(b"left by a task that failed")
    assert tr.read_token_records(spark, str(tmp_path / "r")).collect() == before
    with pytest.raises(Exception, match="already"):
        written(table([(9, "z")]), tmp_path / "r")
    assert tr.read_token_records(spark, str(tmp_path / "r")).collect() == before
    assert [r.key for r in written(table([(9, "z")]), tmp_path / "r", overwrite=True).collect()] == [9]
    assert len([f for f in os.listdir(tmp_path / "r") if f.endswith(".rec")]) == 2


def test_empty_table_and_clashing_names(spark, table, empty, tmp_path):
    assert written(empty, tmp_path / "e").collect() == []
    clash = table([(1, "a b")]).selectExpr("*", "'k' as key", "'i' as ids", "1 as tie", "2 as `range`")
    assert [r.key for r in written(clash, tmp_path / "c").collect()] == [1]


def test_long_texts_are_cut_at_blanks_only(monkeypatch):
    monkeypatch.setattr(tr, "PIECE", 40)
    words = tr.Words(tr.located(TOKENIZER), 2)
    text = " ".join(HARD * 5) + " " + "y" * 100 + " end"
    assert np.frombuffer(words.text(text), "<u2").tolist() == truth([text])[0][:-1]


def test_a_tokenizer_that_keeps_blanks_takes_whole_texts():
    from tokenizers import Tokenizer

    path = tr.located("byte_bpe_50k.json")
    words = tr.Words(path, 2)
    assert not words.by_words
    assert np.frombuffer(words.text(" a b  c\n"), "<u2").tolist() == Tokenizer.from_file(path).encode(" a b  c\n", add_special_tokens=False).ids


def test_query(spark):
    from presswork.llm.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want, at = [], 0
    for i, ids in zip(sorted(docs), truth([docs[i] for i in sorted(docs)])):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op11_token_records"](spark, sf).collect())) == want
