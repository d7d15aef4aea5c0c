"""The stages of the corpus pipeline on a small table."""

import hashlib

import corpus_pipeline as cp
from presswork.llm.registry import QUERIES, SQL


def words(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


def test_stages(spark, tmp_path):
    token = hashlib.sha1(b"z").hexdigest()
    passage = words("bench", 14)
    rows = [
        (1, words("clean", 40)),
        (2, words("clean", 40)),
        (3, "too short"),
        (4, words("lead", 30) + " " + passage + " " + words("tail", 30)),
        (5, words("other", 40) + f" token={token} end"),
        (6, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in now.collect()}
        assert name == cp.STAGES[-1][0] or tuple(now.columns) == cp.COLUMNS
    assert set(kept["quality_rules"]) == {1, 2, 4, 5}
    assert set(kept["ngram_jaccard_join"]) == {1, 4, 5}
    assert "bench3" not in kept["decontamination"][4].text and "tail29" in kept["decontamination"][4].text
    assert kept["decontamination"][1].text == rows[0][1]
    assert token not in kept["secret_scan"][5].text and kept["secret_scan"][5].n_chars == len(kept["secret_scan"][5].text)
    final = {r.doc_id: r.n_tokens for r in cp.run(spark, str(tmp_path)).collect()}
    assert final == {i: r.n_tokens for i, r in kept["sentencepiece"].items()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, path, rows, items):
    docs = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_an_empty_table(spark, tmp_path):
    assert cp.run(spark, folder(spark, tmp_path, [], [])).count() == 0


def test_null_and_repeated_rows(spark, tmp_path):
    rows = [(None, words("n", 30)), (1, words("a", 40)), (1, words("a", 40)), (2, words("a", 40)), (3, None), (3, ""), (4, words("b", 25))]
    got = sorted((r.doc_id or 0) for r in cp.run(spark, folder(spark, tmp_path, rows, [(None, "x"), (1, None)])).collect())
    assert got == [0, 1, 1, 4]  # rows that share id and text can't be told apart


def test_stages_by_hand(spark, tmp_path, prose):
    """Every stage on what the one before it kept, against plain Python and the library."""
    import re

    import sentencepiece

    from presswork.llm import sentencepiece_codec

    from .test_methods import FOLD, WORD, linked_by_hand, roots, secrets_by_hand, shingles

    passage = words("bench", 14)
    rows = [*prose, (500, prose[0][1] + " " + passage + " end"), (501, passage), (502, "a b c d e f g h " * 9), (503, prose[1][1] + " token=abcdefgh12345 end")]
    path = folder(spark, tmp_path, rows, [(1, passage), (2, "zz yy xx")])
    now, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in cp.STAGES:
        stage(spark, now, path).write.parquet(f"{path}/{name}")
        now = spark.read.parquet(f"{path}/{name}")
        kept.append({r.doc_id: r for r in now.collect()})

    def good(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = {}
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        again = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if x.strip()]
        rare = len(w) >= 20 and 100 * len(again) <= 30 * len(w) and not (len(lines) >= 4 and 2 * (len(lines) - len(set(lines))) > len(lines))
        return rare and 2 * len(w) <= sum(map(len, w)) <= 25 * len(w)

    first = {i: t for i, t in rows if good(t)}
    assert set(kept[0]) == set(first) and 502 not in first
    ids = sorted(first)
    sets = [shingles(first[i]) for i in ids]
    top = roots(len(ids), linked_by_hand(sets))
    second = {ids[k] for k in set(top)}
    assert set(kept[1]) == second and len(second) < len(first)
    assert set(kept[2]) == {i for i in second if i != 501} and all("bench3" not in r.text for r in kept[2].values())
    for i, r in kept[2].items():
        if passage not in first[i]:
            assert r.text == first[i]
        assert WORD.findall(r.text.translate(FOLD)) == WORD.findall(first[i].replace(passage, " ").translate(FOLD))
    assert set(kept[3]) == set(kept[2])
    for i, r in kept[3].items():
        assert secrets_by_hand(r.text) == [] and r.n_chars == len(r.text) and (secrets_by_hand(kept[2][i].text) or r.text == kept[2][i].text)
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.located(sentencepiece_codec.MODEL))
    for i, r in kept[4].items():
        ids_ = sp.encode(kept[3][i].text, add_eos=True)
        assert r.n_tokens == len(ids_) and r.decoded_sha256 == hashlib.sha256(sp.decode(ids_).encode()).hexdigest()


def test_registered_queries_over_a_table(spark):
    """Every query over the smallest table: a row for each document, and what the operators give."""
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op1_language_id", "op3_license_scan", "op4_secret_scan", "op6_pii", "op8_sentencepiece"):
        rows = QUERIES[name](spark, sf)
        assert rows.columns[0] == "doc_id" and rows.count() == n, name
    assert QUERIES["op2_url_filter"](spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert QUERIES["quality_ablation"](spark, sf).count() == 6


def test_every_operator_is_registered():
    assert [q.split("_")[0] for q in QUERIES if q.startswith("op")] == [f"op{n}" for n in range(1, 14)]
    assert set(SQL) <= set(QUERIES)


def test_a_kept_text_goes_to_python_once(spark):
    from presswork.llm.quality_rules import ledger

    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    led = ledger(docs, keep=("doc_id", "text", "lang"))
    assert "text_in" not in led._jdf.queryExecution().analyzed().toString()
    assert sorted((r.doc_id, r.text, r.lang, r.quality.n_words) for r in led.collect()) == [(1, "a b", "en", 2), (2, None, "en", 0)]
