"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, for every operator."""

import pytest

from presswork.llm import decontamination, language_id, license_scan, ngram_join, pii, quality_rules, secret_scan, sentencepiece_codec
from presswork.llm import substring_dedup, url_filter

from .conftest import ODD


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_quality(odd, empty):
    led = quality_rules.ledger(odd, keep=("doc_id", "quality", "failed"))
    assert led.columns == ["doc_id", "quality", "failed", "_quality", "_failed"]
    rows = led.collect()
    assert len(rows) == len(ODD) and {r.quality for r in rows} == {"q"}
    assert all(r._quality.n_words == 0 and r._failed & 1 for r in rows if r.doc_id in (1, 2, 3))
    assert quality_rules.ledger(empty).count() == 0


def test_language(odd, empty):
    model = language_id.prototypes(odd)  # no label is there
    assert {r.language.lang_pred for r in language_id.predict(odd, model).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_language_without_letters(spark, table):
    train = spark.createDataFrame([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr"), (None, "de"), ("x", None)], "text string, lang string")
    model = language_id.prototypes(train)
    assert model[0] == ["en", "fr"]
    got = {r.doc_id: r.language for r in language_id.predict(table([(1, None), (2, "123 !?"), (3, "the mat"), (4, "sur la table")]), model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[1].score == 0
    assert got[3].lang_pred == "en" and got[4].lang_pred == "fr" and 0 < got[3].score <= 1


def test_decontamination(spark, odd, empty):
    bench = items(spark, [(1, "two three four"), (2, None), (None, "five six"), (3, ""), (1, "two three four")])
    rows = decontamination.find_overlaps(odd, bench, keep=("doc_id", "n_words")).collect()
    assert len(rows) == len(ODD)
    assert sum(r.overlap.n_hit for r in rows) == 6 and {tuple(r.overlap["items"]) for r in rows} == {(), ("1",)}
    assert decontamination.find_overlaps(empty, bench).count() == 0
    assert decontamination.find_overlaps(odd, items(spark, [])).where("overlap.n_hit > 0").count() == 0
    assert decontamination.decontaminate(odd, items(spark, [])).count() == len(ODD)


def test_join(odd, empty):
    rows = ngram_join.linked(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r.n == 0 and r.component_id == r.doc_id for r in rows if r.doc_id in (1, 2, 3))
    assert all(r.component_id == 4 for r in rows if r.doc_id == 4)
    assert ngram_join.linked(empty).count() == 0
    assert ngram_join.one_of_each(odd).columns == odd.columns


@pytest.mark.parametrize("module", [secret_scan, pii])
def test_span_scans(module, odd, empty):
    rows = module.scan(odd, keep=("doc_id", "spans")).collect()
    assert len(rows) == len(ODD) and all(r.base_spans == [] and r._spans == [] and r.spans == "x" for r in rows)
    assert module.scan(empty).count() == 0
    changed = (secret_scan.redact if module is secret_scan else pii.sanitise)(odd)
    assert changed.columns == odd.columns and changed.count() == len(ODD)


def test_license(odd, empty):
    rows = license_scan.scan(odd, keep=("doc_id", "n_words")).collect()
    assert len(rows) == len(ODD) and all(r.license.labels == "" and r.license.first_word is None for r in rows)
    assert license_scan.scan(empty).count() == 0


def test_substrings(odd, empty):
    found = substring_dedup.repeats(odd)
    assert found.columns == list(substring_dedup.FOUND) and found.collect() == []
    assert substring_dedup.repeats(empty).count() == 0


def test_sentencepiece(odd, empty):
    model = sentencepiece_codec.default_model()
    rows = sentencepiece_codec.sp_encode(odd, model, keep=("doc_id", "n_words")).collect()
    assert len(rows) == len(ODD)
    assert all(len(r.coded.ids) == 1 and r.coded.decoded == "" for r in rows if r.doc_id in (1, 2))
    assert sentencepiece_codec.sp_digest(empty, model).count() == 0


def test_output_names_that_clash(spark, table):
    rows = table([(1, "one two three")]).selectExpr("*", "'a' as language", "'b' as coded", "'c' as overlap", "'d' as license")
    model = language_id.prototypes(rows)
    assert language_id.predict(rows, model, keep=("doc_id", "language")).columns == ["doc_id", "language", "_language"]
    assert sentencepiece_codec.sp_digest(rows, sentencepiece_codec.default_model(), keep=("coded",)).columns == ["coded", "_coded"]
    found = decontamination.find_overlaps(rows, items(spark, [(1, "two three")]), keep=("overlap",))
    assert found.columns == ["overlap", "_overlap"] and found.first()._overlap.n_hit == 2
    assert license_scan.scan(rows, keep=("license",)).columns == ["license", "_license"]


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None, "k"), (2, "no scheme", "k"), (3, "HTTP://WWW.Example.COM/en/x?q#f", "k"), (3, "HTTP://WWW.Example.COM/en/x?q#f", "k"), (4, "http://", "k")],
        "page_id long, url string, host string",
    )
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = url_filter.judge(pages, none, keep=("page_id", "host")).collect()
    assert len(rows) == 5 and all(r.host == "k" for r in rows)
    by = {r.page_id: r.judged for r in rows}
    assert by[1].host == by[2].host == by[4].host == "" and by[1].verdict == "allow" and by[1].rule is None
    assert (by[3].host, by[3].path, by[3].rule, by[3].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert url_filter.judge(pages.limit(0), none).count() == 0
