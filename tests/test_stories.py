"""Scalar functions, classification and summaries: tables of inputs and outputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from presswork.functions import lexicons as lex
from presswork.functions import scalars as N
from presswork.functions import stories as S


def value(spark, column, **inputs):
    """The value of a column over one row of string inputs."""
    row = spark.createDataFrame([tuple(inputs.values()) or ("",)], ", ".join(f"{k} string" for k in inputs) or "x string")
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "title,clean,publisher",
    [
        ("Model ships - Reuters", "Model ships", "reuters"),
        ("Model ships | The Verge", "Model ships", "the verge"),
        ("Model ships - - nature.com", "Model ships", "nature com"),
        ("Model ships - WIRED - Reuters", "Model ships", "reuters"),
        ("AI: The Verge", "AI", "the verge"),
        ("Model ships - Some Blog", "Model ships - Some Blog", None),
        ("Reuters", "Reuters", None),
        ("Lab finds cure - News-Medical", "Lab finds cure - News-Medical", None),
        ("Model ships - Axios", "Model ships", "axios"),
        ("Model ships - AP", "Model ships", "ap"),
        ("Model ships - nyt.com", "Model ships - nyt.com", None),
        ("", "", None),
        (None, "", None),
    ],
)
def test_clean_title(spark, title, clean, publisher):
    got = value(spark, N.clean_title(F.col("t"), lex.publisher_aliases()), t=title)
    assert (got.title, got.publisher) == (clean, publisher)


def test_identity(spark):
    assert value(spark, N.normalize_title(F.col("t")), t=" GPT-5: Café, now! ") == "gpt 5 caf now"
    assert value(spark, N.canonical_url_key(F.col("u")), u="https://WWW.Example.com/A/b/c?x=1#y") == "example.com/a/b"
    assert value(spark, N.canonical_url_key(F.col("u")), u="not a url") == ""
    assert value(spark, N.djb2(F.col("t")), t="") == "00001505"
    h = 5381
    for c in "hello|x.com/a":
        h = (h * 33 + ord(c)) % 2**32
    assert value(spark, N.story_id(F.col("t"), F.col("u")), t="Hello", u="http://x.com/a") == f"s{h:08x}"


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://EXAMPLE.com/P?utm_source=a&id=2&FBCLID=3#f", "https://example.com/P?id=2#f"),
        ("http://x.com", "http://x.com/"),
        ("http://x.com?gclid=1", "http://x.com/"),
        ("HTTP://me:Pw@X.com:80/A/?UTM_Medium=x&b=C", "http://me:Pw@x.com/A/?b=C"),
        ("https://x.com:443", "https://x.com/"),
        ("https://x.com:8443/a", "https://x.com:8443/a"),
        ("ftp://x.com", None),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert value(spark, N.canonical_url(F.col("u")), u=url) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("2026-09-02T12:00:00.250Z", dt.datetime(2026, 9, 2, 12, 0, 0, 250000)),
        ("Wed, 02 Sep 2026 12:00:00 GMT", dt.datetime(2026, 9, 2, 12)),
        ("Wed, 2 Sep 2026 14:00:00 +0200", dt.datetime(2026, 9, 2, 12)),
        ("2026-09-02", dt.datetime(2026, 9, 2)),
        ("soon", None),
        (None, None),
    ],
)
def test_dates(spark, text, want):
    got = value(spark, N.iso_millis(N.parse_timestamp(F.col("t"))), t=text)
    assert got == (want.strftime("%Y-%m-%dT%H:%M:%S.") + f"{want.microsecond // 1000:03d}Z" if want else None)


def test_rounding_is_half_up(spark):
    assert value(spark, N.js_round(F.lit(-0.5))) == 0 and value(spark, N.js_round(F.lit(2.5))) == 3
    assert value(spark, N.one_decimal(F.lit(-33.25))) == -33.2


def test_text_helpers(spark):
    assert value(spark, N.strip_html(F.col("h")), h="<p>a&amp;b</p><script>x</script> <b>c</b>") == "a&b c"
    assert value(spark, N.first_image(F.col("h")), h="<img alt='' src='a.png'><img src='b.png'>") == "a.png"
    assert value(spark, N.sentences(F.col("t")), t="One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    assert value(spark, N.char_cap(F.col("t"), 12), t="hello big, world") == "hello big"
    assert value(spark, N.slug(F.col("t")), t=" Open AI! ") == "open-ai"
    assert value(spark, N.squeeze(F.col("t")), t=" a  b　c ") == "a b c"


@pytest.mark.parametrize(
    "title,want",
    [
        ("A new study on arXiv", "research"),
        ("Introducing GPT-5", "model"),
        ("Startup raises money", "funding"),
        ("Firm unveils app", "product"),
        ("An SDK for agents", "tools"),
        ("Jailbreak found", "safety"),
        ("Executive order signed", "policy"),
        ("Released under the MIT license", "opensource"),
        ("Two firms team up", "partnership"),
        ("Market grows", "industry"),
        ("CEO resigns", "business"),
        ("Rapid weather", "other"),
    ],
)
def test_classes(spark, title, want):
    assert value(spark, S.classify(F.lower(F.col("t"))), t=title) == want


def test_entities(spark):
    text = "openai and google deepmind show gpt-5 in the us and the usa"
    assert value(spark, S.entities(F.col("t"), "companies"), t=text) == ["Google DeepMind", "OpenAI"]
    assert value(spark, S.entities(F.col("t"), "models"), t=text) == ["GPT-5"]
    assert value(spark, S.entities(F.col("t"), "countries"), t=text) == ["United States", "United States"]
    assert value(spark, S.entities(F.col("t"), "models"), t="gemini-like gem") == ["Gemini"]


def test_scrubbing_is_idempotent(spark):
    key = "gh" + "p_" + "A1b2" * 9
    once = value(spark, S.scrub(F.col("t")), t=f"see {key}, é{key} and x{key}")
    assert once == f"see {S.PLACEHOLDER}, é{S.PLACEHOLDER} and x{key}"
    assert value(spark, S.scrub(F.col("t")), t=once) == once


def test_summary(spark):
    body = "First sentence is here. Second one follows it. Third is a takeaway, too. First sentence is here."
    got = value(spark, S.extractive(F.col("b")), b=body)
    assert got.summary == "First sentence is here. Second one follows it." and got.takeaways == ["Third is a takeaway, too."]
    assert value(spark, S.extractive(F.col("b")), b="Too short.").summary is None
    assert value(spark, S.is_grounded(F.col("a"), F.col("s")), a="model ships today", s="the model ships") is True
    assert value(spark, S.is_grounded(F.col("a"), F.col("s")), a="a b", s="a b") is False


def test_signal_is_the_weighted_sum(spark):
    parts = {k: F.lit(v) for k, v in zip(lex.WEIGHTS, (78, 100, 98, 62, 90))}
    assert value(spark, S.signal(parts)) == int(0.3 * 78 + 25 + 0.2 * 98 + 0.15 * 62 + 9 + 0.5)
    assert value(spark, S.novelty(F.lit(None).cast("timestamp"), F.current_timestamp())) == 55


def test_manifest_is_whole():
    aliases = lex.publisher_aliases()
    assert len(aliases) == 272 and len(set(lex.PUBLISHERS)) == len(lex.PUBLISHERS)


def test_credentials_tell_their_place(spark):
    key, other = "gh" + "p_" + "A1b2" * 9, "AK" + "IA" + "ABCDEFGHIJKLMNOP"
    got = value(spark, S.credentials(F.col("t")), t=f"é😀 {other} then {key}, {key}")
    assert [(x["index"], x.pattern) for x in got] == [(3, "aws-access-key-id"), (29, "github-classic-pat"), (71, "github-classic-pat")]


def test_days_and_publishers(spark):
    at = "2024-01-20 03:00:00"
    assert str(value(spark, N.local_day(F.col("t").cast("timestamp"), "America/New_York"), t=at)) == "2024-01-19"
    assert value(spark, N.publisher_url(F.col("d"), F.col("c")), d="https://a.com/x?utm_source=y", c="https://news.google.com/rss/1") == "https://a.com/x"
    assert value(spark, N.publisher_url(F.col("d"), F.col("c")), d="https://a.com/x", c="https://b.com/1") is None
    assert value(spark, N.truncated(F.col("t"), 5), t="abcdefgh") == "abcd…" and value(spark, N.day_shown(F.col("t").cast("date")), t="2024-03-01") == "03/01/2024"


def test_what_a_reader_sees(spark):
    some = dict(s="A new model", d="It is out today and does more than the last one did.", t="A new model!")
    assert value(spark, N.shown_summary(F.col("s"), F.col("d"), F.col("t")), **some) is None  # a summary that repeats the title is not replaced
    assert value(spark, N.shown_summary(F.lit(None).cast("string"), F.col("d"), F.col("t")), **some) == some["d"]
    assert value(spark, N.reader_text(F.lit("").cast("string"), F.col("d")), **some) == some["d"]
    assert value(spark, N.normalize_array(F.lit(None).cast("array<string>"))) == []
