"""Canonical addresses as browsers write them."""

import pytest
from pyspark.sql import functions as F

from presswork.functions import scalars as N

CASES = [
    ("http://EXAMPLE.com:80", "http://example.com/"),
    ("https://example.com:443/a/./b/../c", "https://example.com/a/c"),
    ("https://example.com/../../a", "https://example.com/a"),
    ("https://example.com/a/b/..", "https://example.com/a/"),
    ("https://example.com/a/b/.", "https://example.com/a/b/"),
    ("https://example.com/a/%2E%2e/b/%2e/c", "https://example.com/b/c"),
    ("https://example.com/a/.../b..c/.d", "https://example.com/a/.../b..c/.d"),
    ("https://example.com//a//../b", "https://example.com//a/b"),
    ("https://example.com/a b\"<>`{}é😀", "https://example.com/a%20b%22%3C%3E%60%7B%7D%C3%A9%F0%9F%98%80"),
    ("https://example.com/a%20b%zz", "https://example.com/a%20b%zz"),
    ("https://example.com/?q=a b'é<&utm_source=x", "https://example.com/?q=a%20b%27%C3%A9%3C"),
    ("https://example.com/#a b`é", "https://example.com/#a%20b%60%C3%A9"),
    ("https://bücher.example/ü", "https://xn--bcher-kva.example/%C3%BC"),
    ("https://BÜCHER.example:8080/", "https://xn--bcher-kva.example:8080/"),
    ("https://例え.テスト/x", "https://xn--r8jz45g.xn--zckzah/x"),
    ("https:\\\\example.com\\a\\b?c\\d", "https://example.com/a/b?c\\d"),
    (" https://exam\tple.com/a\nb ", "https://example.com/ab"),
    ("https://user:pw@example.com/x", "https://user:pw@example.com/x"),
    ("https://example.com/a?fbclid=1#..", "https://example.com/a#.."),
    ("ftp://example.com/", None),
    ("no address", None),
    ("", None),
    (None, None),
]


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(CASES)], "k int, u string")
    return {r.k: r.c for r in df.select("k", N.canonical_url(F.col("u")).alias("c")).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_address(got, k):
    assert got[k] == CASES[k][1]


def test_punycode_of_random_labels(spark):
    """Against Python's own encoding, label by label."""
    import random

    rnd = random.Random(2)
    hosts = [".".join("".join(rnd.choice("abz09éüñжλ語字") for _ in range(rnd.randint(1, 12))) for _ in range(3)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(hosts)), "k int, h string")
    for r in df.select("h", N.ascii_host(F.col("h")).alias("a")).collect():
        assert r.a == ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in r.h.split("."))


def test_twice_is_once(spark):
    df = spark.createDataFrame([(u,) for u, _ in CASES], "u string").select(N.canonical_url(F.col("u")).alias("c"))
    assert all(r.c == r.d for r in df.select("c", N.canonical_url(F.col("c")).alias("d")).collect())
