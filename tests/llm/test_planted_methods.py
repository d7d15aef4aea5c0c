"""Tables in which the methods of the URL filter and of the sanitiser have something to find: recall and precision, and hot keys."""

import random

from pyspark.sql import functions as F

from presswork.llm import pii, url_filter


def test_url_rules_find_planted_combinations(spark):
    """Bad are urls with both of two tokens; each of these alone is harmless. A third of the pages has one url."""
    rnd = random.Random(5)
    pages, labels = [], []
    for k in range(3_000):
        bits = [rnd.random() < 0.5, rnd.random() < 0.5]
        url = f"https://h{k % 2}.test/{'win/' if bits[0] else ''}{'now/' if bits[1] else ''}s{k}x"
        if k % 3 == 0:
            bits, url = [True, False], "https://h0.test/win/same"
        pages.append((k, url))
        if k % 2 == 1:
            labels.append((k, 0 if all(bits) else 1, 0))
    got = url_filter.judge(
        spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ).select("page_id", "judged.*").collect()
    blocked, bad = {r.page_id for r in got if r.verdict == "block"}, {k for k, u in pages if "/win/now/" in u}
    assert len(got) == len(pages) and blocked == bad and all(r.rule is None for r in got)


def test_terms_that_reveal_an_address_are_found(table):
    """A name that stands with an address only reveals it; words of all texts don't. One address is in a third of the texts."""
    rnd = random.Random(6)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    rows, planted = [], 0
    for k in range(360):
        some = [rnd.choice(words) for _ in range(30)]
        if k % 3 == 0:
            some += ["hot@example.com"]
        elif k % 12 == 1:
            some[rnd.randrange(30)] = "Zebedee"
            some += ["rare@example.org"]
            planted += 1
        rows.append((k, " ".join(some)))
    found = [(s.body, r.text[s.start : s.end]) for r in pii.scan(table(rows), keep=("doc_id", "text")).collect() for s in r.spans if s.kind == "term"]
    assert len([f for f in found if f[1] == "Zebedee"]) == planted and {f[1] for f in found} == {"Zebedee"}
    clean = {r.doc_id: r.text for r in pii.sanitise(table(rows)).collect()}
    assert not any("Zebedee" in t or "@" in t for t in clean.values()) and len(clean) == len(rows)
