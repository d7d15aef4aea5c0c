"""Cases of the first review that were lost before."""

import random

from presswork.llm import secret_scan


def token(rnd, n):
    return "".join(rnd.choice(secret_scan.ALPHABETS["base64"][:62]) for _ in range(n))


def test_secrets_behind_an_equals_sign(table):
    rnd = random.Random(22)
    names = ["sig", "auth", "export DB_PASS", "a_name_of_more_than_twenty_letters"]
    rows = [(i, f"{names[i % 4]}={token(rnd, 40)}{'=' * (i % 3)} there") for i in range(120)]
    found = {r.doc_id: r.spans for r in secret_scan.scan(table(rows)).collect()}
    starts = {i: t.index("=") + 1 for i, t in rows}
    assert sum(any(s.kind == "random" and s.start == starts[i] for s in found[i]) for i, _ in rows) >= 90


def test_every_token_is_a_candidate(table):
    texts = ["see QWERTYlkjhgfdsazxcvm there", "see QWERTYlkjhgfdsazxcv1 there", "12345678901234567890", "too=Short1234567890abc"]
    got = {r.doc_id: [s.body for s in r.c] for r in table(list(enumerate(texts))).select("doc_id", secret_scan.candidates(secret_scan.col("text")).alias("c")).collect()}
    assert got == {0: [texts[0].split()[1]], 1: [texts[1].split()[1]], 2: [texts[2]], 3: []}


def test_secrets_in_a_tiny_table_and_in_a_sparse_class(table):
    rnd = random.Random(23)
    few = [(i, f"see {token(rnd, 90)} there") for i in range(6)]
    random_ = lambda rows: {r.doc_id for r in secret_scan.scan(table(rows)).collect() if any(s.kind == "random" for s in r.spans)}
    assert len(random_(few)) >= 4
    assert random_([(7, f"see {'abcdefgh01' * 4} there")]) == set()
    many = [(100 + i, f"see {token(rnd, 40)} there") for i in range(60)]
    assert len(random_(few + many) & set(range(6))) >= 4


def test_one_rule_for_any_number_of_tokens(spark):
    """Thresholds by brute force, for no, few and many tokens."""
    rnd = random.Random(24)
    for n in (0, 3, 40, 2000):
        judged = [(rnd.randrange(3), rnd.random() ** (1 if rnd.random() < 0.6 else 6)) for _ in range(n)]
        count = {(c, b): 0 for c in range(4) for b in range(50)}
        for c, p in judged:
            count[c, min(49, int(p * 50))] += 1
        known = {}
        for c in range(4):
            for b in range(50):
                others = sum(count[k, b] for k in range(4) if k != c) + 20 * ((0.1 if b < 5 else 0) + 0.01)
                known[c, b] = count[c, b] + 20 * others / (sum(x for (k, _), x in count.items() if k != c) + 20)
        want = {}
        for c in range(4):
            upper = 2 * sum(known[c, b] for b in range(25, 50))
            for b in range(49, 0, -1):
                found, seen = (sum(x[c, k] for k in range(b, 50)) for x in (known, count))
                if (found - upper * (50 - b) / 50 - 1.645 * seen**0.5) / found <= secret_scan.FALSE_DISCOVERIES + 1e-9:
                    want[c] = b
        rows = spark.createDataFrame(judged, "class int, p double")
        assert {r["class"]: r.cut for r in secret_scan.thresholds(rows).collect()} == want and len(want) == 4
