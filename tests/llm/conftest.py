import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, quality string, failed long, spans string"


@pytest.fixture(scope="session")
def table(spark):
    """A documents table from (doc_id, text) pairs, with extra columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, None, "s", len(t) if t is not None else None, 7, "q", 1, "x") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two three four five six seven eight nine ten eleven twelve"),
    (4, "one two three four five six seven eight nine ten eleven twelve"),
    (None, "a row without an id but with some words in it for all that"),
    (5, "É Ünï 😀 words　with  odd blanks \x00 and a\x01b"),
    (6, "word " * 30_000),
    (7, "x" * 50_000),
]


@pytest.fixture(scope="session")
def odd(table):
    return table(ODD)


@pytest.fixture(scope="session")
def empty(table):
    return table([])


@pytest.fixture(scope="session")
def prose():
    """Random texts, some with near and exact copies and shared lines."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = ["\n".join(line(rnd.randint(8, 40)) for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    shared = line(60)
    for k in range(40):
        base = rnd.choice(texts[:20]).split(" ")
        for _ in range(rnd.randint(0, 4)):
            base[rnd.randrange(len(base))] = rnd.choice(words)
        texts.append(" ".join(base))
    texts += [line(20) + "\n" + shared for _ in range(6)] + texts[:5]
    return list(enumerate(texts))
