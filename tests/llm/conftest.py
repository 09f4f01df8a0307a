import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, score string, rest string, token string, part string, id string"


def edge_rows():
    long = " ".join(f"word{i % 977} of the" for i in range(30_000))
    texts = [None, "", "  \n\t ", "One line only here", "one LINE only HERE ", long, long, "é" * 50, "short\nAnother longer line\n\nAnother longer line", "<|endoftext|> </s> &amp;", "a b c"]
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", "y", "z", "p", "q") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[6], (None, "One line only here", *rows[0][2:]), (None, None, *rows[0][2:])]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns whose names the operators use too."""
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """Small texts with shared passages, near and exact copies, runs and odd characters: (doc_id, text)."""
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(300)] + ["Über", "café", "don't", "x,y."]
    passages = [[rnd.choice(words) for _ in range(rnd.choice([25, 40, 60]))] for _ in range(4)]
    docs = []
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([4, 6, 30, 90]))]
        for _ in range(rnd.choice([1, 2, 8])):
            w = list(base)
            for _ in range(rnd.randrange(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            docs.append(" ".join(w))
    for _ in range(30):
        w = [rnd.choice(words) for _ in range(rnd.randrange(0, 30))] + rnd.choice(passages)[rnd.randrange(0, 4) :] + ["r"] * rnd.choice([0, 0, 30])
        docs.append(rnd.choice([" ", " ", "\n"]).join(w))
    docs += ["", "  \n ", "A shared line of text\nB", "a SHARED line of text \nC", "B"]
    return [(3 * i, t) for i, t in enumerate(docs)]
