import random

import pytest

ODD = [
    (900, None), (901, ""), (902, "   \t\n"), (903, "x"), (904, "long " * 30_000), (905, "Ünï çødé ### 日本語 テキスト"),
    (906, "no break\x1chere\x85nor\xa0here"), (907, "\n\n\n"), (908, "tail \n  two  blanks\n"),
]


@pytest.fixture(scope="session")
def made():
    """(doc_id, text): copies, near copies, shared lines and odd texts; one row stands twice."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgHIJ") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    shared = [" ".join(rng.choices(words, k=12)) + " shared among documents" for _ in range(4)]
    docs = []
    for doc in range(120):
        lines = [" ".join(rng.choices(words, k=rng.randint(3, 40))) for _ in range(rng.randint(1, 6))]
        lines += rng.sample(shared, rng.choice((0, 0, 1, 2)))
        rng.shuffle(lines)
        docs.append((doc, "\n".join(lines)))
    for k in range(30):
        base = docs[k % 7][1].split(" ")
        for _ in range(k % 3):
            base[rng.randrange(len(base))] = "changed"
        docs.append((200 + k, " ".join(base)))
    return docs + ODD + [docs[3]]


@pytest.fixture(scope="session")
def table(spark, made):
    """The rows with columns that clash with what operators add."""
    rows = [(d, t, "en", "s", None, 1.0, "mine", 7) for d, t in made]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, labels string, N_WORDS long"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
