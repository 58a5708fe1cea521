import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _th int, _text string, hits int, n int, component int, _score int, _row int, near int"


def words(r, n, size=400):
    return " ".join(f"{r.choice('abcdefgh')}{r.randrange(size)}é" for _ in range(n))


def document_rows():
    """Exact and near copies, a shared passage, periodic and empty texts, nulls, repeated rows, one long text."""
    r = random.Random(5)
    texts = [words(r, r.randrange(1, 160)) for _ in range(24)]
    passage = words(r, 90)
    texts += [words(r, 30) + " " + passage + " " + words(r, 30) for _ in range(4)]
    base = words(r, 200).split()
    for k in range(8):
        t = base[:]
        for _ in range(k):
            t[r.randrange(200)] = f"edit{r.randrange(1000)}"
        texts.append(" ".join(t))
    texts += [texts[0], texts[1], texts[30], "abc " * 300, "x" * 1500, "", " \t\n", "one two", "ONE  two", "a b c d e", "A\tB\nC d E", None]
    texts.append(words(r, 9000, 100000) + " " + passage)
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[2]), (None, None)]
    return [(i, t, "en", "s", len(t or ""), "k", 1, "clash", 2, 3, 4, 5, 6, 7) for i, t in rows]


@pytest.fixture(scope="session")
def document_list():
    return [r[:2] for r in document_rows()]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(document_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
