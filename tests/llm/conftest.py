import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, odd characters, nothing, and much of the same."""
    rng = random.Random(7)
    texts = [None, "", "   ", "one", "one two", "\n\n", "a\nb\n\na\nb", "Ünïcode ÀÉ 漢字 😀 " * 20, "spam eggs " * 200, "same line here\n" * 40]
    passage = words(rng, 60, 10_000)
    for _ in range(60):
        lines = [words(rng, rng.randint(1, 40), 3_000) for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines) + 1), passage)
        texts.append("\n".join(lines))
    base = [words(rng, 200, 2_000).split() for _ in range(3)]
    for b in base:
        for _ in range(4):
            near = list(b)
            near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    texts += texts[10:25]
    texts.append(words(rng, 30_000, 50_000))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus as documents, over several partitions, with columns that clash with inner names."""
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 4 * (i % 2)}", len(t or "")) for i, t in corpus]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.selectExpr("*", "'x' AS id", "'x' AS body", "1 AS print", "2 AS keep", "3 AS gone", "array(1) AS spans")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, rows of one id and different texts, and rows without an id."""
    text = "the quick brown fox jumps over the lazy dog " * 15
    rows = [(1, text), (1, text), (1, "other words"), (None, text), (None, None), (None, None), (2, None), (3, "")]
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
