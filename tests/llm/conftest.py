import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, node string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, near copies, a shared passage, clashing names."""
    rng = random.Random(5)
    passage = words(rng, 60)
    base = words(rng, 120)
    texts = [None, "", " \t\n", "one", "one two", base, base, base.replace(" w1", " x1", 1), base + " tail words here",
             words(rng, 30) + " " + passage + " " + words(rng, 20), passage, "Straße ΑΣ İ é é 日本 x, y. <|endoftext|>", words(rng, 6000),
             "a" * 700, "ab" * 400, words(rng, 50) + "\r\n" + passage]
    rows = [(k, t, "en" if k % 3 else None, "src0" if k % 4 else None, None if t is None else len(t), k % 2, "x") for k, t in enumerate(texts)]
    rows.append(rows[9])  # a repeated row
    rows.append((None, base, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
