import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, h string"


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))


def rows(texts, ids=None, sources=None):
    """Documents with two more columns, of names that operators use inside."""
    ids = ids or range(len(texts))
    sources = sources or [f"s{k % 3}" for k in range(len(texts))]
    return [(i, t, "en", s, None if t is None else len(t), "x", "y") for i, t, s in zip(ids, texts, sources, strict=True)]


@pytest.fixture(scope="session")
def frame(spark):
    return lambda texts, ids=None, sources=None: spark.createDataFrame(rows(texts, ids, sources), SCHEMA)


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls, empty and very long texts, ties and repeated rows, a null id."""
    rng = random.Random(1)
    long = sentence(rng, 30_000)
    same = sentence(rng, 80)
    texts = [None, "", "   \n\t ", same, same, same, long, "one", "a b", "é中😀 " * 60, sentence(rng, 50), "x" * 5000, same + " more words here"]
    ids = [0, 1, 2, 3, 4, 4, 6, 7, 8, 9, None, 11, 12]
    return frame(texts, ids)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
