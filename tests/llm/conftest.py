import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, place string, shard int, node long, label long, bucket long"


def prose(seed, n, words=None):
    """Words drawn from a list, the same for the same seed."""
    import random

    own = random.Random(seed)
    words = words or [f"{chr(97 + i % 20)}{chr(97 + i // 20)}{chr(97 + seed % 26)}" for i in range(400)]
    return " ".join(own.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in any column, empty and long texts, ties, repeated rows, and columns whose names operators use."""
    copied = prose(1, 120)
    texts = [
        (1, copied, "en", "a"),
        (2, copied, "en", "a"),
        (2, copied, "en", "a"),
        (3, copied.replace(" ", "  ").upper(), "en", "b"),
        (4, "", "en", "a"),
        (5, None, None, None),
        (None, prose(2, 60), "en", "b"),
        (6, " \t\n ", "fr", None),
        (7, prose(3, 30000), "fr", "c"),
        (8, "12 34 ... 🙂", None, "c"),
        (9, prose(4, 50) + " " + prose(1, 60), "en", "c"),
        (10, "ein wort", "de", "d"),
    ]
    rows = [(i, t, lang, source, None if t is None else len(t), 0.5, 1, "x", 1, 1, 1, 1) for i, t, lang, source in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    """No rows."""
    return spark.createDataFrame([], SCHEMA)
