import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size long, u long"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing columns."""
    rng = random.Random(7)
    words = ["the", "and", "Ünder", "MIT", "license", "of", "house", "x1", "тест", "a", "b", "c", "stone", "river"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 90))) + rng.choice(["", "\n", "\n\nend."]), rng.choice(["en", "de"]), rng.choice(["s1", "s2", "s3"])) for i in range(60)]
    rows += [(100, None, "en", "s1"), (101, "", None, None), (102, " \t\n ", "de", "s2"), (103, "one", "en", None), (104, "word " * 30_000, "en", "s1"), (105, "\x00\x0b!?", "en", "s4")]
    rows += [rows[3], rows[3], (106, rows[5][1], "de", "s9"), (107, rows[5][1].upper(), "de", "s9"), (None, "no id here", "en", "s1"), (None, None, None, None)]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, 2) for r in rows], DOCS).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
