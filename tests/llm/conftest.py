import random

import pytest

#: Columns whose names operators might use themselves.
CLASHING = "host string, score double, node long, component string, key long, row int, ids binary, part int, taken int, _copy int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and clashing column names."""
    rng = random.Random(4)
    words = ["the", "of", "Über", "naïve", "x1", "end.", "日本語", "a,b"]
    long_text = " ".join(rng.choice(words) + str(rng.randrange(3000)) for _ in range(30_000))
    base = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [
        (1, base, "en", "b"), (2, base, "en", "b"), (2, base, "en", "b"), (3, "", "en", None), (4, None, None, "a"), (None, "no id at all here today", "en", "a"),
        (None, None, None, None), (5, " \t\n\x0b\x0c\r ", "de", "c"), (6, long_text, "en", "b"), (7, long_text + " tail", "en", "b"), (8, "two words", "fr", ""), (9, "TWO words", "fr", "ü"),
        (10, "<|endoftext|> literal \U0001f600 emoji", "xx", "b"), (11, base + " fourteen fifteen", "en", "d"), (12, "word", "en", "d"),
    ]
    names = CLASHING.split(", ")
    return spark.createDataFrame([(*r, len(r[1] or ""), *([None] * len(names))) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
