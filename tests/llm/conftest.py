import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def passage(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [a + b for a in ("th", "an", "re", "st", "ou", "er", "in", "ly") for b in ("ing", "ed", "tion", "ble", "ha", "es", "on", "at")]


def hard_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and ids."""
    rng = random.Random(5)
    base = passage(rng, 120)
    rows = [(1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \t\n\x0b ", "en", None, 5), (4, base + ".", "en", "a", 1), (5, base + ".", "en", "b", 1), (5, base + ".", "en", "b", 1)]
    rows += [(6, base.replace(base.split()[60], "changed", 1) + ".", "en", "a", 1), (7, "one two three", "en", "c", 1), (8, "One TWO\nthree", "en", "c", 1), (None, "no id here at all", "en", "a", 1)]
    rows += [(9, passage(rng, 30_000) + ".", "en", "a", 1), (10, "x" * 200_000, "en", "a", 1), (11, "é😀 \u0085   ß\u0000 end", "de", "ü", 1), (12, "of of of of of " * 30, "en", "a", 1)]
    rows += [(i, passage(rng, rng.randrange(1, 90)) + rng.choice([".", "", "\nshort line.\nshort line."]), "en", rng.choice("abc"), 1) for i in range(20, 60)]
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    """The hard rows with extra columns whose names clash with internal and output ones."""
    d = spark.createDataFrame(hard_rows(), SCHEMA)
    from pyspark.sql import functions as F

    return d.repartition(4).withColumns({c: F.lit("clash") for c in ("size", "key", "node", "score", "spans", "n_words", "target", "copies", "row", "t", "w", "held_out", "ids")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def save(spark, path, rows=None, labels=(), pages=()):
    spark.createDataFrame(hard_rows() if rows is None else rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(pages), "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)
