"""Small documents with the cases that every operator has to take."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{k % 5}", len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, one word, ties, repeated rows, repeated ids, odd characters, a long text."""
    long = words(random.Random(5), 30_000)
    return [
        (None, None), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "two words"), (None, "null id with text of some words in it"),
        (6, "same row twice here"), (6, "same row twice here"), (7, "same id first text of several words"), (7, "same id other text of several words"),
        (8, "ünïcödé \U0001F600 ▁ x\u0000y " * 3), (9, long), (10, long), (11, "a" * 5000), (12, "-" * 300 + "\n" + "-" * 300),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Columns that have the names of working columns."""
    names = "id tag text2 row h n key cell side bucket blob leaf line number numbers numbers2 component_id features score repository owner found spans data point weight __id __tag __later".split()
    from pyspark.sql import functions as F

    return odd.select("*", *(F.lit(1).alias(n) for n in names if n != "text2"))
