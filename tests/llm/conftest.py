from __future__ import annotations

import random

import pytest

WORDS = "the path ramp kerb lift stair bridge river town stone light dark wide narrow steep flat open shut old new".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty and blank texts, ties, repeated rows, a long text and odd characters."""
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.replace("ramp", "slope", 1)
    rows = [(i, prose(rng, rng.randrange(5, 90)), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100, base, "en", "s0", 1), (101, base, "en", "s1", 1), (102, near, None, None, None), (103, near, "en", None, 1)]
    rows += [(110, None, "en", "s0", 0), (111, "", None, "s1", 0), (112, " \n\t ", "en", "", 0), (None, "no id here at all " * 3, "en", "s2", 1), (None, None, None, None, None)]
    rows += [(120, prose(rng, 30_000), "en", "s0", 1), (121, "x" * 50_000, "en", "s0", 1), (122, "école ½ Σας it's 日本語   ß", "fr", "s9", 1)]
    rows += [(130, "same row", "en", "s0", 1)] * 3
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """As a DataFrame, with further columns named like the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    clash = "h size copies taken threshold cls key keys lines host score kept piece start length row symbols n_words held_out target __host __lines __key __plan"
    return df.select("*", *[F.lit("x").alias(c) for c in clash.split()])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
