import random

import pytest

LONG = "lorem ipsum dolor " * 20_000


def sentence(draw: random.Random, n: int, letters: str = "abcdefgh") -> str:
    return " ".join("".join(draw.choices(letters, k=draw.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in any column, empty and very long texts, repeated rows, copies."""
    draw = random.Random(4)
    base = [sentence(draw, 80) for _ in range(6)]
    rows = [(i, base[i % 6] + (" tail" if i % 2 else ""), "en", "src0") for i in range(24)]
    rows += [(30, None, "en", None), (31, "", None, "s"), (32, " \n\t ", "en", "s"), (33, "!!! --- \n\n", "en", "s"), (34, "one", "en", "s"), (35, "One  two", "en", "s")]
    rows += [(40, LONG, "en", "s"), (41, "x" * 50_000, "en", "s"), (None, base[0], "en", "s"), (None, None, None, None), (5, base[5] + " tail", "en", "src0"), (5, base[5] + " tail", "en", "src0")]
    return rows


#: Columns whose names the operators use themselves.
CLASHING = ["label", "n", "score", "shard", "slot", "arc", "row", "words", "size", "group", "rep", "digest", "window", "rate", "kept", "at", "item_id", "n_tokens"]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(messy_rows, "doc_id long, text string, lang string, source string")
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def messy_labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(20)] + [(30, 0, 1), (31, None, None), (None, 1, 1), (5, 0, 0), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def nothing(messy, messy_labels):
    from pyspark.sql import functions as F

    return messy.where(F.lit(False)), messy_labels.where(F.lit(False))
