import random

import pytest
from pyspark.sql import DataFrame, SparkSession

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept string, score string, shard int, "
          "slot string, items string, ids string, _norm string, _digest string, _salt string, _feature string, n long, id string")


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}x{rng.randrange(9)}" for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls in each column, empty and blank texts, a very long text, copies, near copies, repeated rows, odd white space."""
    base = prose(1, 160)
    near = base.replace(base.split()[70], "changed", 1)
    long = prose(2, 60_000, 5000)
    texts = [
        (1, base), (2, base), (3, near), (4, f"  {base}\n"), (5, None), (6, None), (7, ""), (8, " \t\n"), (9, long),
        (10, prose(3, 40) + " " + " ".join(base.split()[20:120]) + " " + prose(4, 30)), (11, "A"), (12, "a b c"), (13, "a b c"),
        (14, "12 34 !!"), (15, "x y   z\u0085 \x1c é  ß\n\n日本語 ключ <|endoftext|> it's"), (15, base), (16, prose(5, 50)),
        (16, prose(5, 50)), (None, base), (None, None), (2**53 + 1, prose(6, 80)), (-3, prose(6, 80)),
    ]
    clash = ("k", "s", 7, "l", "i", "d", "_n", "_d", "_s", "_f", 3, "id")
    rows = [(i, t, "en" if i and i % 2 else None, None if i == 3 else f"s{i}", None, *clash) for i, t in texts]
    return rows + [(17, "plain words here", None, None, None, *[None] * 12)]


@pytest.fixture(scope="session")
def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3, "source").cache()


@pytest.fixture(scope="session")
def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
