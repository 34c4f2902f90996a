"""Small tables with every awkward row, shared by the tests of this folder."""

import random

import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, or give to their results.
CLASHES = ["size", "copies", "score", "row", "n", "node", "label", "rank", "removed", "_row", "_text", "doc", "block", "train"]


def prose(rng, words, lines=1):
    stock = [rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") + rng.choice(["", "n", "r", "st", "lo", "mi"]) for _ in range(400)]
    return "\n".join(" ".join(rng.choice(stock) for _ in range(words)) for _ in range(lines))


def awkward_rows():
    """Documents: plain ones, copies, near copies, and awkward ones."""
    rng = random.Random(5)
    rows = []
    for i in range(40):
        text = prose(rng, rng.randint(20, 60), rng.randint(1, 4))
        rows.append((i, text, rng.choice(["aa", "bb", None]), f"s{i % 3}", len(text)))
    base = rows[3][1].split(" ")
    for i in range(40, 52):  # near copies of 3, exact copies of 4
        w = list(base)
        w[i % len(w)] = f"changed{i}"
        rows.append((i, " ".join(w), "aa", "s0", 0))
        rows.append((100 + i, rows[4][1], None, None, 0))
    rows += [
        (200, None, "aa", "s1", None),
        (201, "", None, "s1", 0),
        (202, " \t\n ", "bb", None, 4),
        (203, "one", "aa", "s2", 3),
        (204, "one two", "aa", "s2", 7),
        (205, "One  TWO", "aa", "s2", 8),
        (206, "é ß 你好 😀 naïve", "bb", "s2", 14),
        (207, prose(rng, 30_000), "aa", "é", 0),
        (None, "a text without an id " * 5, None, None, 0),
        (None, None, None, None, None),
        (208, "again and again the same row", "aa", "s1", 28),
        (208, "again and again the same row", "aa", "s1", 28),
        (209, "same id, other text of its own here", "aa", "s1", 1),
        (209, "other words under this id altogether", "aa", "s1", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    """The rows as a table, with extra columns of clashing names."""
    df = spark.createDataFrame(awkward_rows(), COLUMNS)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(5, F.rand(3))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
