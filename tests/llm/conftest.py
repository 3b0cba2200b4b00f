import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id string, key int, n int, hits string, rec string, "
    "shard string, slot string, score string, size string, taken string, held string, bucket string, part string, row_key string"
)


def row(i, text, source="s1"):
    return (i, text, "en", source, 0, "x", 1, 2, "h", "r", "a", "b", "c", "d", "e", "f", "g", "p", "k")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text[, source]), with extra columns that have the names of results and helpers."""

    def make(rows):
        return spark.createDataFrame([row(*r) for r in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in id, text and source, empty and blank texts, a very long text, repeated rows, ties."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    shared = "A line that many documents share, word for word."
    base = prose(60)
    rows = [(1, base), (2, base), (3, base.replace("w1 ", "v ", 1)), (4, None), (5, ""), (6, " \t\n\x0b "), (7, prose(60_000)),
            (8, shared + "\n" + prose(20)), (9, prose(15) + "\n  " + shared.upper() + " "), (10, shared + "\n" + shared),
            (None, base), (None, None), (11, "one"), (12, "One"), (13, "one two"), (14, prose(40)), (14, prose(40)),
            (15, " café 　 x y")]
    rows = [(i, t, None if (i or 0) % 3 == 0 else f"s{(i or 0) % 4}") for i, t in rows]
    return rows + [(20, base, "s2"), (20, base, "s2")]
