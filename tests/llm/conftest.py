import random

import pytest
from pyspark.sql import types as T

#: Extra columns whose names the operators use inside.
CLASH = ["row", "key", "raw", "size", "target", "kept", "digest", "node", "h", "d", "n", "stretch", "gone", "score", "group", "t"]
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASH)])
LABELS = "doc_id long, quality int, toxic int, score string, text string"


def word(rng, k=4):
    return "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, k + 3)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    def build(rows):
        full = [(i, t, *(rest or ("en", "s0"))) for i, t, *rest in rows]
        return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), *CLASH) for i, t, lang, src in full], DOCS)
    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, repeated identifiers and a very long text."""
    rng = random.Random(5)
    base = prose(rng, 60)
    rows = [(1, base), (2, base), (3, base.upper()), (3, base.upper()), (4, None), (5, ""), (6, " \t\n"), (7, "one"),
            (8, "one two three four"), (8, "another text of identifier eight here"), (None, base), (None, None),
            (9, prose(rng, 20_000)), (10, base + " tail"), (11, "ÄÖ ß é   x y \U0001F600 " + base), (12, base, None, None),
            (13, base + "\n" + prose(rng, 30), "de", ""), (14, "password = abcdefghijkl123", "en", "s1")]
    return rows + [(100 + k, prose(rng, 5 + k), "en", f"s{k % 3}") for k in range(30)]


@pytest.fixture(scope="session")
def odd(make, odd_rows):
    return make(odd_rows)


@pytest.fixture(scope="session")
def nothing(make):
    return make([])


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame([(k, k % 2, int(k % 3 == 0), "x", "y") for k in (*range(1, 15), *range(100, 130))]
                                 + [(None, 1, 1, None, None), (5, None, None, None, None), (7, 0, 1, None, None)], LABELS)
