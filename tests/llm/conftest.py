import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in each column, empty and long texts, ties, repeated rows, copies, shared passages."""
    rng = random.Random(7)
    passage = words(rng, 30)
    out = [(i, words(rng, rng.randrange(1, 90)), rng.choice(["aa", "bb"]), "s", 1) for i in range(40)]
    out += [(100, None, None, None, None), (101, "", "aa", "s", 0), (102, " \t\n", None, "s", 3), (103, "...!", "aa", "s", 4), (104, "Ünïcode ß WORD wörd, it's 42%!", "bb", None, 9)]
    out += [(200 + i, out[5][1], "aa", "hot", 1) for i in range(25)]
    out += [(300 + i, f"{words(rng, 12)} {passage} {words(rng, i)}", "bb", "hot", 1) for i in range(6)]
    out += [(400, words(rng, 30_000), "aa", "s", 1), (401, "same " * 50, "aa", "s", 1), (401, "same " * 50, "aa", "s", 1), (None, passage, "aa", "s", 1), (None, None, "aa", "s", 1)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns under names that the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["n_words", "n_removed", "score", "lang_pred", "ambiguous", "sequence_id", "offset", "shard", "shard_bytes", "length", "piece", "kept", "posterior", "component_id", "fp", "row", "root", "node", "level", "chunk", "bucket", "data", "task", "held_out", "_spoken", "_kept", "_row", "_chunk", "_task", "_found", "_x", "_s", "_before", "_slots", "_salt", "_own", "_rank", "_slot", "_t", "_w", "_h", "_fp", "_n", "_nth"]
    return docs.select("*", *[F.lit("x").alias(n) for n in names])
