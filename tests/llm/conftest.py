import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds documents from (doc_id, text[, source]) rows."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOC)

    return make


@pytest.fixture(scope="session")
def sf01():
    d = Path("/root/testdata/sf0.01")
    if not d.exists():
        pytest.skip("no test tables")
    return str(d)


ODD = [(1, None, None), (2, "", "a"), (3, "  \t\n ", "a"), (None, "some words here", "a"), (4, "word " * 30_000, "b"), (5, "same text twice", "b"), (5, "same text twice", "b"), (6, "é" * 5000, None), (7, "\x00\x1c odd \u2028 signs 🙂", "c")]


@pytest.fixture
def odd(docs, spark):
    """Nulls, empty and very long texts, equal rows, and columns whose names an operator may use itself."""
    from pyspark.sql import functions as F

    return docs(*ODD).withColumn("score", F.lit("x")).withColumn("label", F.lit(1)).withColumn("g", F.lit(2)).withColumn("size", F.lit(3)).withColumn("rule", F.lit(4))
