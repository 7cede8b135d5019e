import os
import sys

import duckdb
import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from samples import DATA  # noqa: E402

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use inside.
        *[T.StructField(n, T.StringType()) for n in ("group", "shard", "block", "word", "fp", "root", "key", "n", "window", "surrogate", "ids")],
    ]
)


@pytest.fixture(scope="session")
def make_documents(spark):
    """Documents from ``(doc_id, text[, lang])``, with extra columns of clashing names."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 0, *["x"] * 11) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return build


@pytest.fixture(scope="session")
def odd_documents(make_documents):
    """Missing and empty texts, missing ids, repeated rows, ties, other scripts, a very long text."""
    prose = "the quick brown fox jumps over the lazy dog and runs away from all of them today "
    return make_documents(
        [
            (1, None), (2, ""), (3, "   \n\t "), (None, "a text without an id, one of two"), (4, prose), (4, prose),
            (5, prose), (6, prose.upper()), (7, "one"), (8, "..."), (9, "日本語 のテキスト です"), (10, None, None),
            (11, "Der schnelle braune Fuchs springt über den faulen Hund", "de"), (12, prose * 2000), (13, "x" * 5000),
            (None, None, None), (14, "mail me: a.b@c.example.com or +1 (555) 123-4567!", "'quoted\\"),
        ]
    )


@pytest.fixture(scope="session")
def no_documents(make_documents):
    return make_documents([])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
