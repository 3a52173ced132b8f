import datetime

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, rows):
    """Documents from (doc_id, text, source) with extra columns whose names clash with inner ones."""
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    frame = spark.createDataFrame(full, DOCS)
    for name in ("row_id", "size", "fp", "th", "ord", "n", "found", "kept_id", "mix_size", "label_id", "words", "score"):
        frame = frame.withColumn(name, F.lit(datetime.date(2020, 1, 1)))
    return frame


LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
EDGE = [
    (1, None, None),
    (2, "", "a"),
    (None, "no id here, plain words only", "a"),
    (3, "no id here, plain words only", None),
    (3, "no id here, plain words only", None),
    (4, LONG, "b"),
    (5, LONG + " end", "b"),
    (6, "  \t\n ", "c"),
    (7, "ÄÖÜ straße Σίσυφος naïve café 123 it's <|endoftext|> token=abcdef123 x@y.zz", "c"),
    (None, None, None),
]


@pytest.fixture(scope="session")
def edge_docs(spark):  # nothing is cached here: Spark would plan the library's queries on the cached tables
    return make_docs(spark, EDGE)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(docs):
    return docs.collect()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
