import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def small(docs):
    """doc_id -> text of the small table."""
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with names that operators use."""
    prose = " ".join(f"word{i % 97} and{i % 89}" for i in range(300))
    rows = [(1, None, "en", "a", None), (2, "", None, "a", 0), (3, "single", "en", None, 6),
            (None, prose + " null id", "en", "a", 1), (None, None, None, None, None), (5, prose, "en", "a", 2),
            (5, prose, "en", "a", 2), (6, prose + " more", "en", "b", 2), (7, " \n\t\x0b \n", "en", "b", 9),
            (8, "x" * 100_000, "en", "b", 9), (9, " ".join(f"t{i}" for i in range(120_000)), "de", "b", 9),
            (10, "tel 0151-234-5678, mail a.b@c.example.org éü\U0001f600 10.20.30.40 4111 1111 1111 1111", "fr", "b", 9)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("n_words", "kept", "component_id", "node", "cell", "h1", "row", "label", "y", "body", "chunk", "score"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame.repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
