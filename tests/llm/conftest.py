import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    from tallyspark.llm.common import ship_code

    ship_code(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark, docs):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    text = "The cat and the dog are in the house of the man with a hat. " * 3
    rows = [
        (1, text, "en", "a", 3), (1, text, "en", "a", 3), (2, text, "en", None, None), (3, None, "en", "b", 0),
        (4, "", None, "b", 0), (None, text, "de", "c", 1), (None, None, None, None, None), (5, " \t\n ", "xx", "c", 3),
        (6, "word " * 60_000, "en", "c", 300_000), (7, "élan & <b>", "fr", "\U0001f600", 9), (8, "one two", "en", "a", 7),
        (9, "one two", "en", "a", 7), (2**62, "line\n\nline\nline ###", "es", "￿", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    for c in ("size", "fp", "score", "component_id", "_size", "copies", "shard", "_g", "label", "_quality", "length", "n"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def token_file():
    from tallyspark.llm.queries import tokenizer_path

    path = tokenizer_path()
    assert os.path.exists(path)
    return path
