"""A corpus pipeline: toxicity, quality rules, SimHash near-duplicates, source mixing, packing.

Each stage works on all rows that its predecessor kept.  All but the last
return the columns of ``documents``: the first three leave rows out, mixing
repeats or leaves out rows as its copies say, packing returns the place of
every piece.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import mixing, packing, quality, simhash, toxicity
from tallyspark.llm.common import checkpoint_dir, ship_code, table
from tallyspark.llm.queries import fitted_lexicon, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below the threshold; null and empty texts score low and stay.

    Ties, repeated rows and very long texts are scored one by one and whole; no
    rows give no rows; all columns stay.
    """
    ship_code(spark)
    return toxicity.drop_toxic(docs, fitted_lexicon(docs, spark, sf_dir))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep; null and empty texts have no words and go.

    A null language is one of its own; repeated rows are judged alike; no rows
    give no rows; all columns stay.
    """
    ship_code(spark)
    return quality.drop_poor(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, rows without a doc_id included.

    The smallest doc_id stays, ties go by the row's hash, equal rows leave one;
    texts without a word are one group; no rows give no rows; all columns stay.
    """
    ship_code(spark)
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them; a null source is a source.

    Texts without a word have size 0; no rows give no rows; all columns stay.
    """
    ship_code(spark)
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every row, null and empty texts as an end mark.

    Repeated rows are packed as often as they come; no rows give no rows.
    """
    ship_code(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages hash, fit and pack beyond what SQL expresses; tests/llm compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage returns is written as Parquet to the shared folder and read again."""
    folder = posixpath.join(checkpoint_dir(spark), f"corpus-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = posixpath.join(folder, f"{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
