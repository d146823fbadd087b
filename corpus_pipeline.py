"""Corpus pipeline: documents to token ids, one training-data operator a stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read back as the next one's ``docs``; all but the last return
the columns of ``documents``. Nulls, empty texts, ties, repeated rows, empty
tables and extra columns are treated as each operator's docstring says.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rightsize.llm import byte_bpe, exact_dedup, language_id, minhash_forest, mixing
from rightsize.llm.common import Tables, release
from rightsize.llm.queries import bpe_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a likely learned language go."""
    return language_id.keep_known(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays; links from a similarity of 0.8."""
    return minhash_forest.keep_one(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources meet their target weights."""
    return mixing.repeat_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the digest of what they decode to."""
    out = byte_bpe.encode(docs, bpe_path())
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(byte_bpe.decode(F.col("ids"), bpe_path()), 256).alias("decoded_sha256"))


def _fresh(stage):
    """``stage`` on a driver that has let go of what the stage before it held."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", _fresh(identify_language)),
    ("exact_dedup", _fresh(drop_exact_copies)),
    ("minhash_near_dedup", _fresh(drop_near_copies)),
    ("mixing", _fresh(mix_sources)),
    ("byte_bpe", _fresh(tokenise)),
]

#: Trained language ID, minhash candidates, Newton steps and BPE merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result a table in the shared folder."""
    tables = Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tables.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
