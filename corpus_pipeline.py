"""A training-corpus pipeline of five stages over `documents`.

Each stage takes what the one before it kept, and hands on the columns of
documents; the last returns the tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.common import documents
from presswork.llm.decontamination import decontaminate
from presswork.llm.ngram_join import one_of_each
from presswork.llm.quality_rules import PRODUCTION, ledger, passes
from presswork.llm.secret_scan import redact
from presswork.llm.sentencepiece_codec import DIGEST, default_model, sp_digest

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text now is."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the production policy."""
    return ledger(docs, keep=COLUMNS).where(passes(PRODUCTION)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of linked documents."""
    return one_of_each(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; those that are little else go."""
    return _counted(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced."""
    return _counted(redact(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the piece ids of each document."""
    coded = sp_digest(docs, default_model())
    return coded.select("doc_id", *[F.col("coded")[f.name].alias(f.name) for f in DIGEST])


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("sentencepiece", tokens),
]

#: SentencePiece has no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, as one plan."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
