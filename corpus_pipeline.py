"""A training-data pipeline over ``documents``, as a list of stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Nulls, empty
texts, repeated rows, empty tables and further columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.llm import bpe, line_dedup, mixing, quality, simhash
from wardspan.llm.common import cut, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    return judged.filter("predicted = 1").select(docs.columns)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; n_chars follows."""
    rest = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rest.select(docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated until each source nears its target."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, little-endian unsigned 32-bit, with digests of the ids and of the text they decode to."""
    out = bpe.encode(docs)
    return out.withColumns({"ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256)}).drop("decoded")


STAGES = [
    ("quality classifier", good),
    ("line dedup", fresh_lines),
    ("SimHash near-dedup", distinct),
    ("mixing sources", mixed),
    ("BPE encoding", encoded),
]

#: SQL can't express the classifier, the fingerprints or the encoding; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
