"""A corpus pipeline: quality, exact and near duplicates, mixing, tokens. Each stage works on all its predecessor kept.

A stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Nulls, empty texts, repeated rows and empty tables
are treated as the stage's operator says; extra columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.llm import exact, mixing, pieces, quality, simhash
from panelmark.llm.common import saved, table, text_of


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of this stage's own documents."""
    ranking = quality.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(ranking.score(text_of()) >= quality.REJECT_BELOW)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document with the smallest id stays."""
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(docs, saved(mixing.mixed(docs)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens."""
    return pieces.encoded(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode),
]

#: The quality model, the knapsack and the lattice are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
