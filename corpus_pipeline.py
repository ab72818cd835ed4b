"""Corpus pipeline: each stage works on what the stage before it kept of ``documents``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import decontam, linededup, ngramjoin, pieces, toxchain
from faultline.llm.store import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose id is not in the table of ids; a null id is in none."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic. The chain is fitted on ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = stored(toxchain.toxic_documents(docs, labels), "toxic")
    return _without(docs, scored.filter("toxic"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without near-duplicate lines. ``n_chars`` counts what is left; a document that loses
    all its lines goes, one that was empty before stays."""
    out = linededup.dedup_lines(docs)
    kept = out.filter((F.col("n_dropped") == 0) | (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0))
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of documents alike in five-word shingles. Of rows
    that share an id, those stay together; documents without words are no group."""
    groups = stored(ngramjoin.ngram_jaccard(docs), "groups")
    return _without(docs, groups.filter(F.col("doc_id") != F.col("component_id")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy no item of ``benchmark``."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, stored(decontam.leaks(docs, items), "leaks"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the pieces of every document and of the text decoded from them."""
    return pieces.piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: learned classifiers, min-hashes and alignments are not for SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
