"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import chatformat, chatrepair, decontam, huffman, ibltdiff, linededup, ngramjoin, pieces, secretscan, styletree, toxchain, urltrees, wordruns

ORACLE_SQL: dict[str, str] = {
    "op12_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, regexp_replace(text, '(<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<role>|<is>|</role>|<turn>)', '\\\1', 'g') AS esc,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS joins FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(esc) + CASE WHEN joins THEN 8 WHEN role = 'system' THEN 17 WHEN role = 'user' THEN 15
    WHEN role = 'assistant' THEN 9 ELSE 21 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op2_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urltrees.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("p_block", 6).alias("p_block"))


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and item that it copies."""
    found = decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 6))


def op4_toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document that the chain calls toxic."""
    return toxchain.toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).filter("toxic")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.ngram_jaccard(_table(spark, sf_dir, "documents"))


def op6_style_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styletree.extract(_table(spark, sf_dir, "pages"))


def op7_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ibltdiff.fingerprints(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after the line dedup, and how many lines it lost."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.find_secrets(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, after a rule made some of them repeat."""
    docs = wordruns.planted(_table(spark, sf_dir, "documents"))
    return wordruns.run_digests(wordruns.collapse_runs(docs))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, read back from the formatted strings."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(hard).alias("text"))
    return chatformat.chat_digests(chatformat.format_chats(turns.unionByName(probe)))


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage by a rule, and its cheapest repair."""
    return chatrepair.repair_digests(chatrepair.damaged(_table(spark, sf_dir, "conversations")))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
