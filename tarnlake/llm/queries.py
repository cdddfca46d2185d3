"""The thin queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import chat, contamination, linechunks, mixing, neighbours, secrets, simhash, substrings, tokens, toxicity
from tarnlake.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.huffman_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.plan(table(spark, sf_dir, "documents"))).drop("shards")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linechunks.report(linechunks.dedup_lines(table(spark, sf_dir, "documents")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    path = tokenizer_path("byte_bpe_50k.json")
    return chat.read_back(chat.format_chat(rows, path), path)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.report(contamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(simhash.groups(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_huffman_tokens, op2_nearest, op3_mix_sources, op4_toxicity, op5_line_chunks, op6_suffix_dedup, op7_chat, op8_decontaminate, op9_secrets, op10_simhash)}
ORACLE_SQL: dict[str, str] = {"op3_mix_sources": mixing.ORACLE, "op5_line_chunks": linechunks.ORACLE, "op7_chat": chat.ORACLE, "op8_decontaminate": contamination.ORACLE, "op9_secrets": secrets.ORACLE}
