"""The corpus pipeline: toxicity, near copies, benchmark passages, source mixture, token files.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a table that is written and read back
as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm import contamination, mixing, simhash, tokens, toxicity
from tarnlake.llm.common import drop_stage, stage, table
from tarnlake.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.7 or more go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity of five-word shingles of 0.8 or more) stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark window go."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents to the target weights of their sources, a row a copy, written shard by shard and each shard shuffled."""
    return mixing.shuffled(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, and what a reader finds in them: doc_id, start, n_tokens, ids_crc32."""
    return tokens.huffman_tokens(docs, tokenizer_path("word_bpe_49k.json"), 2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixture", mix),
    ("tokens", write_tokens),
]

#: No SQL: the scores, fingerprints and token ids of these stages can't be expressed in it. tests/llm holds each of them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. A stage's table goes when the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            drop_stage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
