"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all but the last return the columns of
documents. A stage handles nulls, empty and repeated rows as the operator that it calls says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import bpe, contamination, linededup, minhash, quality
from marketloom.llm.common import store, table, whole
from marketloom.llm.queries import token_digests, vocabulary_json

#: No SQL for the fit of the quality model and the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None

#: Words of a shingle in the near-dedup stage; documents with a similarity of 0.8 or more are one.
WORDS = 5


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` less the rows named by `gone` (doc_id, text_hash)."""
    gone = gone.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"))
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64(whole("text")) == F.col("__h"))
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, whole and with the columns of `docs`."""
    return quality.judge(docs, out="__quality").where("__quality.kept").select(*_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that the operator drops; n_chars is that of the new text."""
    out = linededup.dedup_lines(docs).select(*_columns(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id. Copies of a row with that id stay all."""
    return _without(docs, minhash.near_duplicates(docs, words=WORDS).where("NOT kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of `benchmark` by the rule of `contaminated`."""
    found = contamination.matches(contamination.build_index(docs), table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where(contamination.contaminated()))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and digests of ids and decoded text per document kept."""
    return token_digests(bpe.encode_decode(docs, vocabulary_json()))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on `documents`; every stage but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"corpus-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
