"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and keeps the columns of ``docs``; the last one returns packed pieces.  An empty
table passes through every stage; null texts count as empty ones and stay null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwatch.llm import jaccard, packing, secrets, substrings, toxicity
from quietwatch.llm.common import bounded_batches, table, written
from quietwatch.llm.queries import toxic_lexicon


def _unused(docs: DataFrame, name: str) -> str:
    while any(c.lower().startswith(name) for c in docs.columns):
        name = f"_{name}"
    return name


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches the threshold go; all others stay as they are."""
    bounded_batches(spark)
    lexicon = toxic_lexicon(docs, table(spark, sf_dir, "labels"))
    out = _unused(docs, "toxicity")
    scored = toxicity.score_toxicity(docs, lexicon, "text", toxicity.ToxicityOptions().threshold, out)
    return scored.filter(F.col(f"{out}_predicted") == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    bounded_batches(spark)
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows leave the texts; a document that loses all of them stays with an empty text."""
    bounded_batches(spark)
    return _measured(substrings.dedup_substrings(docs))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret in a text becomes a mark; all documents stay."""
    bounded_batches(spark)
    return _measured(docs.withColumn("text", secrets.redacted("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    bounded_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("secrets", hide_secrets),
    ("packing", pack),
]

# The scores, the automata and the tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
