"""The registered queries of this folder: each applies one operator to its whole table and derives the digests."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwatch.llm import (
    byte_bpe, chat, collocations, decontamination, exact_topk, jaccard, multiprobe, oracles, packing, prefix_trie,
    quality, secrets, substrings, toxicity, vectors,
)
from quietwatch.llm.common import table, written


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "window", "sequence_tokens", "step_group",
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_conversations(turns.unionByName(planted)))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "n_links"
    )


#: Labelled ids looked up for a fit, of each class: more than any fit uses, so copies and missing texts leave enough.
DRAWN_PER_CLASS = 24_000


def _labelled(docs: DataFrame, labels: DataFrame, label: str, divisor: int, left_out: int, seed: int) -> DataFrame:
    """Texts of a bounded draw of labelled ids, by a hash of the id: the labels alone decide, no text is shuffled."""
    marks = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(
        (toxicity.remainder("doc_id", divisor) != left_out) & F.col("doc_id").isNotNull()
    )
    order = [F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), "doc_id"]
    drawn = [marks.filter(F.col("label") == v).orderBy(*order).limit(DRAWN_PER_CLASS) for v in (0, 1)]
    # at most 2 * DRAWN_PER_CLASS rows of two numbers
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))
    return written(docs.select("doc_id", "text").join(chosen, "doc_id"), f"labelled-{label}")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(_labelled(docs, table(spark, sf_dir, "labels"), "quality", 5, 0, seed=11), "doc_id", "text", "label")
    return quality.score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (toxicity.remainder("doc_id", 5) == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.col("quality_predicted").alias("predicted"),
    )


def toxic_lexicon(docs: DataFrame, labels: DataFrame) -> toxicity.Lexicon:
    return toxicity.fit(
        _labelled(docs, labels, "toxic", 4, 2, seed=7), "doc_id", "text", "label", toxicity.ToxicityOptions()
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxic_lexicon(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.select("doc_id", "text"), lexicon).select(
        "doc_id",
        (toxicity.remainder("doc_id", 4) == 2).alias("held_out"),
        F.col("toxicity_score").alias("score"),
        F.col("toxicity_predicted").alias("predicted"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, pattern)
    return byte_bpe.decode_documents(encoded, ranks, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = [name for name, _, _ in secrets.BASE_RULES]
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in base]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(F.transform(of_base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
    )


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = exact_topk.exact_top_k(rows, F.col("vec_id") % 50 == 0, 5, scale=256)
    return found.withColumn("score", F.col("score").cast("long"))


def op9_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return multiprobe.search(rows.filter(F.exists("vector", lambda x: x != 0)), F.col("vec_id") % 20 == 0, 20)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents")).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = prefix_trie.turn_sequences(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.shared_openings(sequences, every=100, most=6))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_chat": op2_chat,
    "op3_jaccard": op3_jaccard,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_secrets": op7_secrets,
    "op8_exact_topk": op8_exact_topk,
    "op9_multiprobe": op9_multiprobe,
    "op10_substrings": op10_substrings,
    "op11_collocations": op11_collocations,
    "op12_decontamination": op12_decontamination,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE = oracles.ORACLE
