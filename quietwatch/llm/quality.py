"""Quality classifier: logistic regression on hashed word n-grams, learned by follow-the-regularised-leader."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quietwatch.llm.common import KEPT, mixed

#: Entries of the memo of tokens; a full memo starts anew.
MEMO_WORDS = 500_000

_TOKEN = re.compile(r"\w+|[^\w\s]")
_NUMBER, _UPPER, _TITLE, _LOWER, _SIGN, _LONG = range(1, 7)


class _Tokens(dict):
    """Token -> 64-bit hash whose low three bits are replaced by the token's shape."""

    def __missing__(self, token: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        if not (token[0].isalnum() or token[0] == "_"):
            shape = _SIGN
        elif token[0].isdigit():
            shape = _NUMBER
        elif len(token) > 25:
            shape = _LONG
        elif token.isupper() and len(token) > 1:
            shape = _UPPER
        else:
            shape = _TITLE if token[0].isupper() else _LOWER
        value = self[token] = (xxhash.xxh3_64_intdigest(token) & ~7) | shape
        return value


_TOKENS = _Tokens()
KEPT["quality"] = _TOKENS.clear


@dataclass(frozen=True)
class QualityOptions:
    """Fitting uses at most ``sample_rows`` labelled documents, chosen by a hash of the id, in ``shards`` tasks."""

    bits: int = 18
    sample_rows: int = 12_000
    shards: int = 4
    epochs: int = 6
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.0
    threshold: float = 0.3


def features(text: str | None, bits: int) -> np.ndarray:
    """Buckets of the word unigrams and bigrams, of runs of one to three token shapes, and of repeated words.

    A null, empty or blank text has no features.
    """
    tokens = _TOKEN.findall(text or "")
    if not tokens:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_TOKENS.__getitem__, tokens), np.uint64, len(tokens))
    shape = h & np.uint64(7)
    k = np.uint64(0x9E3779B97F4A7C15)
    parts = [h, shape + np.uint64(8)]
    if len(h) > 1:
        pair = shape[:-1] * np.uint64(8) + shape[1:]
        parts += [h[:-1] * k + h[1:], pair + np.uint64(64), np.where(h[:-1] == h[1:], np.uint64(1), np.uint64(2))]
    if len(h) > 2:
        parts.append(pair[:-1] * np.uint64(8) + shape[2:] + np.uint64(1024))
    return (mixed(np.concatenate(parts)) >> np.uint64(64 - bits)).astype(np.int64)


def vector(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector of the text: buckets and their shares, of unit length."""
    index, counts = np.unique(features(text, bits), return_counts=True)
    values = np.sqrt(counts)
    norm = np.sqrt((values**2).sum()) or 1.0
    return index, values / norm


@dataclass(frozen=True)
class QualityModel:
    """Dense weights of bounded size (2 ** bits) and the bias."""

    weights: np.ndarray
    bias: float
    bits: int

    def score(self, text: str | None) -> float:
        index, values = vector(text, self.bits)
        z = self.bias + float(self.weights[index] @ values)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def follow_leader(rows: list[tuple[str | None, int]], options: QualityOptions) -> tuple[np.ndarray, float]:
    """FTRL-proximal over the rows in their order, ``epochs`` times; the bias is not regularised."""
    size = (1 << options.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    sparse = []
    for text, label in rows:
        index, values = vector(text, options.bits)
        sparse.append((np.append(index, size - 1), np.append(values, 1.0), label))

    def weights(index):
        zi, ni = z[index], n[index]
        l1 = np.where(index == size - 1, 0.0, options.l1)
        w = -(zi - np.sign(zi) * l1) / ((options.beta + np.sqrt(ni)) / options.alpha + options.l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(options.epochs):
        for index, values, label in sparse:
            w = weights(index)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ values, -30, 30)))
            g = (p - label) * values
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / options.alpha
            z[index] += g - sigma * w
            n[index] += g * g
    every = weights(np.arange(size))
    return every[:-1], float(every[-1])


def fit(
    labelled: DataFrame, id_col: str, text_col: str, label_col: str, options: QualityOptions = QualityOptions()
) -> QualityModel:
    """Learn from a bounded sample of labelled rows: each shard follows its leader, Spark averages the weights.

    Rows with a null label are not used; a null text counts as empty.  Without rows the model scores 0.5.
    """
    rows = labelled.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y")
    ).filter("y IN (0, 1)")
    order = (F.xxhash64(F.lit(11), "id"), F.xxhash64("text"))
    keys = rows.select(order[0].alias("a"), order[1].alias("b")).orderBy("a", "b").limit(options.sample_rows)
    # at most sample_rows pairs of numbers
    sample = rows.withColumns({"a": order[0], "b": order[1]}).join(F.broadcast(keys.distinct()), ["a", "b"], "left_semi")
    shard = F.pmod("a", F.lit(options.shards)).alias("shard")

    def learn(group):
        import pyarrow as pa

        ordered = group.sort_by([("a", "ascending"), ("b", "ascending")]).to_pydict()
        w, bias = follow_leader(list(zip(ordered["text"], ordered["y"], strict=True)), options)
        index = np.flatnonzero(w)
        return pa.table(
            {
                "index": np.append(index, -1),
                "weight": np.append(w[index], bias),
                "rows": np.full(len(index) + 1, float(group.num_rows)),
            }
        )

    learned = sample.select("a", "b", "text", "y", shard).groupBy("shard").applyInArrow(
        learn, "index long, weight double, rows double"
    )
    # at most shards * (2 ** bits + 1) rows, of which 2 ** bits + 1 reach the driver
    table = learned.groupBy("index").agg(F.sum(F.col("weight") * F.col("rows")).alias("w"), F.sum("rows").alias("rows"))
    got = table.collect()
    total = max((r["rows"] for r in got if r["index"] == -1), default=0.0)
    weights, bias = np.zeros(1 << options.bits), 0.0
    for r in got:
        if r["index"] == -1:
            bias = r["w"] / total
        else:
            weights[r["index"]] = r["w"] / total
    return QualityModel(weights.astype(np.float32), bias, options.bits)


def score_quality(
    docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.3, out: str = "quality"
) -> DataFrame:
    """All rows with ``<out>_score`` and ``<out>_predicted`` appended, from the whole text.

    A null or empty text scores by the bias alone; equal rows each have their score; an input column with one of the
    two names is replaced.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        scorer = shared.value
        return pd.Series([scorer.score(t) for t in texts], dtype="float64")

    scored = docs.withColumn(f"{out}_score", score(F.col(text_col)))
    return scored.withColumn(f"{out}_predicted", (F.col(f"{out}_score") >= threshold).cast("int"))
