"""Toxicity by a weighted lexicon, matched with one Aho-Corasick automaton over folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quietwatch.llm.common import map_batches, working_as

# Look-alike letters of other scripts, and digits and signs used as letters.
HOMOGLYPHS = dict(
    zip(
        "авекмнорстухіјѕԁԛԝһ" "αβεικνορτυχ" "ıøłđ",
        "abekmhopctyxijsdqwh" "abeiknoptux" "iold",
        strict=True,
    )
)
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

# The seed words and the phrases in which they are harmless.
SEED_WORDS = (
    "idiot", "moron", "scum", "worthless", "pathetic", "disgusting", "stupid", "loser", "trash", "clown",
    "imbecile", "dumbass", "retard", "bastard", "asshole", "bitch", "cretin", "vermin", "degenerate",
)
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "clown fish", "class clown", "circus clown",
    "pond scum", "idiot proof", "degenerate matter", "sore loser", "degenerate case",
)


def fold_table() -> dict[int, str | None]:
    """Code points to plain letters: accents go, combining marks vanish, look-alikes and digits become letters."""
    table: dict[int, str | None] = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        plain = unicodedata.normalize("NFKD", chr(code)).lower()
        letters = "".join(c for c in plain if not unicodedata.combining(c))
        if letters and letters != chr(code):
            table[code] = letters
    table |= {code: None for code in (*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0xFEFF)}
    table |= {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()}
    return table


_FOLD = fold_table()
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


@dataclass(frozen=True)
class ToxicityOptions:
    """Fitting uses at most ``sample_per_class`` labelled documents of each class, chosen by a hash of the id."""

    sample_per_class: int = 3000
    stem_lengths: tuple[int, ...] = (4, 5, 6)
    min_share: float = 0.02
    min_count: float = 4.0
    min_log_odds: float = 2.5
    max_entries: int = 1000
    seed_weight: float = 3.0
    threshold: float = 0.3


@dataclass
class Lexicon:
    """Whole words and word beginnings (``stem*``) with weights, exception phrases, and the calibration."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 4.0
    intercept: float = -2.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            entries: dict[str, list] = {}
            for term, weight in self.weights.items():
                stem = term.endswith("*")
                entries.setdefault(term.rstrip("*"), []).append((len(term.rstrip("*")), stem, weight))
            for phrase in self.exceptions:
                entries.setdefault(fold(phrase), []).append((len(fold(phrase)), False, None))
            self._automaton = ahocorasick.Automaton()
            for key, values in entries.items():
                if key:
                    self._automaton.add_word(key, tuple(values))
            self._automaton.make_automaton()
        return self._automaton

    def evidence(self, text: str) -> float:
        """Weight of the toxic words outside exception phrases, damped by the length of the text."""
        folded = fold(text)
        hits: dict[int, tuple[int, float]] = {}
        excused: list[tuple[int, int]] = []
        if self._automaton is None and not (self.weights or self.exceptions):
            return 0.0
        for last, entries in self.automaton().iter(folded):
            for length, stem, weight in entries:
                start, end = last - length + 1, last + 1
                if start and folded[start - 1].isalnum():
                    continue
                if not stem and end < len(folded) and folded[end].isalnum():
                    continue
                if weight is None:
                    excused.append((start, end))
                elif start not in hits or hits[start][1] < weight:
                    hits[start] = (end, weight)
        total, reach, following = 0.0, -1, iter(sorted(excused))
        phrase = next(following, None)
        for start in sorted(hits):  # one merge of words and phrases, both by their start
            while phrase and phrase[0] <= start:
                reach, phrase = max(reach, phrase[1]), next(following, None)
            if start >= reach:
                total += hits[start][1]
        return total / (1.0 + 0.1 * math.log1p(len(folded) / 1000.0))

    def score(self, text: str | None) -> float:
        x = math.log1p(self.evidence(text or ""))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * x + self.intercept))))


def terms(text: str, lengths: tuple[int, ...]) -> set[str]:
    found = set()
    for word in set(_WORD.findall(fold(text))):
        if len(word) <= 40 and not word.isdigit():
            found.add(word)
            found.update(word[:n] + "*" for n in lengths if len(word) > n)
    return found


def fit(labelled: DataFrame, id_col: str, text_col: str, label_col: str, options: ToxicityOptions) -> Lexicon:
    """Learn entries and calibration from a bounded sample of labelled rows.

    A term counts if it stands in enough toxic documents of the sample, in different texts, and is rare in the
    clean ones.  Rows with a null label or text are not used; without labelled rows the seed words remain.
    """
    rows = labelled.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")
    ).filter("label IN (0, 1) AND text IS NOT NULL")
    keys = rows.select("id", "label", F.xxhash64("text").alias("h")).dropDuplicates(["h", "label"])
    drawn = [
        keys.filter(F.col("label") == v).orderBy(F.xxhash64(F.lit(7), "h"), "h").limit(options.sample_per_class)
        for v in (0, 1)
    ]
    chosen = drawn[0].unionByName(drawn[1]).select("id", "h")
    # at most 2 * sample_per_class rows of two numbers
    sample = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "h"], "left_semi")
    sample = sample.dropDuplicates(["h"]).select("text", "label")
    lengths = options.stem_lengths

    def count(batch):
        seen = {0: Counter(), 1: Counter()}
        for text, label in zip(batch["text"], batch["label"], strict=True):
            seen[label].update(terms(text, lengths))
        every = list(seen[0] | seen[1])
        return {"term": every, "toxic": [seen[1][t] for t in every], "clean": [seen[0][t] for t in every]}

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    weights = dict.fromkeys(SEED_WORDS, options.seed_weight)
    if n_toxic and n_clean:
        log_odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
        learned = (
            map_batches(sample, count, "term string, toxic long, clean long")
            .groupBy("term")
            .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .filter(F.col("toxic") >= max(options.min_count, options.min_share * n_toxic))
            .withColumn("weight", log_odds)
            .filter(F.col("weight") >= options.min_log_odds)
            .orderBy(F.desc("weight"), "term")
            .limit(options.max_entries)
            .collect()
        )
        stems = {r["term"] for r in learned if r["term"].endswith("*")}
        for r in learned:
            bare = r["term"].rstrip("*")
            covered = any(bare[:n] + "*" in stems for n in lengths if n < len(bare) or n == len(bare) and bare == r["term"])
            if not covered:
                weights[r["term"]] = round(r["weight"], 6)
    lexicon = Lexicon(weights)
    pairs = map_batches(
        sample,
        lambda b: {"x": [math.log1p(lexicon.evidence(t)) for t in b["text"]], "y": b["label"]},
        "x double, y int",
    ).collect()
    if n_toxic and n_clean:
        lexicon.slope, lexicon.intercept = _calibrate(np.array([(r["x"], r["y"]) for r in pairs]))
    return lexicon


def _calibrate(pairs: np.ndarray, steps: int = 60, ridge: float = 1e-5) -> tuple[float, float]:
    """Logistic regression on one number, by damped Newton steps; the slope never turns negative."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    x, y = np.c_[pairs[order, 0], np.ones(len(pairs))], pairs[order, 1]
    w = np.zeros(2)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w * len(y)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(2)
        w = w - np.linalg.solve(hessian, gradient)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (4.0, -2.0)


def score_toxicity(
    docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.3, out: str = "toxicity"
) -> DataFrame:
    """All rows with ``<out>_score`` and ``<out>_predicted`` appended.

    The whole text is scanned, in time that grows with its length.  A null or empty text scores like a text without
    toxic words; equal rows each have their score; an input column with one of the two names is replaced.
    """
    score = _score_udf(lexicon)(F.col(text_col))
    scored = docs.withColumn(f"{out}_score", score)
    return scored.withColumn(f"{out}_predicted", (F.col(f"{out}_score") >= threshold).cast("int"))


def _score_udf(lexicon: Lexicon):

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        working_as("toxicity")
        return pd.Series([lexicon.score(t) for t in texts], dtype="float64")

    return score


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor
