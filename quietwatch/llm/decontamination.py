"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items scans each text once.

Texts and items are normalised to words: ASCII letters in lower case, ASCII digits and everything beyond ASCII; all
else parts words.  A word of the items becomes one symbol, any other word the symbol 0, so the automaton runs over
words: it cannot match inside a word, its nodes count words and a match gives the place of its words at once, which
byte positions map back to code points of the original text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwatch.llm.common import arrow_schema, batch_of, bounded_batches, written

#: Bytes of words to themselves, letters in lower case; all others to a blank.
NORMAL = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256)
)
#: Words of a long item are dealt out in pieces of this many windows.
PIECE_WINDOWS = 1000


@dataclass(frozen=True)
class LeakOptions:
    """``window`` words make a window; an automaton holds the windows of about ``block_bytes`` of item words.

    A benchmark of more bytes is scanned for in blocks, one pass over the texts for each, so neither the driver nor a
    task holds more than a block.
    """

    window: int = 10
    block_bytes: int = 1_000_000

    def __post_init__(self):
        if self.window < 1 or self.block_bytes < 1:
            raise ValueError("window and block_bytes must be positive")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


def item_pieces(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``item, words``: each item's words, a long one in pieces that together hold all its windows."""
    target = arrow_schema(items.sparkSession, "item string, words binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"item": [], "words": []}
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = words_of(text)
                for at in range(0, max(1, len(words) - window + 1) if words else 0, PIECE_WINDOWS):
                    out["item"].append(item)
                    out["words"].append(b" ".join(words[at : at + PIECE_WINDOWS + window - 1]))
            yield batch_of(out, target)

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "item string, words binary").distinct()


def _blocks(pieces: DataFrame, block_bytes: int) -> list[DataFrame]:
    """Parts of the pieces, each of at most about ``block_bytes``; more parts until the largest fits."""
    size = F.sum(F.octet_length("words") + F.lit(1)).alias("size")
    total = pieces.agg(size).first()["size"] or 0
    number = max(1, -(-total // block_bytes))
    while True:
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(number)))
        most = dealt.groupBy("block").agg(size).agg(F.max("size").alias("most")).first()["most"] or 0
        if most <= 2 * block_bytes or number > 4 * max(1, pieces.count()):  # one piece alone may be longer
            return [dealt.filter(F.col("block") == b).select("item", "words") for b in range(number)]
        number *= 2


class Leaks:
    """The automaton of one block: windows as strings of word symbols, each with its length and its pieces."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], window: int):
        self.symbols: dict[bytes, str] = {}
        by_words: dict[bytes, set[str]] = {}
        for item, words in pieces:
            names = by_words.setdefault(words, set())
            if item is not None:
                names.add(item)
        self.items = [sorted(names) for names in by_words.values()]
        windows: dict[str, list[int]] = {}
        for k, text in enumerate(by_words):
            coded = "".join(self._symbol(w) for w in text.split())
            for at in range(max(1, len(coded) - window + 1)):
                windows.setdefault(coded[at : at + window], []).append(k)
        self.automaton = ahocorasick.Automaton()
        for coded, ks in windows.items():
            self.automaton.add_word(coded, (len(coded), ks))
        if windows:
            self.automaton.make_automaton()
        self.any = bool(windows)

    def _symbol(self, word: bytes) -> str:
        found = self.symbols.get(word)
        if found is None:
            code = len(self.symbols) + 1
            found = self.symbols[word] = chr(code if code < 0xD800 else code + 0x800)  # surrogates stay out
        return found

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """First word and end of each occurrence, and the items with windows that occur."""
        if not self.any or not words:
            return [], set()
        get = self.symbols.get
        coded = "".join([get(w, "\0") for w in words])
        found, pieces = [], set()
        for end, (length, ks) in self.automaton.iter(coded):
            found.append((end + 1 - length, end + 1))
            pieces.update(ks)
        return found, {name for k in pieces for name in self.items[k]}


#: The automaton in use by this worker.
_BUILT: dict[str, Leaks] = {}


def _runs(found: np.ndarray, n_words: int) -> np.ndarray:
    """Occurrences, as pairs, merged to runs of covered words."""
    if not len(found):
        return np.zeros((0, 2), np.int64)
    step = np.bincount(found[:, 0], minlength=n_words + 1) - np.bincount(found[:, 1], minlength=n_words + 1)
    covered = np.concatenate([[False], np.cumsum(step)[:n_words] > 0, [False]])
    return np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2)


def _places(text: bytes, runs: np.ndarray) -> list[dict]:
    """Runs of words as code points of the original text, ends exclusive."""
    letters = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], letters, [False]])))
    starts, ends = edges[::2], edges[1::2]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b - 1]])} for a, b in runs.tolist()]


def _scan(rows: DataFrame, pieces: DataFrame, window: int, id_type: str, last: bool) -> DataFrame:
    """One pass with one block: ``runs`` and ``items`` gain what it finds; the last pass drops the text."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast([(r["item"], bytes(r["words"])) for r in pieces.collect()])  # a block at most
    token = uuid.uuid4().hex
    schema = f"id {id_type}, text binary, runs binary, items array<string>, n_words long"
    if last:
        schema += ", n_hit long, hits array<struct<start: long, end: long>>"
    target = arrow_schema(spark, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _BUILT:
            _BUILT.clear()
            _BUILT[token] = Leaks(held.value, window)
        leaks = _BUILT[token]
        for batch in batches:
            out: dict = {f.name: [] for f in target}
            out["id"] = batch["id"]
            texts, known, named = (batch[c].to_pylist() for c in ("text", "runs", "items"))
            for text, before, items in zip(texts, known, named, strict=True):
                words = words_of(text)
                found, more = leaks.find(words)
                earlier = np.frombuffer(before, np.int64).reshape(-1, 2)
                if found or len(earlier):
                    runs = _runs(np.concatenate([earlier, np.array(found, np.int64).reshape(-1, 2)]), len(words))
                else:
                    runs = earlier
                out["text"].append(None if last else text)
                out["runs"].append(runs.astype(np.int64).tobytes())
                out["items"].append(sorted(more.union(items)) if more else items)
                out["n_words"].append(len(words))
                if last:
                    out["n_hit"].append(int((runs[:, 1] - runs[:, 0]).sum()))
                    out["hits"].append(_places(text, runs) if len(runs) else [])
            yield batch_of(out, target)

    return rows.mapInArrow(run, schema)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    options: LeakOptions = LeakOptions(),
) -> DataFrame:
    """Per row of ``docs``: its id, ``n_words``, ``n_hit`` (words inside an occurring window), ``hits`` (runs of those
    words in code points, ends exclusive) and ``items`` (sorted ids, as strings, of the items with occurring windows).

    A window is ``options.window`` consecutive words of an item; an item of fewer words, but not none, is one window.
    Null texts count as empty ones.  Equal rows each have their row, a null document id stays null.  An item without
    an id marks words but is not named; rows of one item id are one item with the windows of all its texts.  No items:
    no hits.  A text is handled whole in its task, in linear time.  Other columns of either table are not looked at.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    pieces = written(item_pieces(items, item_col, item_text_col, options.window), "item-pieces")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).cast("binary").alias("text"),
        F.lit(b"").alias("runs"),
        F.array().cast("array<string>").alias("items"),
    )
    blocks = _blocks(pieces, options.block_bytes)
    for block in blocks[:-1]:
        rows = written(_scan(rows, block, options.window, id_type, last=False), "leaks").drop("n_words")
    found = _scan(rows, blocks[-1], options.window, id_type, last=True)
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", "hits", "items")
