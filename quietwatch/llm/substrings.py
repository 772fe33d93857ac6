"""Substring dedup by super-k-mers: runs of windows that share a minimiser travel together and are sorted in a bucket.

A window is ``window`` consecutive words.  Its minimiser is the smallest hash among its runs of ``gram`` words, the
leftmost of equal ones.  Equal windows have equal minimisers, so a run of neighbouring windows with one minimiser (a
super-k-mer) can only meet its repeats among the super-k-mers of the same minimiser.  Three steps:

1. Every super-k-mer sends its minimiser alone.  Minimisers met once cannot hold a repeated window and end here.
2. The others travel, as the 128-bit fingerprints of their windows, to the bucket of their minimiser.  A minimiser met
   more than ``hot`` times is spread: its windows travel one by one to ``salts`` buckets of their own content.  A
   fingerprint is a pair of polynomials over two 64-bit hashes of each word, so that of every window is the difference
   of two sums and each word is hashed once, however many windows hold it.
3. In a bucket the windows are sorted by their fingerprints; equal neighbours are repeats.
4. Of a spread window each bucket hands over one row, a window that is alone there or a witness of repeats.  Those few
   rows meet by fingerprint, so that no task gets all places of a passage that very many documents share.

Nothing is gathered but the words, minimisers and marks of one document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwatch.llm.common import arrow_schema, batch_of, gram_hashes, map_batches, mixed, working_as, written


@dataclass(frozen=True)
class SubstringOptions:
    window: int = 35
    gram: int = 12
    hot: int = 10_000
    salts: int = 64

    def __post_init__(self):
        if not 0 < self.gram <= self.window:
            raise ValueError("gram must be between 1 and window")


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII blanks, as bytes; none for null."""
    return text.encode("utf-8", "replace").split() if text else []


def hashed(texts: Iterable[str | None]) -> list[np.ndarray]:
    """Two 64-bit hashes of each word of each text."""
    working_as("words")
    words = [words_of(t) for t in texts]
    raw = b"".join(map(xxhash.xxh3_128_digest, chain.from_iterable(words)))
    return np.split(np.frombuffer(raw, ">u8").reshape(-1, 2).astype(np.uint64), np.cumsum([len(w) for w in words])[:-1])


def super_kmers(hashes: np.ndarray, options: SubstringOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each super-k-mer, in order, from one hash of each word."""
    none = np.zeros(0, np.int64)
    if len(hashes) < options.window:
        return none, none, none
    grams = gram_hashes(hashes, options.gram)
    wide = np.lib.stride_tricks.sliding_window_view(grams, options.window - options.gram + 1)
    place = wide.argmin(axis=1) + np.arange(len(wide))
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    count = np.diff(np.r_[first, len(place)])
    return grams[place[first]].view(np.int64), first, count


#: Odd multipliers of the two polynomials of a fingerprint.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
PRINT_BYTES = 16


def window_prints(hashes: np.ndarray, width: int) -> np.ndarray:
    """The fingerprint, two numbers, of each run of ``width`` words; wherever it stands, the same words have the same."""
    prints = np.empty((max(0, len(hashes) - width + 1), 2), np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    for half, k in enumerate(MULTIPLIERS if len(prints) else ()):
        np.cumsum(hashes[:, half] * np.full(len(hashes), k, np.uint64).cumprod(), out=sums[1:])
        back = np.full(len(prints), pow(k, -1, 1 << 64), np.uint64).cumprod()
        prints[:, half] = (sums[width:] - sums[:-width]) * back
    return prints


def _keys(id_col: str, text_col: str) -> list[Column]:
    """A row is known by its id and text; rows equal in both are interchangeable."""
    return [F.xxhash64(F.col(id_col).cast("string")).alias("k1"), F.xxhash64(F.col(text_col)).alias("k2")]


def repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: SubstringOptions = SubstringOptions()
) -> DataFrame:
    """``k1, k2, place``: each window whose words also start anywhere else, same document included."""
    rows = docs.select(*_keys(id_col, text_col), F.col(text_col).alias("text"))

    def send(batch):
        found = [super_kmers(h[:, 0], options)[0] for h in hashed(batch["text"])]
        sizes = [len(x) for x in found]
        return {
            "minimiser": np.concatenate(found),
            "k1": np.repeat(np.array(batch["k1"], np.int64), sizes),
            "k2": np.repeat(np.array(batch["k2"], np.int64), sizes),
        }

    sent = written(map_batches(rows, send, "minimiser long, k1 long, k2 long"), "super-kmers")
    # written, so that the join has a shuffle of its own for each side and Spark can split a minimiser that is very common
    common = written(sent.groupBy("minimiser").agg(F.count("*").alias("n")).filter("n > 1"), "common-minimisers")
    wanted = written(
        sent.join(common, "minimiser")
        .groupBy("k1", "k2")
        .agg(
            F.collect_set("minimiser").alias("minimisers"),
            F.collect_set(F.when(F.col("n") > options.hot, F.col("minimiser"))).alias("hot"),
        ),
        "repeated-minimisers",
    )
    width = options.window

    def pack(batch):
        out = {"bucket": [], "k1": [], "k2": [], "start": [], "packed": []}
        of_text = hashed(batch["text"])
        for k1, k2, hashes, kept, hot in zip(batch["k1"], batch["k2"], of_text, batch["minimisers"], batch["hot"], strict=True):
            minimisers, first, count = super_kmers(hashes[:, 0], options)
            chosen, spread = np.isin(minimisers, np.array(kept, np.int64)), set(hot)
            prints = window_prints(hashes, width)
            raw = memoryview(prints.tobytes())
            for m, a, n in zip(minimisers[chosen].tolist(), first[chosen].tolist(), count[chosen].tolist(), strict=True):
                if m in spread:
                    salts = (np.arange(a, a + n) + (k1 + k2) % options.salts) % options.salts
                    buckets = mixed(prints[a : a + n, 0] + salts.astype(np.uint64)).view(np.int64).tolist()
                    for i, bucket in zip(range(a, a + n), buckets, strict=True):
                        # a spread window has the complement of its place, so that it is known as such
                        _append(out, bucket, k1, k2, ~i, bytes(raw[i * PRINT_BYTES : (i + 1) * PRINT_BYTES]))
                else:
                    _append(out, m, k1, k2, a, bytes(raw[a * PRINT_BYTES : (a + n) * PRINT_BYTES]))
        return out

    packed = map_batches(
        rows.join(wanted, ["k1", "k2"]), pack, "bucket long, k1 long, k2 long, start int, packed binary"
    ).repartition("bucket")

    def unpack(batch):
        sizes = np.fromiter(map(len, batch["packed"]), np.int64, len(batch["packed"])) // PRINT_BYTES
        prints = np.frombuffer(b"".join(batch["packed"]), np.int64).reshape(-1, 2)
        first = np.repeat(np.array(batch["start"], np.int64) - (np.cumsum(sizes) - sizes), sizes)
        return {
            "p1": prints[:, 0],
            "p2": prints[:, 1],
            "k1": np.repeat(np.array(batch["k1"], np.int64), sizes),
            "k2": np.repeat(np.array(batch["k2"], np.int64), sizes),
            "place": (first + np.arange(len(prints))).astype(np.int32),
        }

    rows_of_windows = map_batches(packed, unpack, "p1 long, p2 long, k1 long, k2 long, place int")
    sorted_rows = rows_of_windows.sortWithinPartitions("p1", "p2")
    schema = "k1 long, k2 long, place int, p1 long, p2 long"
    target = arrow_schema(docs.sparkSession, schema)

    def picked(rows: pa.Table, before: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
        """Repeats without their print; of a spread window also what is left to compare, with it, witnesses without a place."""
        k1, k2, place, p1, p2 = (rows.column(c).to_numpy() for c in ("k1", "k2", "place", "p1", "p2"))
        spread = place < 0
        place = np.where(spread, ~place, place)
        repeat = np.flatnonzero(before | after)
        open_ones = np.flatnonzero(spread & ~before)
        both = np.r_[repeat, open_ones]
        left = np.where(after[open_ones], -1, place[open_ones])
        known = np.arange(len(both)) < len(repeat)
        return batch_of({
            "k1": k1[both], "k2": k2[both], "place": np.r_[place[repeat], left],
            "p1": pa.array(p1[both], mask=known), "p2": pa.array(p2[both], mask=known),
        }, target)

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compares each print with its neighbours; the last row of a batch is held back until the next is seen."""
        held, seen = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch])
            p1, p2 = (rows.column(c).to_numpy() for c in ("p1", "p2"))
            same = (p1[1:] == p1[:-1]) & (p2[1:] == p2[:-1])
            before = np.r_[seen, same]
            if len(same):
                yield picked(rows.slice(0, len(same)), before[:-1], same)
            held, seen = rows.slice(len(same)).combine_chunks().to_batches()[0], bool(before[-1])
        if held is not None:
            yield picked(pa.Table.from_batches([held]), np.array([seen]), np.array([False]))

    found = written(sorted_rows.mapInArrow(pick, schema), "repeated-windows")
    # at most one row of each bucket, so at most ``salts`` with one print
    met = F.count("*").over(Window.partitionBy("p1", "p2"))
    late = found.filter("p1 IS NOT NULL").withColumn("met", met).filter("met > 1 AND place >= 0")
    return found.filter("p1 IS NULL").select("k1", "k2", "place").unionByName(late.select("k1", "k2", "place"))


def _append(out: dict, *values) -> None:
    for column, value in zip(out.values(), values, strict=True):
        column.append(value)


def kept_words(words: list[bytes], places: list[int], window: int) -> list[bytes]:
    """The words that no window starting at ``places``, different ones, covers."""
    edge = np.zeros(len(words) + 1, np.int64)
    start = np.array(places, np.int64)
    edge[start] += 1  # no place comes twice
    edge[start + window] -= 1
    bare = np.cumsum(edge[:-1]) == 0
    return [w for w, keep in zip(words, bare.tolist(), strict=True) if keep]


def shortened(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: SubstringOptions = SubstringOptions()
) -> DataFrame:
    """``k1, k2, n_words, n_removed, kept`` of each document that loses words; ``kept`` is joined by single spaces.

    All copies of a repeated window go.  Documents with fewer words than a window, and null or empty texts, lose
    nothing and have no row.  Rows that repeat an id and a text repeat each other's windows.
    """
    found = repeated_windows(docs, id_col, text_col, options)
    places = found.groupBy("k1", "k2").agg(F.collect_set("place").alias("places"))
    rows = docs.select(*_keys(id_col, text_col), F.col(text_col).alias("text"))

    def cut(batch):
        out = {"k1": [], "k2": [], "n_words": [], "n_removed": [], "kept": []}
        for k1, k2, text, places in zip(*(batch[c] for c in ("k1", "k2", "text", "places")), strict=True):
            words = words_of(text)
            kept = kept_words(words, places, options.window)
            _append(out, k1, k2, len(words), len(words) - len(kept), b" ".join(kept).decode())
        return out

    joined = rows.join(places, ["k1", "k2"])
    return map_batches(joined, cut, "k1 long, k2 long, n_words long, n_removed long, kept string").dropDuplicates(["k1", "k2"])


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: SubstringOptions = SubstringOptions()
) -> DataFrame:
    """All rows and columns of ``docs``; texts that lose words become their kept words, others stay as they are."""
    # names that no column of the input can have
    taken = {c.lower() for c in docs.columns}
    k1, k2, kept = (next(n for i in range(len(taken) + 1) if (n := f"_{c}{i}") not in taken) for c in ("ka", "kb", "kept"))
    cut = shortened(docs, id_col, text_col, options).select(
        F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("kept").alias(kept)
    )
    named = [c.alias(n) for c, n in zip(_keys(id_col, text_col), (k1, k2), strict=True)]
    joined = docs.select("*", *named).join(cut, [k1, k2], "left")
    return joined.withColumn(text_col, F.coalesce(F.col(kept), F.col(text_col))).select(*docs.columns)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: SubstringOptions = SubstringOptions()):
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256`` of what ``dedup_substrings`` keeps."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *_keys(id_col, text_col), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def whole(batch):
        import hashlib

        words = [words_of(t) for t in batch["text"]]
        return {
            "doc_id": batch["doc_id"], "k1": batch["k1"], "k2": batch["k2"], "all_words": [len(w) for w in words],
            "whole": [hashlib.sha256(b" ".join(w)).digest() for w in words],
        }

    every = map_batches(rows, whole, f"doc_id {id_type}, k1 long, k2 long, all_words long, whole binary")
    cut = shortened(docs, id_col, text_col, options).select("k1", "k2", "n_removed", F.sha2("kept", 256).alias("digest"))
    return every.join(cut, ["k1", "k2"], "left").select(
        "doc_id",
        F.col("all_words").alias("n_words"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("digest", F.lower(F.hex("whole"))).alias("kept_sha256"),
    )
