"""Phrase collocation mining by Rabin-Karp fingerprints.

A task joins texts to buffers of bytes.  Prefix polynomials over the bytes give a fingerprint to each word, prefix
polynomials over the words one to each run of words, all in numpy.  Three scans:

1. Fingerprints of single words and pairs are counted per buffer, packed by their leading bits and summed in the bucket
   of those bits.  Those counted often enough go into a filter of bounded size.
2. Runs of three and four words are counted likewise, but only where all their pairs pass the filter.
3. Each occurrence that passes both filters has a pointer into its buffer.  All occurrences of a fingerprint are
   compared with the text at its first pointer; one that differs stands for itself.  Only these texts leave the task,
   and are counted as texts.

So fingerprints and filters only say what need not be looked at: equal fingerprints of different phrases, or a full
filter, cost time and never change a count.  A phrase cannot be more frequent than its parts, hence the order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwatch.llm.common import arrow_schema, batch_of, bounded_batches, mixed, written

#: What ends a piece becomes a byte that no UTF-8 text holds, a tab becomes a blank.
END = 0xFF
CLEAN = bytes(
    END if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)
)
_GAP = re.compile(rb"[ \xff]")
_WORD = re.compile(rb"[^ \xff]+")

#: Multiplier of the polynomials and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@dataclass(frozen=True)
class MiningOptions:
    """Phrases of 2 to ``longest`` words met ``least`` times or more, the ``top`` best of each language.

    ``buffer_bytes`` of text are counted at once; ``bucket_rows`` fingerprints is the aim for a bucket;
    ``filter_bytes`` bounds each of the two filters that every task holds.
    """

    longest: int = 4
    least: int = 30
    covered: int = 80
    scale: int = 2_000_000
    top: int = 2000
    buffer_bytes: int = 3_000_000
    bucket_rows: int = 2_000_000
    filter_bytes: int = 1 << 25

    def __post_init__(self):
        if self.longest < 2 or self.least < 1 or self.top < 1 or self.filter_bytes < 8:
            raise ValueError("longest must be 2 or more, least and top positive, filter_bytes at least 8")


@lru_cache(1)
def _bytes_values() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)


#: Powers in use by this worker, as many as its longest buffer needed.
_POWERS: dict[int, np.ndarray] = {}


def _powers(of: int, size: int) -> np.ndarray:
    if len(_POWERS.get(of, ())) < size:
        out = np.full(-(-size // (1 << 18)) << 18, of, np.uint64)
        out[0] = 1
        _POWERS[of] = np.cumprod(out, dtype=np.uint64, out=out)
    return _POWERS[of]


class Buffer:
    """Words of joined texts, as places in their bytes, and fingerprints of runs of them."""

    def __init__(self, parts: list[tuple[bytes, int, str]]):
        self.data = b"\xff".join(p for p, _, _ in parts)
        raw = np.frombuffer(self.data, np.uint8)
        inside = np.concatenate([[False], (raw != 32) & (raw != END), [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        first = np.cumsum([0] + [len(p) + 1 for p, _, _ in parts[:-1]])
        self.langs = [lang for _, _, lang in parts]
        self.part = np.searchsorted(first, self.starts, "right") - 1
        self.own = self.starts < (first + np.array([own for _, own, _ in parts]))[self.part]
        stops = np.cumsum(raw == END, dtype=np.int32)
        #: whether a word and the next stand in one piece
        self.joined = np.zeros(len(self.starts), bool)
        if len(self.starts) > 1:
            self.joined[:-1] = stops[self.ends[:-1] - 1] == stops[self.starts[1:] - 1]
        up, down = _powers(BASE, len(raw) + 1), _powers(INVERSE, len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.multiply(_bytes_values()[raw], down[: len(raw)], out=sums[1:])
        np.cumsum(sums, out=sums)
        words = (sums[self.ends] - sums[self.starts]) * up[self.starts]
        self.words = mixed(words + (self.ends - self.starts).astype(np.uint64) * np.uint64(INVERSE))
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(self.words * down[: len(words)], out=self.sums[1:])
        self.up = up
        seeds = {lang: xxhash.xxh3_64_intdigest(lang) for lang in set(self.langs)}
        self.seeds = np.array([seeds[lang] for lang in self.langs], np.uint64)

    def places(self, n: int) -> np.ndarray:
        """Where runs of ``n`` words within a piece begin, those read ahead of another part included."""
        ok = np.ones(max(0, len(self.starts) - n + 1), bool)
        for i in range(n - 1):
            ok &= self.joined[i : i + len(ok)]
        return np.flatnonzero(ok)

    def prints(self, places: np.ndarray, n: int) -> np.ndarray:
        runs = (self.sums[places + n] - self.sums[places]) * self.up[places]
        return mixed(runs + self.seeds[self.part[places]] + np.uint64(n * BASE & (1 << 64) - 1))

    def candidates(self, n: int, pairs: Filter | None) -> np.ndarray:
        """Own places of runs of ``n`` words of which all pairs pass the filter."""
        places = self.places(n)
        if n > 2:
            twos = self.places(2)
            good = np.zeros(len(self.starts), bool)
            good[twos[pairs.holds(self.prints(twos, 2))]] = True
            for i in range(n - 1):
                places = places[good[places + i]]
        return places[self.own[places]]

    def word_ids(self) -> np.ndarray:
        """Equal numbers for equal words alone: one that differs from the first word of its hash has its own number."""
        _, first, back = np.unique(self.words, return_index=True, return_inverse=True)
        raw = np.frombuffer(self.data, np.uint8)
        ids = first[back]
        out = ids.copy()
        size = self.ends - self.starts
        odd = size != size[ids]
        for at in range(0, len(ids), 100_000):
            some = np.arange(at, min(at + 100_000, len(ids)))
            some = some[(ids[some] != some) & ~odd[some]]
            if len(some):
                begin = np.cumsum(size[some]) - size[some]
                step = np.arange(size[some].sum()) - np.repeat(begin, size[some])
                differs = raw[np.repeat(self.starts[some], size[some]) + step] != (
                    raw[np.repeat(self.starts[ids[some]], size[some]) + step]
                )
                odd[some[np.add.reduceat(differs, begin) > 0]] = True
        out[odd] = np.flatnonzero(odd) + len(ids)
        return out

    def text(self, place: int, n: int) -> bytes:
        found = self.data[self.starts[place] : self.ends[place + n - 1]]
        return found if found.count(b" ") == n - 1 else b" ".join(found.split())


def parts_of(text: bytes | None, lang: str, limit: int, further: int) -> Iterator[tuple[bytes, int, str]]:
    """A text in parts of about ``limit`` bytes cut at blanks, each with the ``further`` words behind its own and with
    the place where its own words end."""
    clean = (text or b"").translate(CLEAN)
    at = 0
    while len(clean) - at > limit and (gap := _GAP.search(clean, at + limit)):
        cut = end = gap.start()
        for _, ahead in zip(range(further), _WORD.finditer(clean, cut)):
            end = ahead.end()
        yield clean[at:end], cut - at, lang
        at = cut
    yield clean[at:], len(clean) - at, lang


def _buffers(batches: Iterable[pa.RecordBatch], options: MiningOptions) -> Iterator[Buffer]:
    limit = options.buffer_bytes
    parts, held = [], 0
    for batch in batches:
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
            for part in parts_of(text, lang, limit, options.longest - 1):
                if held and held + len(part[0]) > limit:
                    yield Buffer(parts)
                    parts, held = [], 0
                parts.append(part)
                held += len(part[0]) + 1
    if parts:
        yield Buffer(parts)


class Filter:
    """A set of fingerprints in words of 64 bits: four bits of one word for each, so there are no false negatives."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.shift = np.uint64(64 - (len(words).bit_length() - 1))

    @staticmethod
    def bits(prints: np.ndarray) -> np.ndarray:
        one, out = np.uint64(1), np.zeros(len(prints), np.uint64)
        for k in (0, 6, 12, 18):
            out |= one << ((prints >> np.uint64(k)) & np.uint64(63))
        return out

    def holds(self, prints: np.ndarray) -> np.ndarray:
        bits = self.bits(prints)
        return (self.words[_leading(prints, self.shift)] & bits) == bits


def _leading(prints: np.ndarray, shift: int) -> np.ndarray:
    return (prints >> np.uint64(shift)).astype(np.int64) if int(shift) < 64 else np.zeros(len(prints), np.int64)


def _counted(texts: DataFrame, sizes: tuple[int, ...], pairs: Broadcast | None, buckets: int, options) -> DataFrame:
    """``bucket, prints``: the fingerprints met often enough, packed and in order, one row for a bucket."""
    shift = 64 - (buckets.bit_length() - 1)
    schema = "bucket long, prints binary, counts binary"
    target = arrow_schema(texts.sparkSession, schema)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Filter(np.frombuffer(pairs.value, np.uint64)) if pairs else None
        for buffer in _buffers(batches, options):
            found = [buffer.prints(buffer.candidates(n, held), n) for n in sizes]
            prints, counts = np.unique(np.concatenate(found), return_counts=True)
            bucket, first = np.unique(_leading(prints, shift), return_index=True)
            edges = [*first.tolist(), len(prints)]
            cuts = list(zip(edges, edges[1:]))
            counts = counts.astype(np.uint32)
            yield batch_of(
                {
                    "bucket": bucket,
                    "prints": [prints[a:b].tobytes() for a, b in cuts],
                    "counts": [counts[a:b].tobytes() for a, b in cuts],
                },
                target,
            )

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b.as_py(), p.as_py(), c.as_py()) for batch in batches for b, p, c in zip(*batch.columns, strict=True))
        for bucket, group in groupby(rows, key=lambda r: r[0]):
            own = list(group)
            prints = np.frombuffer(b"".join(p for _, p, _ in own), np.uint64)
            counts = np.frombuffer(b"".join(c for _, _, c in own), np.uint32)
            order = np.argsort(prints)
            prints = prints[order]
            first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
            often = np.add.reduceat(counts[order].astype(np.int64), first) >= options.least
            if often.any():
                yield batch_of({"bucket": [bucket], "prints": [prints[first[often]].tobytes()]}, kept)

    kept = arrow_schema(texts.sparkSession, "bucket long, prints binary")
    dealt = texts.mapInArrow(count, schema).repartition("bucket").sortWithinPartitions("bucket")
    return written(dealt.mapInArrow(add, "bucket long, prints binary"), "frequent-prints")


def _filter(frequent: DataFrame, buckets: int, options: MiningOptions) -> Broadcast:
    """The filter of all rows: each bucket makes its own stretch, of which all together have ``filter_bytes`` at most."""
    number = frequent.agg(F.sum(F.octet_length("prints") / 8).cast("long").alias("n")).first()["n"] or 0
    size = min(max(1 << (number // 4).bit_length(), buckets), 1 << (options.filter_bytes // 8).bit_length() - 1)
    stretch = max(1, size // buckets)
    shift = 64 - (size.bit_length() - 1)
    target = arrow_schema(frequent.sparkSession, "bucket long, bits binary")

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, packed in zip(batch["bucket"].to_pylist(), batch["prints"].to_pylist(), strict=True):
                prints = np.frombuffer(packed, np.uint64)
                bits = np.zeros(stretch, np.uint64)
                np.bitwise_or.at(bits, _leading(prints, shift) - bucket * size // buckets, Filter.bits(prints))
                yield batch_of({"bucket": [bucket], "bits": [bits.tobytes()]}, target)

    words = np.zeros(size, np.uint64)
    for row in frequent.mapInArrow(make, "bucket long, bits binary").toArrow().to_pylist():
        at = row["bucket"] * size // buckets
        words[at : at + stretch] |= np.frombuffer(row["bits"], np.uint64)
    return frequent.sparkSession.sparkContext.broadcast(words.tobytes())


def _texts(texts: DataFrame, pairs: Broadcast, longer: Broadcast | None, options: MiningOptions) -> DataFrame:
    """``lang, size, phrase, count``: frequent runs of each buffer by their text; size 0 counts all words."""
    schema = "lang string, size int, phrase binary, count long"
    target = arrow_schema(texts.sparkSession, schema)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = Filter(np.frombuffer(pairs.value, np.uint64))
        long = Filter(np.frombuffer(longer.value, np.uint64)) if longer else None
        for buffer in _buffers(batches, options):
            number = np.bincount(buffer.part[buffer.own], minlength=len(buffer.langs))
            yield batch_of(
                {"lang": buffer.langs, "size": [0] * len(number), "phrase": [b""] * len(number), "count": number},
                target,
            )
            ids = buffer.word_ids()
            for n in range(1, options.longest + 1):
                places = buffer.candidates(n, short)
                prints = buffer.prints(places, n)
                passed = (short if n < 3 else long).holds(prints)
                places, prints = places[passed], prints[passed]
                if not len(places):
                    continue
                _, first, back, counts = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
                pointed = places[first][back]
                same = buffer.part[places] == buffer.part[pointed]
                if not same.all():
                    same |= np.array(buffer.langs, object)[buffer.part[places]] == (
                        np.array(buffer.langs, object)[buffer.part[pointed]]
                    )
                for i in range(n):
                    same &= ids[places + i] == ids[pointed + i]
                odd = places[~same]
                counts = counts - np.bincount(back[~same], minlength=len(counts))
                where = np.concatenate([places[first], odd])
                yield batch_of(
                    {
                        "lang": [buffer.langs[k] for k in buffer.part[where].tolist()],
                        "size": np.full(len(where), n, np.int32),
                        "phrase": [buffer.text(k, n) for k in where.tolist()],
                        "count": np.concatenate([counts, np.ones(len(odd), np.int64)]),
                    },
                    target,
                )

    return texts.mapInArrow(read, schema)


def phrase_counts(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", options: MiningOptions = MiningOptions()
) -> DataFrame:
    """``lang, size, phrase, count``: all runs of 1 to ``longest`` words met ``least`` times in their language, by
    text, and in the row of size 0 the number of all words of the language."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(
        F.col(text_col).cast("binary").alias("text"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
    )
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = 1 << min(max(8, (size // 3 // options.bucket_rows).bit_length()), 22, (options.filter_bytes // 8).bit_length() - 1)
    pairs = _filter(_counted(texts, (1, 2), None, buckets, options), buckets, options)
    longer = None
    if options.longest > 2:
        sizes = tuple(range(3, options.longest + 1))
        longer = _filter(_counted(texts, sizes, pairs, buckets, options), buckets, options)
    counts = _texts(texts, pairs, longer, options).groupBy("lang", "size", "phrase").agg(F.sum("count").alias("count"))
    often = (F.col("size") == 0) | (F.col("count") >= options.least)
    return written(counts.filter(often).withColumn("phrase", F.col("phrase").cast("string")), "phrase-counts")


def _run_of(words: str, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def mine(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", options: MiningOptions = MiningOptions()
) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its worst cut (of equal scores the first), ``n`` all words of
    the language; score = floor(scale * a / (l + r)), exact beyond 64 bits.  A phrase inside a longer candidate that
    has ``covered`` percent of its occurrences goes.  Ranks go by score, a (both falling) and phrase (bytes, rising).
    Null texts are empty, a null language is ``und``, equal rows count each.  Tables without a frequent phrase give no
    row.  A long text is read in parts; a single word is held whole.  Only the two named columns are looked at.
    """
    counts = phrase_counts(docs, text_col, lang_col, options)
    known = counts.filter("size > 0").select("lang", "phrase", "count")
    runs = counts.filter("size > 1").select("lang", "phrase", "size", F.col("count").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = runs.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang",
        "phrase",
        "a",
        "k",
        _run_of("w", F.lit(1), F.col("k")).alias("left"),
        _run_of("w", F.col("k") + 1, F.col("size") - F.col("k")).alias("right"),
    )
    lefts = known.select("lang", F.col("phrase").alias("left"), F.col("count").alias("l"))
    rights = known.select("lang", F.col("phrase").alias("right"), F.col("count").alias("r"))
    score = F.expr(f"CAST(CAST({options.scale} AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(19, 0)) DIV (CAST(l AS DECIMAL(19, 0)) + r) AS LONG)")
    scored = (
        cuts.join(lefts, ["lang", "left"])
        .join(rights, ["lang", "right"])
        .withColumn("score", score)
        .groupBy("lang", "phrase")
        .agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("worst"))
    )
    inside = (
        runs.filter("size > 2")
        .withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
        .select("lang", _run_of("w", F.col("i"), F.col("m")).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("most"))
    )
    wide = lambda c, by: F.col(c).cast("decimal(19, 0)") * F.lit(by)
    own = F.col("most").isNull() | (wide("most", 100) < wide("a", options.covered))
    totals = counts.filter("size = 0").select("lang", F.col("count").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        scored.join(inside, ["lang", "phrase"], "left")
        .filter(own)
        .select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score")
        .withColumn("rank", F.row_number().over(best))  # each task hands on its own best alone
        .filter(F.col("rank") <= options.top)
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
