"""Hierarchical multi-length packing of tokenized documents, streamed inside each partition.

Context tiers are powers of two.  A document fills whole longest windows first; its rest goes to the smallest tier
that holds it and opens a window there.  The gaps of the longer windows are filled from the shorter tiers, best fit
first, and by a cut where nothing fits.  Only the last few windows of a partition can stay open, and what they hold
is spread over tiers again.  Sequences of equal length form step groups of equal token counts.

No row moves: packing is a map over partitions with bounded state, so one hot source or a very long document
costs no more than its own tokens.  Sequence ids derive from the partition number, so a task that runs again gives
the same ids.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwatch.llm.common import KEPT, arrow_schema, batch_of, working_as

ID_BYTES = 4

#: Words in each of the two generations of a tokenizer's memo.
GENERATION_WORDS = 800_000


@dataclass(frozen=True)
class PackingOptions:
    tiers: tuple[int, ...] = (256, 512, 1024, 2048)
    end_id: int = 1
    step_tokens: int = 16_384
    #: rests held at once before they are packed
    round_rows: int = 4_096

    def __post_init__(self):
        if list(self.tiers) != sorted(self.tiers) or any(t & (t - 1) or t < 1 for t in self.tiers):
            raise ValueError("tiers must be rising powers of two")


class WordTokenizer:
    """Ids of a text as bytes, for tokenizers that never join text across ASCII white space.

    The ids of a word do not depend on its neighbours, so each word is encoded once and remembered.
    """

    def __init__(self, path: str, chunk: int = 500):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.chunk = chunk

    def ready(self, words: set[bytes]) -> None:
        """See that all words are in the memo.  A full memo becomes the old one, from which words still come back."""
        missing = words.difference(self.memo)  # looks up the words; ``-`` would go through the memo
        if len(self.memo) + len(missing) > GENERATION_WORDS:
            self.old, self.memo, missing = self.memo, {}, words
        kept = missing & self.old.keys()
        self.memo.update((w, self.old[w]) for w in kept)
        self.learn(list(missing - kept))

    def learn(self, words: list[bytes]) -> None:
        for at in range(0, len(words), self.chunk):
            part = [w.decode() for w in words[at : at + self.chunk]]
            encoded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(encoded.ids, "<u4")
            starts = np.fromiter((o[0] for o in encoded.offsets), np.int64, len(ids))
            ends = np.cumsum([len(w) + 1 for w in part])
            cuts = [0, *np.searchsorted(starts, ends, "left").tolist()]
            raw = ids.tobytes()
            for i, word in enumerate(words[at : at + self.chunk]):
                self.memo[word] = raw[cuts[i] * ID_BYTES : cuts[i + 1] * ID_BYTES]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").encode("utf-8", "replace").split() for t in texts]
        self.ready(set().union(*split))
        get = self.memo.__getitem__
        return [b"".join(map(get, words)) for words in split]


_TOKENIZERS: dict[str, WordTokenizer] = {}
KEPT["packing"] = _TOKENIZERS.clear


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer, with its memo, for each Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


@dataclass
class Rest:
    """A part of a document that is not in a sequence yet."""

    doc: object
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // ID_BYTES

    def cut(self, n: int) -> tuple[Rest, Rest]:
        at = n * ID_BYTES
        return (
            Rest(self.doc, self.start, self.ids[:at], self.doc_tokens),
            Rest(self.doc, self.start + n, self.ids[at:], self.doc_tokens),
        )


class Packer:
    """Packs the documents of one partition; ``put`` gets each finished sequence with its window length."""

    def __init__(self, options: PackingOptions, put: Callable[[list[Rest], int], None]):
        self.options, self.put, self.rests = options, put, []

    def tier_of(self, n: int) -> int:
        return self.options.tiers[bisect_left(self.options.tiers, n)]

    def add(self, doc: object, ids: bytes) -> None:
        top = self.options.tiers[-1]
        rest = Rest(doc, 0, ids, len(ids) // ID_BYTES)
        while len(rest) >= top:
            whole, rest = rest.cut(top)
            self.put([whole], top)
        if len(rest):
            self.rests.append(rest)
        if len(self.rests) >= self.options.round_rows:
            self.rests = self.pack(self.rests)

    def pack(self, rests: list[Rest]) -> list[Rest]:
        """Close every window that can be filled; the rests that remain make up less than one longest window."""
        rests = sorted(rests, key=len)  # shortest first; equal lengths stay in order of arrival
        sizes = [len(r) for r in rests]
        total = sum(sizes)
        while rests:
            tier = self.tier_of(sizes[-1])
            if total < tier:
                break
            rest = rests.pop()
            window, gap = [rest], tier - sizes.pop()
            while gap:
                at = bisect_right(sizes, gap) - 1
                if at >= 0:
                    size, filler = sizes.pop(at), rests.pop(at)
                else:  # even the shortest is longer than the gap
                    filler, left = rests.pop(0).cut(gap)
                    sizes.pop(0)
                    size = gap
                    place = bisect_right(sizes, len(left))
                    sizes.insert(place, len(left))
                    rests.insert(place, left)
                window.append(filler)
                gap -= size
            total -= tier
            self.put(window, tier)
        return rests

    def finish(self) -> None:
        """Spread what is left over whole tiers, the longest first; only the last sequence can stay open."""
        left = self.pack(self.rests)
        total = sum(map(len, left))
        for tier in reversed(self.options.tiers):
            while total >= tier or (tier == self.options.tiers[0] and total):
                window, gap = [], min(tier, total)
                total -= gap
                while gap:
                    rest = left.pop()
                    if len(rest) > gap:
                        rest, back = rest.cut(gap)
                        left.append(back)
                    window.append(rest)
                    gap -= len(rest)
                self.put(window, tier)
        self.rests = []


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    options: PackingOptions = PackingOptions(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document, neighbouring within its sequence.

    ``doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, window,
    sequence_tokens, step_group``.  A sequence is padded from ``sequence_tokens`` to ``window``; only the last one
    of a partition can need it.  A null or empty text is the end id alone.  Repeated rows are packed like any other.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long,"
        " window int, sequence_tokens int, step_group long"
    )
    target = arrow_schema(docs.sparkSession, schema)

    def run(batches) -> Iterator:
        working_as("packing")
        tokenizer = word_tokenizer(tokenizer_path)
        end = np.array([options.end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 36
        count, in_group = 0, dict.fromkeys(options.tiers, 0)
        group_of: dict[int, int] = {}
        groups = 0
        out: dict[str, list] = {f.name: [] for f in target}

        def put(window: list[Rest], tier: int) -> None:
            nonlocal count, groups
            if tier not in group_of or in_group[tier] >= max(1, options.step_tokens // tier):
                group_of[tier], in_group[tier], groups = base + groups, 0, groups + 1
            in_group[tier] += 1
            offset, tokens = 0, sum(map(len, window))
            for rest in window:
                values = (
                    rest.doc, rest.start, len(rest), rest.ids, rest.doc_tokens, base + count, offset, tier, tokens,
                    group_of[tier],
                )
                for name, value in zip(target.names, values, strict=True):
                    out[name].append(value)
                offset += len(rest)
            count += 1

        packer = Packer(options, put)
        for batch in batches:
            columns = batch.to_pydict()
            for doc, ids in zip(columns["doc_id"], tokenizer.encode_batch(columns["text"]), strict=True):
                packer.add(doc, ids + end)
            if len(out["start"]) >= 2_000:
                yield batch_of(out, target)
                for column in out.values():
                    column.clear()
        packer.finish()
        if out["start"]:
            yield batch_of(out, target)

    return rows.mapInArrow(run, schema)
