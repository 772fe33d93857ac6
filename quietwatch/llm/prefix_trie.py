"""Prefix trie of conversations: ternary search trees over dictionary-encoded turns, one for each range of sequences.

Sequences of turn ids are sorted over all shards.  A shard builds one ternary search tree from its distinct sequences,
the median first, so that the trees among brothers are balanced.  A node that is neither on the path of the shard's
first sequence nor on that of its last cannot occur elsewhere and is complete.  The two paths, the boundary nodes, go
on and are merged for groups of neighbouring shards, then for groups of groups, until one group is left.  Nothing but
those paths meets in a merge, so its size follows the number of shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwatch.llm.common import arrow_schema, batch_of, bounded_batches, written

#: Digest of a node at which no sequence ends.
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODE = (
    "shard int, kind string, key binary, parent_key binary, conv_id long, parent_conv_id long, depth long,"
    " n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
)
_PATH = (
    ", side int, first int, ids array<long>, chars array<long>, counts array<long>, convs array<long>,"
    " children array<long>, leaves array<long>, saved array<long>, digests array<string>"
)
_SCHEMA = _NODE + _PATH + ", part int, text binary"


@dataclass(frozen=True)
class TrieOptions:
    """A shard has about ``shard_turns`` turns; a merge takes the paths of ``fan`` neighbours."""

    shard_turns: int = 200_000
    fan: int = 64

    def __post_init__(self):
        if self.shard_turns < 1 or self.fan < 2:
            raise ValueError("shard_turns must be positive and fan at least 2")


def turn_sequences(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, steps``: each conversation as an array of (id, chars), one for a turn, in order.

    Turns go by ``turn``, null first, equal ones by role and text; null roles and texts are empty; rows without a
    conversation id take no part.  Equal turns (role and text) have equal ids; ``chars`` counts code points of the text.
    Rows are ordered by ranges, so a conversation that holds much of the table is sorted by many tasks; its ids, 8 bytes
    a turn, are one row.
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    rows = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    # cut texts are enough for the borders of the ranges: rows equal in them stay together
    key = ["conv_id", "turn", F.substring("role", 1, 32), F.substring("text", 1, 64)]
    schema = "conv_id long, shard int, place long, turn_key binary, chars long"
    target = arrow_schema(spark, schema)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last, place = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            out: dict = {f.name: [] for f in target}
            out["conv_id"] = batch["conv_id"]
            columns = (batch[c].to_pylist() for c in ("conv_id", "role", "text"))
            for conv_id, said_by, said in zip(*columns, strict=True):
                place = place + 1 if conv_id == last else 0
                last = conv_id
                out["shard"].append(shard)
                out["place"].append(place)
                whole = f"{len(said_by)}:{said_by}{said}".encode("utf-8", "surrogatepass")
                out["turn_key"].append(hashlib.sha256(whole).digest())
                out["chars"].append(len(said))
            yield batch_of(out, target)

    ordered = rows.repartitionByRange(*key).sortWithinPartitions("conv_id", "turn", "role", "text")
    coded = written(ordered.mapInArrow(encode, schema), "turns")
    keys = coded.select("turn_key").distinct()
    names = written(keys.withColumn("id", F.monotonically_increasing_id()), "turn-names")
    # of a conversation cut by a range border the ranges come in order
    whole = (
        coded.join(names, "turn_key")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("shard", "place", "id", "chars"))).alias("steps"))
    )
    return written(
        whole.select("conv_id", F.transform("steps", lambda s: F.struct(s["id"], s["chars"])).alias("steps")),
        "sequences",
    )


def shared_openings(sequences: DataFrame, every: int, most: int) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % every in place of its own first h, where
    h = crc32(c as decimal text) % most; fewer turns there give fewer, none if that conversation is absent."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    own = sequences.withColumn("h", h).withColumn("origin", F.col("conv_id") - F.col("conv_id") % every)
    heads = sequences.select(F.col("conv_id").alias("origin"), F.slice("steps", 1, most).alias("head"))
    rest = F.when(F.size("steps") > F.col("h"), F.slice("steps", F.col("h") + 1, F.size("steps")))
    none = F.slice("steps", 1, 0)
    return (
        own.join(heads, "origin", "left")
        .withColumn("opening", F.coalesce(F.slice("head", 1, F.col("h")), none))
        .select("conv_id", F.concat("opening", F.coalesce(rest, none)).alias("steps"))
    )


class _Nodes:
    """Nodes of a trie in the order of their making, parents first, with what is known below and at each."""

    def __init__(self):
        self.parent, self.depth, self.turn, self.chars = [-1], [0], [-1], [0]
        self.counts, self.convs, self.children, self.leaves, self.saved = [0], [None], [0], [0], [0]
        self.digests: list[str | None] = [None]
        self.keys: list[bytes | None] = [b""]

    def add(self, parent: int, turn: int, chars: int) -> int:
        for column, value in (
            (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.turn, turn), (self.chars, chars),
            (self.counts, 0), (self.convs, None), (self.children, 0), (self.leaves, 0), (self.saved, 0),
            (self.digests, None), (self.keys, None),
        ):
            column.append(value)
        return len(self.parent) - 1

    def met(self, k: int, count: int, conv: int) -> None:
        self.counts[k] += count
        if self.convs[k] is None or conv < self.convs[k]:
            self.convs[k] = conv

    def name(self, path: list[int]) -> None:
        """Keys of the nodes of a path from the root: chained digests of their turns."""
        for above, k in zip(path, path[1:]):
            if self.keys[k] is None:
                whole = self.keys[above] + self.turn[k].to_bytes(8, "big", signed=True)
                self.keys[k] = hashlib.blake2b(whole, digest_size=16).digest()

    def close(self, edge: set[int], out: _Rows) -> None:
        """Complete all nodes but those of ``edge``, children first, and tell their parents."""
        for k in range(len(self.parent) - 1, -1, -1):
            if k in edge:
                continue
            up = self.parent[k]
            if not self.children[k]:
                self.leaves[k] = 1
            saved = self.saved[k] + (self.counts[k] - 1) * self.chars[k]
            at_edge = up in edge
            out.add(
                kind="node",
                key=self.keys[k],
                parent_key=self.keys[up] if at_edge else None,
                conv_id=self.convs[k],
                parent_conv_id=self.convs[up] if up >= 0 and not at_edge else None,
                depth=self.depth[k],
                n_convs=self.counts[k],
                n_children=self.children[k],
                n_leaves=self.leaves[k],
                saved_tokens=saved,
                ends=self.digests[k],
            )
            if up >= 0:
                self.children[up] += 1
                self.leaves[up] += self.leaves[k]
                self.saved[up] += saved

    def put_path(self, side: int, first: int, path: list[int], out: _Rows) -> None:
        of = lambda column: [column[k] for k in path]
        out.add(
            kind="path", side=side, first=first, ids=of(self.turn), chars=of(self.chars), counts=of(self.counts),
            convs=of(self.convs), children=of(self.children), leaves=of(self.leaves), saved=of(self.saved),
            digests=of(self.digests),
        )


class _Rows:
    """Output rows; those that are full go as they come."""

    def __init__(self, target: pa.Schema, shard: int):
        self.target, self.shard = target, shard
        self.rows: list[dict] = []

    def add(self, **row) -> None:
        row["shard"] = self.shard
        self.rows.append(row)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.rows), 5000):
            some = self.rows[at : at + 5000]
            yield batch_of({f.name: [r.get(f.name) for r in some] for f in self.target}, self.target)
        self.rows = []


class _Tree:
    """Ternary search tree: brothers hang in a binary tree by turn id, the middle link leads to the children."""

    def __init__(self, nodes: _Nodes):
        self.nodes = nodes
        self.low, self.high, self.middle = [-1], [-1], [-1]

    def insert(self, steps: list[tuple[int, int]]) -> int:
        nodes, at = self.nodes, 0
        for turn, chars in steps:
            parent, link, where = at, self.middle, at
            at = link[where]
            while at >= 0 and nodes.turn[at] != turn:
                link, where = (self.low if turn < nodes.turn[at] else self.high), at
                at = link[where]
            if at < 0:
                at = nodes.add(parent, turn, chars)
                for column in (self.low, self.high, self.middle):
                    column.append(-1)
                link[where] = at
        return at


def _path(nodes: _Nodes, k: int) -> list[int]:
    out = []
    while k >= 0:
        out.append(k)
        k = nodes.parent[k]
    return out[::-1]


def _sequences(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[int]]]:
    rows = (
        (ids, chars, conv)
        for batch in batches
        for ids, chars, conv in zip(*(batch[c].to_pylist() for c in ("ids", "chars", "conv_id")), strict=True)
    )
    for ids, group in groupby(rows, key=lambda r: r[0]):
        own = list(group)  # ordered by conversation
        yield list(zip(ids, own[0][1], strict=True)), [conv for _, _, conv in own]


def _joined(convs: list[int]) -> bytes:
    return ",".join(map(str, convs)).encode()


def _shard(batches: Iterable[pa.RecordBatch], out: _Rows) -> None:
    found = []
    held = None  # the sequence before: whether it is the last one shows only later
    for steps, convs in _sequences(batches):
        if held:
            found.append((*held[:3], held[3] if len(found) == 0 else hashlib.sha256(held[3]).hexdigest()))
        held = (steps, len(convs), convs[0], _joined(convs))
    if not held:
        return
    found.append(held)
    nodes = _Nodes()
    tree = _Tree(nodes)
    ends = [0] * len(found)
    ranges = [(0, len(found))]
    while ranges:  # the median of each range goes in first
        low, high = ranges.pop()
        if low < high:
            mid = (low + high) // 2
            ends[mid] = tree.insert(found[mid][0])
            ranges += [(mid + 1, high), (low, mid)]
    first, last = _path(nodes, ends[0]), _path(nodes, ends[-1])
    nodes.name(first)
    nodes.name(last)
    for k, (_, count, conv, said) in zip(ends, found, strict=True):
        nodes.met(k, count, conv)
        if isinstance(said, str):
            nodes.digests[k] = said
    for k in range(len(nodes.parent) - 1, 0, -1):  # members of a node: what ends there and what goes on
        nodes.met(nodes.parent[k], nodes.counts[k], nodes.convs[k])
    for k, said in dict(((ends[0], found[0][3]), (ends[-1], found[-1][3]))).items():
        for part, at in enumerate(range(0, len(said), 1 << 20)):
            out.add(kind="ends", key=nodes.keys[k], part=part, text=said[at : at + (1 << 20)])
    _put(nodes, first, last, out)


def _put(nodes: _Nodes, first: list[int], last: list[int], out: _Rows) -> None:
    """Complete what lies within, hand on both paths; the second from where it leaves the first."""
    fork = next((d for d, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))
    nodes.close({*first, *last}, out)
    nodes.put_path(0, 0, first, out)
    nodes.put_path(1, fork, last[fork:], out)


def _merge(rows: list[dict], final: bool, out: _Rows) -> None:
    """The paths of neighbouring shards, in their order, become those of the group."""
    nodes = _Nodes()
    known: dict[tuple[int, int], int] = {}
    left, paths = [], []
    for row in rows:
        path = [] if row["side"] == 0 else left[: row["first"]]
        for i, turn in enumerate(row["ids"]):
            if not path:
                k = 0
            else:
                k = known.get((path[-1], turn))
                if k is None:
                    k = known[path[-1], turn] = nodes.add(path[-1], turn, row["chars"][i])
            nodes.met(k, row["counts"][i], row["convs"][i])
            nodes.children[k] += row["children"][i]
            nodes.leaves[k] += row["leaves"][i]
            nodes.saved[k] += row["saved"][i]
            nodes.digests[k] = nodes.digests[k] or row["digests"][i]
            path.append(k)
        nodes.name(path)
        if row["side"] == 0:
            left = path
        paths.append(path)
    if final:
        nodes.close(set(), out)
    else:
        _put(nodes, paths[0], paths[-1], out)


def prefix_trie(sequences: DataFrame, options: TrieOptions = TrieOptions()) -> DataFrame:
    """Nodes of the trie of ``sequences`` (``conv_id``, ``steps`` of (id, chars)), the textless root included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs`` (members), ``n_children``, ``n_leaves``
    (childless nodes below, itself included), ``saved_tokens`` (below and at the node, (members - 1) times the code
    points of its last turn) and ``ends_sha256`` (of the ids of the sequences that end there, rising, comma-joined).
    Each ``conv_id`` has one row.  No rows: no node.  Copies of one sequence are dealt out by their ids like any other
    rows; the digest of their ids is sequential and streams through one task, a part of 1 MiB at a time.
    """
    spark = sequences.sparkSession
    bounded_batches(spark)
    rows = written(
        sequences.select("conv_id", F.col("steps.id").alias("ids"), F.col("steps.chars").alias("chars")), "rebuilt"
    )
    turns = rows.agg(F.sum(F.size("ids") + 1).alias("n")).first()["n"] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // options.shard_turns))
    target = arrow_schema(spark, _SCHEMA)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(target, TaskContext.get().partitionId())
        _shard(batches, out)
        yield from out.batches()

    def merged(final: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = (row for batch in batches for row in batch.to_pylist())
            for group, own in groupby(found, key=lambda r: r["group"]):
                out = _Rows(target, group)
                _merge(list(own), final, out)
                yield from out.batches()

        return run

    dealt = rows.repartitionByRange(shards, "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    level = written(dealt.mapInArrow(build, _SCHEMA), "trie-shards")
    done = [level.filter("kind = 'node'")]
    ends = level.filter("kind = 'ends'").select("key", "shard", "part", "text")
    while True:
        paths = level.filter("kind = 'path'")
        last = paths.agg(F.max("shard").alias("n")).first()["n"]
        if last is None:
            break
        final = last < options.fan
        groups = paths.withColumn("group", F.expr(f"CAST(shard DIV {options.fan} AS INT)")).repartition("group")
        ordered = groups.sortWithinPartitions("group", "shard", "side")
        wanted = ["group", "side", "first", "ids", "chars", "counts", "convs", "children", "leaves", "saved", "digests"]
        level = written(ordered.select(*wanted).mapInArrow(merged(final), _SCHEMA), "trie-merged")
        done.append(level.filter("kind = 'node'"))
        if final:
            break
    columns = [c.split()[0] for c in _NODE.split(", ")][2:]
    inner, edge = done[0].select(*columns), [d.select(*columns) for d in done[1:]]
    if not edge:
        return inner.select(*_result(F.col("parent_conv_id"), F.col("ends")))
    borders = edge[0]
    for more in edge[1:]:
        borders = borders.unionByName(more)

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (
            r for batch in batches for r in zip(*(batch[c].to_pylist() for c in ("key", "part", "text")), strict=True)
        )
        for key, own in groupby(parts, key=lambda r: r[0]):
            whole, begun = hashlib.sha256(), False
            for _, part, text in own:
                whole.update(b"," + text if begun and part == 0 else text)  # a shard goes on where another ended
                begun = True
            yield batch_of({"key": [key], "streamed": [whole.hexdigest()]}, digests)

    digests = arrow_schema(spark, "key binary, streamed string")
    streamed = (
        ends.repartition("key").sortWithinPartitions("key", "shard", "part").select("key", "part", "text")
    ).mapInArrow(stream, "key binary, streamed string")
    borders = written(
        borders.join(streamed, "key", "left").withColumn("ends", F.coalesce("streamed", "ends")).select(*columns), "borders"
    )
    above = borders.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    under = inner.unionByName(borders)
    at_edge = under.filter("parent_key IS NOT NULL").join(above, "parent_key")
    within = under.filter("parent_key IS NULL").select(*_result(F.col("parent_conv_id"), F.col("ends")))
    return within.unionByName(at_edge.select(*_result(F.col("above"), F.col("ends"))))


def _result(parent: Column, ends: Column) -> list:
    return [
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce(ends, F.lit(NO_ENDS)).alias("ends_sha256"),
    ]
