"""Jaccard join of word shingles as a metric-space join: pivots, regions, triangle-inequality windows, recursion.

Jaccard distance is a metric, but documents chosen as global pivots do not partition text: nearly all documents lie
at distance 1 from any of them.  So regions come in two levels, and both bounds below are exact.

* Region seeds are single shingles under one global order.  With t = 0.8 two linked sets share one of their first
  floor(n/5) + 1 shingles, so this window of a document's seeds is where it is copied to.  Shingles met in many
  windows ("busy") are skipped: the window of a document grows by one for each.  A document whose window would have
  to grow by more than a tenth of its size keeps its busy seeds too and meets there the others like it.
* Inside a region the smallest class is the pivot document, with exact distances to it.  Members within the
  threshold are linked to it, hence to each other's component.  By the triangle inequality a linked member x can only
  have an unseen link to a member y that is not linked to the pivot, with d(y, pivot) <= d(x, pivot) + 0.2.  Members
  without such a y are done; the rest form the region anew with the next pivot.  What is left after a few pivots,
  documents that share little more than their seed, splits into annuli of set sizes and blocks of bounded size.

Regions that hold nearly the same classes are merged, so near copies that share very many seeds meet in few regions.

Before sets are compared, parities of their shingles by hash classes bound the distance from below: classes of unlike
parity hold a shingle each that only one of the sets has.  There are two to four such classes for each shingle, so the
bound is near the distance itself and hardly a pair that is not linked gets past it.

Documents with equal sets are one class throughout.  Links end in ``components.connected``.  The recursion finds the
components only; where links are asked for, they are counted afterwards from all pairs of classes of a component.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietwatch.llm.common import (
    arrow_schema, batch_of, checkpointed, gram_hashes, map_batches, mixed, word_hashes, written,
)
from quietwatch.llm.components import connected

#: Hash classes of parities, at least and at most; beyond a set of half as many the bound becomes weaker.
LEAST_BITS, MOST_BITS = 64, 65_536


@dataclass(frozen=True)
class JaccardOptions:
    """``busy``: a seed met in so many windows is skipped.  At most ``busy_seeds`` are skipped, the most frequent.

    Up to ``broadcast_rows`` names of classes are broadcast to the texts; more are joined by a shuffle.
    To count links a component splits into blocks of ``count_rows`` classes, at most ``count_blocks`` of them while
    each holds no more than about ``count_items`` shingles.
    """

    words: int = 5
    busy: int = 8
    busy_seeds: int = 1_000_000
    pivot_turns: int = 2
    broadcast_rows: int = 1_000_000
    block: int = 2_000
    count_rows: int = 500
    count_blocks: int = 64
    count_items: int = 2_000_000


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted different hashes of runs of words, A-Z in lower case; a shorter text is one run."""
    h = hashed_words(text.encode("utf-8", "replace")) if text else np.zeros(0, np.uint64)
    if not len(h):
        return h
    if len(h) >= words:
        grams = np.sort(gram_hashes(h, words))
        return grams[np.append(True, grams[1:] != grams[:-1])]
    return mixed(gram_hashes(h, len(h)) ^ np.uint64(len(h)))


#: Bytes whose words are hashed at a time; a word at least that long is hashed by itself.
PIECE = 1 << 14
#: A-Z in lower case, each blank as a space.
_FOLDED = bytes(range(256)).lower().translate(bytes.maketrans(b"\t\n\r\v\f", b"     "))
_BASE = 0xD6E8FEB86659FD93
_UP, _DOWN = (
    np.multiply.accumulate(np.array([1] + [k] * PIECE, np.uint64)) for k in (_BASE, pow(_BASE, -1, 1 << 64))
)


def hashed_words(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z as a-z.

    A word is a polynomial of its bytes, each plus one.  Those of all words come from one sum along the text, so there is
    no call for each word.
    """
    text = text.translate(_FOLDED)
    raw = np.frombuffer(text, np.uint8)
    found, start = [], 0
    while start < len(raw):
        part = raw[start : start + PIECE]
        if len(part) == PIECE:
            size = text.rfind(b" ", start, start + PIECE) + 1 - start
            if size <= 0:
                end = text.find(b" ", start + PIECE)
                stop = len(raw) if end < 0 else end
                found.append(word_hashes([text[start:stop]]))
                start = stop
                continue
            part = part[:size]
        start += len(part)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)], out=total[1:])
        blank = np.ones(len(part) + 2, bool)
        np.equal(part, ord(" "), out=blank[1:-1])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        first, last = edges[::2], edges[1::2]
        found.append(mixed((total[last] - total[first]) * _DOWN[first]))
    if len(found) == 1:
        return found[0]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def window_size(n: int) -> int:
    """Among so many first elements any set with similarity 0.8 or more shares one."""
    return n // 5 + 1


def stored_size(n: int) -> int:
    return min(n, window_size(n) + n // 8 + 1)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are known; the known ones are in order, so very many of them cost little more than few."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def seeds_of(first: np.ndarray, n: int, busy: np.ndarray) -> np.ndarray:
    """The seeds of one document from its first shingles; ``busy`` is in order.

    A document that skips h busy ones, h at most n // 10, has a window h longer.  For two such sets with hx <= hy the
    first window_size + hx shingles of both share at least 1 + hx, at most hx of them skipped by x; so one is a seed
    of both.  A document that would skip more keeps all plain shingles it has stored, which reach n // 8 beyond its
    plain window: linked sizes differ by a quarter at most, so these cover the window of any document that skips.
    Two documents of the latter kind meet in their plain windows, busy shingles included.
    """
    size = window_size(n)
    is_busy = among(first, busy)
    plain = first[~is_busy]
    if size <= np.count_nonzero(~is_busy[: size + n // 10]):
        return plain[:size]
    return np.concatenate([plain, first[:size][is_busy[:size]]])


def _seeds(first: bytes) -> np.ndarray:
    return np.frombuffer(first, "<u8")


def parities(s: np.ndarray) -> bytes:
    """For each hash class whether the set has an odd number of shingles of it, one bit each."""
    size = min(max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length()), MOST_BITS) if len(s) else LEAST_BITS
    counts = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def folded(mark: bytes, size: int) -> bytes:
    """The parities of fewer classes: a class of them is two of the others."""
    while len(mark) > size:
        half = len(mark) // 2
        mark = (int.from_bytes(mark[:half]) ^ int.from_bytes(mark[half:])).to_bytes(half)
    return mark


def unlike(a: bytes, b: bytes) -> int:
    """At least so many shingles are in one of two sets only, by their parities."""
    size = min(len(a), len(b))
    return (int.from_bytes(folded(a, size)) ^ int.from_bytes(folded(b, size))).bit_count()


def far_apart(only_one: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Lower bounds of the Jaccard distance, by row; ``only_one``: at least so many shingles are in one set only."""
    total = (n_a + n_b).astype(np.float64)
    apart = np.maximum(only_one, np.abs(n_a - n_b))
    return 2.0 * apart / (total + apart)


def read_sets(docs: DataFrame, id_col: str, text_col: str, options: JaccardOptions) -> DataFrame:
    """``row, doc_id, print, n, c1, c2, parity, first`` of each document, written to the shared folder.

    ``row`` numbers the documents; ``print`` hashes the text; (c1, c2) is a 128-bit name of the set; ``first`` are its smallest shingles,
    eight bytes each.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {id_type}, print long, n int, c1 long, c2 long, parity binary, first binary"
    target = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in target}
            for doc_id, text_print, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingles(text, options.words)
                name = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
                values = (
                    number, doc_id, text_print, len(s), int(name[0]), int(name[1]), parities(s),
                    s[: stored_size(len(s))].tobytes(),
                )
                number += 1
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
            yield batch_of(out, target)

    return written(rows.mapInArrow(run, schema), "shingle-sets")


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: JaccardOptions = JaccardOptions()
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, n_links, component_id``.

    ``component_id`` is the smallest id reachable over links, the own one included; ``n_links`` counts the links of
    the document's class, that is all other sets of shingles with similarity 0.8 or more; copies with an equal set count
    as one.  A text without words has no shingles and no links.
    Rows that repeat an id are documents like any other.  Null ids are never a component's name unless it has no
    other.
    """
    return labelled(docs, id_col, text_col, options, count=True).select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: JaccardOptions = JaccardOptions()
) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the document with the smallest id stays.

    Null ids come last; of rows equal in id and text one stays.  Texts without words all stay.
    """
    named = labelled(docs, id_col, text_col, options).filter("n > 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "print")
    best = named.groupBy("root").agg(F.min(order).alias("best"))
    keys = best.select(F.xxhash64(F.col("best.doc_id").cast("string")).alias("k1"), F.col("best.print").alias("k2"))
    k1, k2 = F.xxhash64(F.col(id_col).cast("string")), F.xxhash64(text_col)
    with_words = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    taken = {c.lower() for c in docs.columns}
    a, b = (next(n for i in range(len(taken) + 1) if (n := f"_{c}{i}") not in taken) for c in ("ka", "kb"))
    said = docs.filter(with_words).withColumns({a: k1, b: k2})
    once = said.join(keys.select(F.col("k1").alias(a), F.col("k2").alias(b)), [a, b], "left_semi").dropDuplicates([a, b])
    return once.select(*docs.columns).unionByName(docs.filter(~with_words))


def labelled(docs: DataFrame, id_col: str, text_col: str, options: JaccardOptions, count: bool = False) -> DataFrame:
    """``row, doc_id, print, n, c1, c2, root, component_id``; the last two are null for texts without words.

    With ``count`` also ``n_links``, null where there are none.
    """
    spark = docs.sparkSession
    sets = read_sets(docs, id_col, text_col, options)
    full = sets.filter("n > 0")
    classes = checkpointed(
        full.groupBy("c1", "c2").agg(
            F.min("row").alias("class"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.count("*").alias("held")
        )
    )
    firsts = _one_of_each(full, classes, options)

    def plain(batch):
        return {"seed": np.concatenate([_seeds(f)[: window_size(n)] for f, n in zip(batch["first"], batch["n"], strict=True)]).view(np.int64)}

    counted = (
        map_batches(firsts.select("n", "first"), plain, "seed long")
        .groupBy("seed").count().filter(F.col("count") >= options.busy)
        .orderBy(F.desc("count"), "seed").limit(options.busy_seeds)
    )
    # at most busy_seeds numbers, eight bytes each on the driver
    busy = spark.sparkContext.broadcast(
        np.sort(checkpointed(counted.select("seed")).toArrow().column("seed").to_numpy().view(np.uint64))
    )

    def place(batch):
        found = [
            seeds_of(_seeds(f), n, busy.value)
            for f, n in zip(batch["first"], batch["n"], strict=True)
        ]
        held = [len(s) for s in found]
        return {
            "seed": np.concatenate(found).view(np.int64),
            "class": np.repeat(np.array(batch["row"], np.int64), held),
            "n": np.repeat(np.array(batch["n"], np.int32), held),
        }

    # one shuffle by seed; a seed that only one class has ends here
    of_seed = Window.partitionBy("seed")
    copies = map_batches(firsts.select("row", "n", "first"), place, "seed long, class long, n int")
    shared = (
        copies.withColumn("low", F.min("class").over(of_seed))
        .withColumn("high", F.max("class").over(of_seed))
        .filter("low < high")
        .select("seed", "class", "n")
    )
    members = _crowded(shared)
    wanted = members.select(F.col("class").alias("row")).distinct()
    names = checkpointed(sets.select("row", _key("doc_id"), "print", "parity").join(wanted, "row"))
    parity, items = names.select("row", "parity"), _WholeSets(docs, names, id_col, text_col, options)
    roots = connected(_recursion(parity, items, members, options))
    if count:
        kin = roots.withColumnRenamed("node", "class").join(classes.select("class", "n"), "class")
        degree = checkpointed(_degrees(items, kin, options))
    items.drop()

    named = classes.select("class", "c1", "c2", "least").join(
        roots.withColumnRenamed("node", "class"), "class", "left"
    ).withColumn("root", F.coalesce("root", "class"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(ids, "root")
    if count:
        labels = labels.join(degree, "class", "left")
    labels = labels.drop("class", "least")
    return sets.select("row", "doc_id", "print", "n", "c1", "c2").join(labels, ["c1", "c2"], "left")


def _crowded(members: DataFrame) -> DataFrame:
    """Members, ``seed, class, n``, of regions that still hold two classes.

    Seeds that stand in the same texts make the same region; one of them stands for all.  Equal regions are known by
    their size and two hashes of 64 bits of their classes.  Regions that agree in their first and last class make one,
    if that is at most twice as large as the largest of them; whatever two classes met before meet still.
    """
    members = checkpointed(members)  # read three times below
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "class")).alias(f"mark{k}") for k in (1, 2)]
    ends = [F.min("class").alias("low"), F.max("class").alias("high")]
    sizes = members.groupBy("seed").agg(F.count("*").alias("size"), *ends, *marks).filter("size > 1")
    regions = sizes.groupBy("size", "low", "high", "mark1", "mark2").agg(F.min("seed").alias("seed"))
    alike = Window.partitionBy("low", "high")
    regions = checkpointed(
        regions.select(
            "seed",
            F.count("*").over(alike).alias("met"),
            F.max("size").over(alike).alias("most"),
            F.min("seed").over(alike).alias("into"),
        )
    )
    moved = regions.filter("met > 1").select("seed", "into", "most")
    union = members.join(moved, "seed").groupBy("into", "class").agg(F.first("most").alias("most"))
    narrow = union.groupBy("into").agg(F.count("*").alias("held"), F.first("most").alias("most")).filter("held <= 2 * most")
    kept = regions.select("seed", "into").join(narrow.select("into", "held"), "into", "left")
    kept = kept.select("seed", F.when(F.col("held").isNull(), F.col("seed")).otherwise(F.col("into")).alias("into"))
    return checkpointed(members.join(kept, "seed").select(F.col("into").alias("seed"), "class", "n").distinct())


def _one_of_each(full: DataFrame, classes: DataFrame, options: JaccardOptions) -> DataFrame:
    """``row, n, first`` of one document of each class, the one that names it.

    Up to ``broadcast_rows`` rows that stay or go are broadcast; beyond it the rows are shuffled once.
    """
    firsts = full.select("row", "n", "first")
    rows, kept = classes.agg(F.coalesce(F.sum("held"), F.lit(0)), F.count("*")).first()
    if rows == kept:
        return firsts
    stay = classes.select(F.col("class").alias("row"))
    if min(rows - kept, kept) > options.broadcast_rows:
        return written(firsts.join(stay, "row", "left_semi"), "shingle-classes")
    if kept < rows - kept:
        return firsts.join(F.broadcast(stay), "row", "left_semi")
    again = classes.filter("held > 1").select("c1", "c2", "class")
    gone = checkpointed(full.select("row", "c1", "c2").join(again, ["c1", "c2"]).filter("row > class").select("row"))
    return firsts.join(F.broadcast(gone), "row", "left_anti")


def _key(name: str):
    return F.xxhash64(F.col(name).cast("string")).alias("key")


class _WholeSets:
    """``row, items`` of classes, made from their texts when they are asked for, once for each class.

    To store every document's set would take twice the input, and most classes are never compared.  ``names`` has
    ``row, key, print`` of the documents.  Rows equal in id and text make equal rows here.
    """

    def __init__(self, docs: DataFrame, names: DataFrame, id_col: str, text_col: str, options: JaccardOptions):
        self._texts = docs.select(_key(id_col), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
        self._names, self._options = names.select("key", "print", "row"), options
        self._parts: list[tuple[DataFrame, DataFrame]] = []

    def of(self, rows: DataFrame) -> DataFrame | None:
        """The sets of these rows and of all asked for before; None if there are none."""
        for known, _ in self._parts:
            rows = rows.join(known, "row", "left_anti")
        new = checkpointed(self._names.join(rows.distinct(), "row"))
        number = new.count()
        if number:
            spark, words = new.sparkSession, self._options.words

            def build(batch):
                return {"row": batch["row"], "items": [shingles(t, words).tobytes() for t in batch["text"]]}

            small = F.broadcast(new) if number <= self._options.broadcast_rows else new
            built = map_batches(
                self._texts.join(small, ["key", "print"]).select("row", "text"), build, "row long, items binary"
            )
            partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
            self._parts.append((new.select("row").distinct(), built.repartition(partitions, "row").persist()))
        found = None
        for _, part in self._parts:
            found = part if found is None else found.unionByName(part)
        return found

    def drop(self) -> None:
        for _, part in self._parts:
            part.unpersist()


def _recursion(parity, items, members, options) -> DataFrame:
    """Pairs of classes, ``a, b``, that reach as far as all links do."""
    spark = parity.sparkSession
    known = spark.createDataFrame([], "a long, b long, distance double, exact boolean")
    for _ in range(options.pivot_turns):
        if members.isEmpty():
            break
        order = Window.partitionBy("seed").orderBy("class")
        pivots = (
            members.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") == 1)
            .select("seed", F.col("class").alias("pivot"), F.col("n").alias("pivot_n"))
        )
        pairs = members.join(pivots, "seed").filter("pivot < class").select(
            "seed", F.col("pivot").alias("a"), F.col("class").alias("b"), F.col("pivot_n").alias("na"), F.col("n").alias("nb")
        )
        found = _distances(parity, items, _new(pairs, known))
        known = checkpointed(known.unionByName(found))
        measured = pairs.select("seed", "a", "b").join(known, ["a", "b"])
        linked = F.col("exact") & (F.col("distance") <= 0.2)
        # the nearest member that is not linked to the pivot, or a lower bound of its distance
        outer = measured.filter(~linked).groupBy("seed").agg(F.min("distance").alias("outer"))
        near = measured.filter(linked).join(outer, "seed", "left").select(
            "seed",
            F.col("b").alias("class"),
            (F.col("outer").isNull() | (F.col("distance") + 0.2 < F.col("outer") - 1e-9)).alias("done"),
        )
        rest = members.join(pivots.select("seed", F.col("pivot").alias("class")), ["seed", "class"], "left_anti")
        rest = rest.join(near, ["seed", "class"], "left").filter(~F.coalesce("done", F.lit(False)))
        members = _crowded(rest.drop("done"))
    is_link = "exact AND distance <= 0.2"
    early = checkpointed(connected(known.filter(is_link).select("a", "b")))
    joined = members.join(early.select(F.col("node").alias("class"), F.col("root").alias("joined")), "class", "left")
    last = _new(_leaves(parity, joined.withColumn("joined", F.coalesce("joined", "class")), options), known)
    late = checkpointed(_distances(parity, items, last).filter(is_link).select("a", "b"))
    return late.unionByName(early.select(F.col("root").alias("a"), F.col("node").alias("b")))


def _new(pairs: DataFrame, known: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "na", "nb").distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")


#: Sizes of linked sets differ by a factor of 1.25 at most, so they lie in the same annulus or in neighbouring ones.
ANNULUS = 1.26
#: A task hands over about so many pairs at a time.
PAIRS = 50_000


def _leaves(parity: DataFrame, members: DataFrame, options: JaccardOptions) -> DataFrame:
    """``a, b, na, nb``: pairs in what is left of the regions that the lower bound cannot rule out.

    A region splits into annuli of sizes; each member is copied to the next annulus as a visitor.  An annulus of many
    members splits into blocks, and each pair of blocks is a task of its own.  Members that the pivots have brought
    into one component, ``joined``, are not paired, so a group of near copies adds no pairs here.
    """
    ring = F.floor(F.log("n") / F.log(F.lit(ANNULUS))).cast("int")
    placed = members.withColumn("ring", F.explode(F.array(ring, ring + 1))).withColumn("home", F.col("ring") == ring)
    parts = placed.groupBy("seed", "ring").agg(F.count("*").alias("held"), F.max("home").alias("lived_in"))
    parts = parts.filter("lived_in AND held > 1").select(
        "seed", "ring", F.ceil(F.col("held") / options.block).cast("int").alias("blocks")
    )
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    tasks = (
        placed.join(parts, ["seed", "ring"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "seed", "ring", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
            "class", "n", "joined", "home",
        )
        .join(parity.withColumnRenamed("row", "class"), "class")
    )
    keys = ["seed", "ring", "i", "j"]
    schema = "a long, b long, na int, nb int"
    target = arrow_schema(parity.sparkSession, schema)

    def pairs_of(group: list[dict]):
        """The pairs of one member with all later ones, time after time."""
        size = min(len(r["parity"]) for r in group)
        wide = np.frombuffer(b"".join(folded(r["parity"], size) for r in group), "<u8").reshape(len(group), -1)
        ids, n, own, home, tag = (np.array([r[c] for r in group]) for c in ("class", "n", "own", "home", "joined"))
        crossing = group[0]["i"] != group[0]["j"]
        for k in range(len(group) - 1):
            rest = slice(k + 1, None)
            good = (home[k] | home[rest]) & (tag[rest] != tag[k])
            if crossing:
                good &= own[rest] != own[k]
            at = np.flatnonzero(good & (np.minimum(n[k], n[rest]) * 5 >= np.maximum(n[k], n[rest]) * 4)) + k + 1
            if len(at):
                only_one = np.bitwise_count(wide[at] ^ wide[k]).sum(axis=1, dtype=np.int64)
                at = at[far_apart(only_one, n[at], n[k]) <= 0.2 + 1e-9]
            if len(at):
                swap = ids[at] < ids[k]
                low, high = np.where(swap, ids[at], ids[k]), np.where(swap, ids[k], ids[at])
                yield low, high, np.where(swap, n[at], n[k]), np.where(swap, n[k], n[at])

    def run(batches):
        rows = (r for batch in batches for r in batch.to_pylist())
        held, size = [], 0
        for _, group in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
            for found in pairs_of(list(group)):
                held.append(found)
                size += len(found[0])
                if size >= PAIRS:
                    yield batch_of(dict(zip(target.names, map(np.concatenate, zip(*held)))), target)
                    held, size = [], 0
        if held:
            yield batch_of(dict(zip(target.names, map(np.concatenate, zip(*held)))), target)

    return tasks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema).distinct()


def _distances(parity, items, pairs) -> DataFrame:
    """``a, b, distance, exact`` of each pair: the distance, or a lower bound above 0.2 that spares the comparison.

    A link is 100 * intersection >= 80 * union, decided in whole numbers; its distance is then at most 0.2.
    """
    sized = pairs.join(parity.select(F.col("row").alias("a"), F.col("parity").alias("parity_a")), "a").join(
        parity.select(F.col("row").alias("b"), F.col("parity").alias("parity_b")), "b"
    )

    def bound(batch):
        only_one = np.array(list(map(unlike, batch["parity_a"], batch["parity_b"])), np.int64)
        least = far_apart(only_one, np.array(batch["na"]), np.array(batch["nb"]))
        return {"a": batch["a"], "b": batch["b"], "distance": least}

    bounded = checkpointed(map_batches(sized, bound, "a long, b long, distance double"))
    far = F.col("distance") > 0.2 + 1e-9
    near = bounded.filter(~far).select("a", "b")
    known = bounded.filter(far).withColumn("exact", F.lit(False))
    items = items.of(near.select(F.explode(F.array("a", "b")).alias("row")))
    if items is None:
        return known

    both = near.join(items.select(F.col("row").alias("b"), F.col("items").alias("items_b")), "b").join(
        items.select(F.col("row").alias("a"), F.col("items").alias("items_a")), "a"
    )

    def compare(batch):
        out = {"a": batch["a"], "b": batch["b"], "distance": []}
        for x, y in zip(batch["items_a"], batch["items_b"], strict=True):
            p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            inter = len(np.intersect1d(p, q, assume_unique=True))
            union = len(p) + len(q) - inter
            apart = 1.0 - inter / union
            out["distance"].append(min(apart, 0.2) if 100 * inter >= 80 * union else max(apart, 0.2 + 1e-12))
        return out

    exact = map_batches(both, compare, "a long, b long, distance double").distinct().withColumn("exact", F.lit(True))
    return exact.unionByName(known)


#: Classes and shingles of a tile: pairs are compared tile by tile.
TILE_ROWS, TILE_ITEMS = 512, 200_000
#: Shingles of a tile that are multiplied at a time.
COLUMNS = 4_096


def _tiles(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The places of the sets, by size, in tiles."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    tiles, start, held = [], 0, 0
    for at, k in enumerate(order):
        if at > start and (at - start >= TILE_ROWS or held + len(sets[k]) > TILE_ITEMS):
            tiles.append(order[start:at])
            start, held = at, 0
        held += len(sets[k])
    return [*tiles, order[start:]]


def linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets of the two lists are linked: 100 * intersection >= 80 * union, decided in whole numbers."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    shared = np.intersect1d(*flat)
    inter = np.zeros((len(left), len(right)), np.int64)
    if not len(shared):
        return inter > 0
    places = []
    for items, n in zip(flat, sizes, strict=True):
        column = np.minimum(np.searchsorted(shared, items), len(shared) - 1)
        hit = shared[column] == items
        row, column = np.repeat(np.arange(len(n)), n)[hit], column[hit]
        by_column = np.argsort(column, kind="stable")
        places.append((row[by_column], column[by_column]))
    for low in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - low)
        dense = []
        for (row, column), n in zip(places, sizes, strict=True):
            part = slice(*np.searchsorted(column, [low, low + width]))
            dense.append(np.zeros((len(n), width), np.float32))
            dense[-1][row[part], column[part] - low] = 1
        inter += (dense[0] @ dense[1].T).astype(np.int64)
    return 9 * inter >= 4 * (sizes[0][:, None] + sizes[1])


def link_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Links of each set of ``left`` to ``right`` and the other way; without ``right`` among themselves."""
    sides = [left] if right is None else [left, right]
    counts = [np.zeros(len(side), np.int64) for side in sides]
    tiles = [_tiles(side) for side in sides]
    for x, a in enumerate(tiles[0]):
        for b in tiles[0][x:] if right is None else tiles[1]:
            sets_a, sets_b = [left[k] for k in a], [sides[-1][k] for k in b]
            # tiles go by size, so their ends tell whether any pair can be linked
            if len(sets_a[-1]) * 5 < len(sets_b[0]) * 4 or len(sets_b[-1]) * 5 < len(sets_a[0]) * 4:
                continue
            found = linked(sets_a, sets_b)
            if right is None and a is b:
                counts[0][a] += found.sum(axis=1) - 1
            else:
                counts[0][a] += found.sum(axis=1)
                counts[-1][b] += found.sum(axis=0)
    return counts


def _degrees(items: DataFrame, kin: DataFrame, options: JaccardOptions) -> DataFrame:
    """``class, n_links`` of the classes in ``kin``: ``class, root, n``.

    Linked classes are of one component.  A component splits into blocks, each pair of blocks is a task of its own, and
    a task hands over one number for each class.
    """
    parts = kin.groupBy("root").agg(F.count("*").alias("held"), F.sum("n").alias("weight"))
    by_rows = F.least(F.ceil(F.col("held") / options.count_rows), F.lit(options.count_blocks))
    blocks = F.greatest(by_rows, F.ceil(F.col("weight") / options.count_items)).cast("int")
    placed = checkpointed(kin.join(parts.select("root", "held", blocks.alias("blocks")), "root"))
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    in_pair = placed.filter("held = 2").select("class", F.lit(1).cast("long").alias("n_links"))
    items = items.of(placed.filter("held > 2").select(F.col("class").alias("row")))
    if items is None:
        return in_pair
    tasks = (
        placed.filter("held > 2")
        .select("root", "class", "blocks", own.alias("own"))
        # rows equal in id and text have one set
        .join(items.dropDuplicates(["row"]).withColumnRenamed("row", "class"), "class")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "items")
    )
    keys = ["root", "i", "j"]
    schema = "class long, n_links long"
    target = arrow_schema(kin.sparkSession, schema)

    def run(batches):
        rows = (r for batch in batches for r in batch.to_pylist())
        ids, counts, size = [], [], 0
        for (_, i, j), group in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
            sides = {k: ([], []) for k in sorted({i, j})}
            for r in group:
                sides[r["own"]][0].append(r["class"])
                sides[r["own"]][1].append(np.frombuffer(r["items"], "<u8"))
            if not all(held for held, _ in sides.values()):
                continue
            ids += [np.array(held, np.int64) for held, _ in sides.values()]
            counts += link_counts(*(sets for _, sets in sides.values()))
            size += sum(len(held) for held, _ in sides.values())
            if size >= PAIRS:
                yield batch_of({"class": np.concatenate(ids), "n_links": np.concatenate(counts)}, target)
                ids, counts, size = [], [], 0
        if ids:
            yield batch_of({"class": np.concatenate(ids), "n_links": np.concatenate(counts)}, target)

    counted = tasks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
    return counted.unionByName(in_pair).groupBy("class").agg(F.sum("n_links").alias("n_links"))
