"""Costs of the Jaccard join that grew with the number of busy seeds, of copies and of classes never compared."""

import random
import time

import numpy as np

from quietwatch.llm import jaccard


def test_busy_seeds_cost_little_however_many_there_are():
    """A document was matched with all busy seeds: 31 ms at a million of them, more than all other work on it."""
    rng = np.random.default_rng(5)
    first = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
    busy = np.unique(np.append(rng.integers(0, 1 << 63, 1_000_000, dtype=np.uint64), first[::9]))
    n = 800
    begun = time.perf_counter()
    for _ in range(50):
        got = jaccard.seeds_of(first, n, busy)
    assert time.perf_counter() - begun < 50 * 0.005
    hit = np.isin(first, busy)
    assert got.tolist() == first[~hit][: jaccard.window_size(n)].tolist()
    for known in (busy[:0], busy[:1], first[-1:], first):
        assert jaccard.among(first, known).tolist() == np.isin(first, known).tolist()


def test_words_are_hashed_alike_wherever_they_stand():
    rng = random.Random(6)
    size = jaccard.PIECE
    texts = ["", " ", "a", "\x00a a a\x00", "x " + "ab" * size + " y", "é É ﬀ\x1c\x1d\x85 x", "word " * size, " " * 2 * size + "z"]
    texts += [c * n + end for c in "xq" for n in (size - 1, size, size + 1) for end in ("", " ", " x")]
    texts += ["".join(rng.choice("aAbB \t\n\v\f\r\x1cé0") for _ in range(rng.randrange(60))) for _ in range(500)]
    found = {}
    for text in texts:
        words, hashes = text.encode().lower().split(), jaccard.hashed_words(text.encode()).tolist()
        assert len(words) == len(hashes)
        for word, h in zip(words, hashes, strict=True):
            assert found.setdefault(word, h) == h
    assert len(set(found.values())) == len(found)


def _tables(spark, rows, monkeypatch, options):
    """The numbers of documents that are placed and of sets that are made from texts."""
    placed, made = [], []
    one, of = jaccard._one_of_each, jaccard._WholeSets.of

    def counted(*args):
        placed.append(one(*args))
        return placed[-1]

    def asked(self, wanted):
        found = of(self, wanted)
        made.append(0 if found is None else found.count())
        return found

    monkeypatch.setattr(jaccard, "_one_of_each", counted)
    monkeypatch.setattr(jaccard._WholeSets, "of", asked)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.join(docs, options=options).collect()}
    return got, placed[0].select("row").distinct().count(), placed[0].count(), max(made, default=0)


def test_a_text_met_often_is_placed_once(spark, monkeypatch):
    """Copies of a text made all its seeds busy, and each copy was placed under its seeds."""
    texts = [" ".join(f"t{i}w{k}" for k in range(60)) for i in range(6)]
    rows = [(100 * c + i, t) for c in range(12) for i, t in enumerate(texts)] + [(5000, texts[0] + " more")]
    want = {d: (d % 100 if d < 5000 else 0, int(d == 5000 or d % 100 == 0)) for d, _ in rows}
    # classes, copies, and neither of them are few enough to be broadcast
    for bound, kept in ((1_000_000, rows), (0, rows), (1_000_000, [*rows[:8], rows[-1]])):
        with monkeypatch.context() as m:
            got, different, placed, _ = _tables(spark, kept, m, jaccard.JaccardOptions(broadcast_rows=bound))
        assert placed == different == 7
        assert got == {d: want[d] for d, _ in kept}


def test_sets_are_made_of_texts_that_are_compared(spark, monkeypatch):
    """All texts that share a seed with another were read and split again, though few of their pairs are near."""
    common = " ".join(f"c{k}" for k in range(30))
    rows = [(i, " ".join(f"t{i}w{k}" for k in range(90)) + " " + common) for i in range(40)]
    rows += [(100, rows[0][1] + " more"), (101, rows[0][1] + " still more")]
    got, _, placed, made = _tables(spark, rows, monkeypatch, jaccard.JaccardOptions(busy=50))
    assert placed == 42 and made == 3
    assert got == {d: (0 if d in (0, 100, 101) else d, 2 if d in (0, 100, 101) else 0) for d, _ in rows}
