"""Word hashes, window fingerprints, bounds of distances and merged regions against brute force."""

import random

import numpy as np
import xxhash

from quietwatch.llm import common, jaccard, substrings


def test_word_hashes_are_those_of_the_library():
    words = [b"one", b"two", "dré".encode(), b"one"]
    assert common.word_hashes(words).tolist() == [xxhash.xxh3_64_intdigest(w) for w in words]
    assert common.word_hashes([]).tolist() == []


def test_a_window_has_one_fingerprint_wherever_it_stands():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(300)] + [None, ""]
    found = {}
    for text, hashes in zip(texts, substrings.hashed(texts), strict=True):
        words = substrings.words_of(text)
        prints = substrings.window_prints(hashes, 5).tolist()
        assert len(prints) == max(0, len(words) - 4)
        for i, p in enumerate(prints):
            assert found.setdefault(tuple(words[i : i + 5]), p) == p
    assert len({tuple(p) for p in found.values()}) == len(found) == 32


def test_parities_bound_the_distance_closely():
    """Variants of one text that are not linked are ruled out without comparing them; linked ones never are."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for changed, linked in ((30, True), (56, False), (380, False)):
        for size in (400, 250):
            a, b = base[:size].copy(), base.copy()
            b[:changed] = rng.integers(0, 1 << 63, changed, dtype=np.uint64)
            a, b = np.unique(a), np.unique(b)
            inter = len(np.intersect1d(a, b))
            apart = 1 - inter / (len(a) + len(b) - inter)
            only_one = jaccard.unlike(jaccard.parities(a), jaccard.parities(b))
            least = jaccard.far_apart(np.array([only_one]), np.array([len(a)]), np.array([len(b)]))[0]
            assert least <= apart + 1e-9
            assert (least <= 0.2) == (linked and size == 400)
    assert jaccard.unlike(jaccard.parities(base[:0]), jaccard.parities(base[:3])) <= 3


def test_near_copies_that_share_many_seeds_meet_in_few_regions(spark):
    """Sixty seeds in nearly the same forty classes were sixty regions; a pair was compared in each of them."""
    rows = [(seed, c, 100) for seed in range(60) for c in range(40) if seed == 0 or c != 1 + seed % 38]
    rows += [(1000, 0, 100), (1000, 500, 100), (1000, 39, 100), (1001, 7, 100)]
    members = spark.createDataFrame(rows, "seed long, class long, n int")
    got = {}
    for r in jaccard._crowded(members).collect():
        got.setdefault(r.seed, set()).add(r["class"])
    assert len(got) <= 2
    met = {(a, b) for held in got.values() for a in held for b in held}
    assert all((a, b) in met for s, a, _ in rows for t, b, _ in rows if s == t and s != 1001)
