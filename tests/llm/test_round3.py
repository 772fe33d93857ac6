"""Brute-force comparisons and edge cases of the operators added last: phrases, leaks, prefix tries."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quietwatch.llm import collocations, decontamination, prefix_trie

DOCS = "doc_id long, text string, lang string, row long, kept string, words string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# phrases


def phrases_by_hand(rows, least, top, longest=4):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        totals[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(
                len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, b in often.items()
            )
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def phrase_rows(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def prose():
    rng = np.random.default_rng(3)
    vocabulary = ["The", "of", "é", "café", "x\x00y", "\U0001f600", "New", "york", "a", "b\x1cc"]
    rows = []
    for i in range(60):
        words = [vocabulary[k] for k in rng.integers(0, len(vocabulary), 60) ** 2 % 10]
        gaps = [[" ", "  ", "\t", ". ", ",", "\n", " ", " "][k] for k in rng.integers(0, 8, 60)]
        rows.append(("".join(w + g for w, g in zip(words, gaps)) + "red green blue sky " * 3, [None, "en", "de", "und"][i % 4]))
    rows += [(None, "en"), ("", None), (" \t.\n", "xx"), ("New York!" * 40, "en")] + [("same row here", "fr")] * 5
    return rows


@pytest.mark.parametrize("buffer_bytes", [200, 4_000_000])
@pytest.mark.parametrize("filter_bytes", [8, 1 << 25])
def test_phrases_against_brute_force(spark, prose, buffer_bytes, filter_bytes):
    """Small buffers cut texts in parts; a filter of one word lets everything pass; neither changes a row."""
    docs = spark.createDataFrame([(i, t, lang, 1, "k", "w") for i, (t, lang) in enumerate(prose)], DOCS).repartition(3)
    options = collocations.MiningOptions(least=5, top=20, buffer_bytes=buffer_bytes, filter_bytes=filter_bytes)
    assert phrase_rows(collocations.mine(docs, options=options)) == phrases_by_hand(prose, 5, 20)


def test_equal_fingerprints_do_not_mix(spark, prose, monkeypatch):
    """Fingerprints of four bits make nearly all phrases collide; counts by text stay right."""
    words = [(f"{a} {b}", "en") for a in "abcdefgh" for b in "abcdefgh" for _ in range(2 + (a == b) * 4)]
    docs = spark.createDataFrame([(i, t, lang, 1, "k", "w") for i, (t, lang) in enumerate(words)], DOCS).coalesce(2)
    buffer = collocations.Buffer([(t.encode(), len(t), lang) for t, lang in words])
    buffer.words = buffer.words & np.uint64(3)
    ids = buffer.word_ids()
    texts = [buffer.text(k, 1) for k in range(len(ids))]
    same = [[ids[i] == ids[j] for j in range(40)] for i in range(40)]
    first = {t: texts.index(t) for t in texts}
    for i in range(40):
        for j in range(40):
            assert not same[i][j] or texts[i] == texts[j]
    assert first
    options = collocations.MiningOptions(least=5, top=20)
    assert phrase_rows(collocations.mine(docs, options=options)) == phrases_by_hand(words, 5, 20)


def test_phrases_of_empty_tables(spark):
    assert collocations.mine(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.mine(spark.createDataFrame([(1, None, None, 1, "k", "w")], DOCS)).count() == 0


def test_score_beyond_64_bits(spark, monkeypatch):
    """Counts of 2**60: products of 2,000,000 and sums of counts stay exact."""
    rows = [("en", 0, "", 1 << 62), ("en", 1, "a", (1 << 61) + 1), ("en", 1, "b", 1 << 61), ("en", 2, "a b", (1 << 60) + 7)]
    counts = spark.createDataFrame(rows, "lang string, size int, phrase string, count long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: counts)
    (row,) = collocations.mine(counts).collect()
    assert row.score == 2_000_000 * ((1 << 60) + 7) // ((1 << 62) + 1)


# leaks


def leaks_by_hand(docs, items, window):
    def words(text):
        return [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))]

    windows = defaultdict(set)
    for item, text in items:
        w = [x[0] for x in words(text)]
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(item)
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for seq, names in windows.items():
            for i in range(len(w) - len(seq) + 1):
                if tuple(x[0] for x in w[i : i + len(seq)]) == seq:
                    hit.update(range(i, i + len(seq)))
                    found |= names
        runs = [[w[k][1], w[k][2], k] for k in sorted(hit)]
        merged = []
        for start, end, k in runs:
            if merged and merged[-1][2] == k - 1:
                merged[-1][1:] = [end, k]
            else:
                merged.append([start, end, k])
        names = sorted(str(n) for n in found if n is not None)
        out.append((str(doc_id), len(w), len(hit), [tuple(m[:2]) for m in merged], names))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1_000_000, 60])
def test_leaks_against_brute_force(spark, block_bytes):
    long = " ".join(f"w{i}" for i in range(2500))
    items = [
        (1, "One two three four five six seven eight nine ten eleven"), (2, "short ITEM é"), (3, None), (4, " .,"),
        (10, "one two three four five six seven eight nine ten"), (10, "another text of the same item"), (None, "no name"),
        (5, long), (6, "a a a a a a a a a a a a"),
    ]
    docs = [
        (1, "x ONE-two, three four five five six seven eight nine ten eleven"), (2, None), (3, ""), (4, "\U0001f600 é! Short item É"),
        (5, "One two three four five six seven eight nine ten eleven one two three four five six seven eight nine ten"),
        (5, "short item é short item é"), (None, "no name no. NAME noname"), (6, "a " * 15), (7, "z " * 3 + long + " end"),
        (8, "w995 " + " ".join(f"w{i}" for i in range(996, 1010))), (8, "another text of the same"),
    ]
    frame = spark.createDataFrame([(i, t, "en", 1, "k", "w") for i, t in docs], DOCS).withColumnRenamed("words", "items")
    tests = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    options = decontamination.LeakOptions(block_bytes=block_bytes)
    got = decontamination.find_leaks(frame, tests, options=options).collect()
    rows = sorted((str(r.doc_id), r.n_words, r.n_hit, [(h.start, h.end) for h in r.hits], list(r["items"])) for r in got)
    assert rows == leaks_by_hand(docs, items, 10)


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 1, "k", "w")], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    (row,) = decontamination.find_leaks(docs, none).collect()
    assert (row.n_words, row.n_hit, row.hits, row["items"]) == (2, 0, [], [])
    assert decontamination.find_leaks(docs.limit(0), none).count() == 0


# prefix tries


def rebuilt_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def trie_by_hand(sequences):
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in own if len(sequences[c]) == len(node))
        out.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own),
            sum(len(n) == len(node) + 1 for n in below),
            sum(not any(m[: len(n)] == n and len(m) > len(n) for m in members) for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string, steps int, id string"


@pytest.fixture(scope="module")
def talks():
    rng = np.random.default_rng(5)
    rows = []
    for c in [*range(0, 40), *range(300, 330), 512, 4000]:
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, "user", f"text {rng.integers(0, 2)} é\U0001f600"))
    rows += [(700 + i, t, "user", "same") for i in range(60) for t in range(3)]  # copies
    rows += [(900, None, None, None), (900, 1, "b", "x"), (900, 1, "a", "y"), (900, 1, "a", "y"), (None, 1, "a", "y")]
    rows += [(5000, t, "user", "long" * (t % 3)) for t in range(300)]
    return rows


def trie_rows(frame):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=repr)


@pytest.mark.parametrize("shard_turns, fan", [(200_000, 64), (30, 3)])
def test_trie_against_brute_force(spark, talks, shard_turns, fan):
    """Small shards cut paths and copies anywhere; merges in several levels give the same nodes."""
    turns = spark.createDataFrame([(*r, 1, "i") for r in talks], TURNS).repartition(5)
    sequences = prefix_trie.shared_openings(prefix_trie.turn_sequences(turns), 100, 6)
    got = prefix_trie.prefix_trie(sequences, prefix_trie.TrieOptions(shard_turns, fan))
    assert trie_rows(got) == trie_by_hand(rebuilt_by_hand(talks))


def test_trie_of_few_rows(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(prefix_trie.turn_sequences(none)).count() == 0
    one = [(5, 0, "user", None)]  # its base is absent, so its opening goes and it is turnless
    turns = spark.createDataFrame([(*r, 1, "i") for r in one], TURNS)
    got = prefix_trie.prefix_trie(prefix_trie.shared_openings(prefix_trie.turn_sequences(turns), 100, 6))
    assert trie_rows(got) == trie_by_hand(rebuilt_by_hand(one))


# earlier operators


def test_white_space_of_the_library():
    """U+001C to U+001F end a run of white space in the library, though Python counts them to it."""
    import public_tokenizers

    from quietwatch.llm import byte_bpe

    enc = byte_bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = np.random.default_rng(8)
    pieces = [" " * 2500, "\x85", "\x1c", "\x1d", "\u00a0", " " * 2100, "a", "\n", "\t " * 1200]
    texts = [" " * 2500 + "\x85\x1c" + " " * 2500] + ["".join(pieces[k] for k in rng.integers(0, 9, 6)) for _ in range(60)]
    for text in texts:
        assert byte_bpe.encode(enc, text) == enc.encode_ordinary(text)


def test_whole_private_keys_are_hidden(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIBOgIBAAJB\nAKj34Gkx+/=\n-----END RSA PRIVATE KEY-----"
    rows = [(1, f"a {key} b {key}"), (2, "-----BEGIN PRIVATE KEY-----\nMIIB no end"), (3, "-----END PRIVATE KEY-----")]
    from quietwatch.llm import secrets

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hidden = {r.doc_id: r.text for r in docs.withColumn("text", secrets.redacted("text")).collect()}
    assert "MIIB" not in hidden[1] and "END" not in hidden[1] and hidden[1].startswith("a ")
    assert "BEGIN" not in hidden[2] and "no end" in hidden[2]
    assert hidden[3] == rows[2][1]


def test_exception_phrases_in_a_long_text():
    from quietwatch.llm import toxicity

    lexicon = toxicity.Lexicon({"idiot": 3.0, "trash": 2.0})
    by_hand = lexicon.evidence("trash can idiot ")
    assert by_hand > 0
    long = lexicon.evidence("trash can idiot " * 40_000)  # linear: a quadratic merge would take minutes
    assert long > by_hand


def test_learner_against_plain_follow_the_leader():
    """The sparse updates against the same rule written over dense vectors."""
    from quietwatch.llm import quality

    options = quality.QualityOptions(bits=6, epochs=3)
    rng = np.random.default_rng(2)
    words = ["good", "bad", "the", "of", "x1", "!!", "Zed"]
    rows = [(" ".join(words[k] for k in rng.integers(0, 7, 9)), int(i % 2)) for i in range(30)] + [(None, 1), ("", 0)]
    got, bias = quality.follow_leader(rows, options)
    size = (1 << options.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    l1 = np.append(np.full(size - 1, options.l1), 0.0)

    def leader():
        w = -(z - np.sign(z) * l1) / ((options.beta + np.sqrt(n)) / options.alpha + options.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    for _ in range(options.epochs):
        for text, label in rows:
            x = np.zeros(size)
            index, values = quality.vector(text, options.bits)
            x[index] = values
            x[-1] = 1.0
            w = leader()
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / options.alpha
            z += g - sigma * w
            n += g * g
    assert np.allclose(np.append(got, bias), leader())
