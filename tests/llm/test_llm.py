"""Edge cases and brute-force comparisons of the operators in ``quietwatch.llm``."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quietwatch.llm import (
    byte_bpe, chat, chat_template, exact_topk, jaccard, multiprobe, packing, quality, secrets, substrings, toxicity,
    vectors,
)

SCHEMA = "doc_id long, text string, row long, kept string, _ka0 int"
WORDS = [f"w{i}" for i in range(200)]


def passage(a, b):
    return " ".join(WORDS[a:b])


@pytest.fixture(scope="module")
def docs(spark):
    near = WORDS[:100] + ["other"]
    texts = [
        (1, passage(0, 100)), (2, passage(0, 100)), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n "),
        (7, "one two"), (8, "One TWO"), (9, "x " + passage(120, 160) + " y"), (10, passage(118, 162) + " é"),
        (10, passage(118, 162) + " é"), (None, passage(0, 100)), (11, "a " * 300), (12, "token = 'abcdefgh1' \U0001f600"),
    ]
    return spark.createDataFrame([(i, t, 7, "k", 1) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_components(docs, empty):
    rows = jaccard.join(docs).collect()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == docs.count()
    sets = [(r.doc_id, shingle_set(r.text)) for r in docs.collect()]
    for doc_id, items in sets:
        if doc_id is None:
            continue
        assert by_id[doc_id].n_shingles == len(items)
        linked = [d for d, s in sets if d is not None and items and 100 * len(items & s) >= 80 * len(items | s)]
        assert by_id[doc_id].component_id == min(linked, default=doc_id)  # no chains in these rows
    assert next(r for r in rows if r.doc_id is None).component_id == 1
    assert jaccard.join(empty).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 5, 6, 7, 9, 11, 12])  # 10 is a near copy of 9


@pytest.mark.parametrize("busy", [1, 2, 8])
def test_jaccard_against_brute_force(spark, busy):
    rng = np.random.default_rng(busy)
    base = [[f"v{x}" for x in rng.integers(0, 400, 60)] for _ in range(6)]
    texts = []
    for i in range(60):
        words = list(base[i % 6])
        for _ in range(int(rng.integers(0, 5))):
            words[int(rng.integers(0, 60))] = f"z{rng.integers(0, 9)}"
        texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.join(frame, options=jaccard.JaccardOptions(busy=busy)).collect()}
    sets = [shingle_set(t) for t in texts]
    want = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    want[i] = want[j] = min(want[i], want[j])
    assert got == dict(enumerate(want))


@pytest.mark.parametrize(("count_rows", "count_items"), [(500, 2_000_000), (3, 2_000_000), (500, 900)])
def test_jaccard_counts_every_link(spark, count_rows, count_items):
    rng = np.random.default_rng(7)
    base = [[f"v{x}" for x in rng.integers(0, 400, 60)] for _ in range(4)]
    texts = [passage(0, 60), passage(0, 60) + " b", passage(0, 60) + " c", passage(0, 60), "one two", "One TWO", ""]
    texts += [passage(100 + i, 150 + i) for i in range(0, 30, 3)]  # a chain
    for i in range(60):
        words = list(base[i % 4])
        for _ in range(int(rng.integers(0, 5))):
            words[int(rng.integers(0, 60))] = f"z{rng.integers(0, 9)}"
        texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    options = jaccard.JaccardOptions(count_rows=count_rows, count_items=count_items)
    got = {r.doc_id: r.n_links for r in jaccard.join(frame, options=options).collect()}
    sets = [frozenset(shingle_set(t)) for t in texts]
    different = set(sets) - {frozenset()}
    want = [sum(100 * len(s & d) >= 80 * len(s | d) for d in different if d != s) if s else 0 for s in sets]
    assert got == dict(enumerate(want)) and want[:7] == [2, 2, 2, 2, 0, 0, 0]


def test_jaccard_links_of_tiles(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(jaccard, "TILE_ROWS", 5)
    monkeypatch.setattr(jaccard, "TILE_ITEMS", 150)
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    sets = [np.unique(rng.integers(0, 44, int(rng.integers(30, 300)))).astype(np.uint64) for _ in range(40)]
    pair = lambda p, q: 100 * len(set(p) & set(q)) >= 80 * len(set(p) | set(q))
    want = np.array([[pair(p, q) for q in sets] for p in sets])
    assert jaccard.link_counts(sets)[0].tolist() == (want.sum(axis=1) - 1).tolist()
    left, right = jaccard.link_counts(sets[:15], sets[15:])
    assert left.tolist() == want[:15, 15:].sum(axis=1).tolist() and right.tolist() == want[:15, 15:].sum(axis=0).tolist()


def brute_cut(texts, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


@pytest.mark.parametrize("hot", [0, 10_000])
def test_substrings_against_brute_force(docs, empty, hot):
    options = substrings.SubstringOptions(hot=hot)
    texts = [r.text for r in docs.collect()]
    want = Counter(hashlib.sha256(" ".join(w).encode()).hexdigest() for w in brute_cut(texts, 35))
    assert Counter(r.kept_sha256 for r in substrings.digests(docs, options=options).collect()) == want
    cut = substrings.dedup_substrings(docs, options=options)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert {r.doc_id: r.text for r in cut.collect()}[7] == "one two"
    assert substrings.digests(empty, options=options).count() == 0


def test_spread_windows_meet_across_buckets(spark):
    texts = [passage(0, 90)] * 30 + [passage(0, 60), passage(40, 110), "z " * 400, passage(100, 150)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: hashlib.sha256(" ".join(w).encode()).hexdigest() for i, w in enumerate(brute_cut(texts, 35))}
    options = substrings.SubstringOptions(hot=0)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")  # else the few rows of this test meet in one partition
    try:
        assert {r.doc_id: r.kept_sha256 for r in substrings.digests(frame, options=options).collect()} == want
        prints = Counter((r.k1, r.k2, r.place) for r in substrings.repeated_windows(frame, options=options).collect())
        assert set(prints.values()) == {1}
    finally:
        spark.conf.unset(name)


def test_packing_covers_every_id_once(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = packing.WordTokenizer(path).tokenizer
    options = packing.PackingOptions(tiers=(8, 16, 32), round_rows=3)
    rows = packing.pack_documents(docs, path, options).collect()
    want = Counter(
        zlib.crc32(np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
        for r in docs.collect()
    )
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    whole = Counter(zlib.crc32(r.ids) for r in rows if r.length == r.doc_tokens)
    assert not whole - want
    for r in rows:
        assert r.length * 4 == len(r.ids) and r.sequence_tokens <= r.window <= 32
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_ids_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["x <|endoftext|> y", "a<|startoftext|>b <|endoftext|><|endoftext|>", "<|startoftext|>", "plain <|endof text|>"]
    texts += [f" \n{t}\t " for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = Tokenizer.from_file(path)
    want = {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    pieces = {}
    for r in packing.pack_documents(frame, path).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        assert r.doc_tokens == len(want[r.doc_id])
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in pieces.items()} == want
    assert want[0][1] == 49407


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST] \\ \\n <s>"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, None, None), (1, 3, "tool [/ROLE]", "x"),
            (2, 0, "assistant", ""), (None, 0, "user", "a"), (3, 1, "user", "t"), (3, 1, "user", "t")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    one = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[:4])
    assert got[1].turns_sha256 == hashlib.sha256(one.encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[3].n_turns) == (4, len(said), 2)
    assert got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[2].loss_chars == 0 and got[None].n_turns == 1
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_template_language():
    render = chat_template.compile_template(
        "{{ 'a' + 'b'|upper }}{% if 1 == 2 %}no{% else %}yes{% endif %}"
        "{% for m in messages %}{% if loop.first and not m.role == 'x' %}>{% endif %}{{ loop.index }}{{ m.text|trim }}{% endfor %}"
    )
    assert "".join(t for t, _ in render(iter([("u", " p "), ("u", "q")]))) == "aByes>1p2q"
    for bad in ("{{ m.text }}", "{% for m in x %}{% endfor %}", "{{ 'a'.upper() }}", "{% if 1 %}", "{{ open }}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.compile_template(bad)
    folded = chat_template.fold(chat_template.parse("{{ 'a' }}b{% if 'x' == 'x' %}c{% endif %}"))
    assert folded == (chat_template.Emit(chat_template.Const("abc")),)


def test_byte_bpe_splits_safely(docs, empty):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    enc = byte_bpe.encoding(path, pattern)
    for text in ("word  12 don't  \n\n x" * 50, "a" + " " * 5000 + "b", "a" + "\n" * 3000, " " * 2500 + "\t\tz", "é ü" * 900):
        assert byte_bpe.encode(enc, text, 40) == enc.encode_ordinary(text)
    got = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, path, pattern), path, pattern).collect()
    assert Counter(bytes(r.bytes) for r in got) == Counter((r.text or "").encode() for r in docs.collect())
    assert byte_bpe.encode_documents(empty, path, pattern).count() == 0


RULES = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
    ("access", re.compile("AKIA[A-Z0-9]+")),
    ("hex", re.compile("[0-9a-f]+")),
]


def brute_secrets(text):
    least = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}
    return {(k, m.start(), m.end()) for k, rule in RULES for m in rule.finditer(text) if least[k](m)}


def test_secrets_against_regular_expressions(docs, empty):
    pieces = ["token", "=", ": ", "'", "secret", "API_KEY", "apikey", "AKIA", "ABCD1234EFGH5678", "deadbeef" * 4, " ", "é",
              "abcdefgh", "passwd", "=", "x.y", "\n", "ghp_" + "a1" * 12]
    rng = np.random.default_rng(4)
    scan = secrets.scanner()
    for _ in range(1500):
        text = "".join(pieces[i] for i in rng.integers(0, len(pieces), 14))
        got = {s for s in scan.spans(text) if s[0] in ("assign", "access", "hex")}
        assert got == brute_secrets(text), text
    assert scan.spans(None) == [] == scan.spans("")
    rows = {r.doc_id: r.spans for r in secrets.find_secrets(docs).collect()}
    assert [tuple(s) for s in rows[12]] == [("assign", 0, 18)]
    assert secrets.redact("é token = 'abcdefgh1' z") == "é [SECRET]' z"
    assert secrets.find_secrets(empty).count() == 0


def test_toxicity(spark, docs, empty):
    lexicon = toxicity.Lexicon({"idiot": 3.0, "vequ*": 3.0})
    assert lexicon.score("an 1d10t here") > lexicon.score("nothing") == lexicon.score(None) == lexicon.score("")
    assert lexicon.score("vequmo") > lexicon.score("xvequmo") and lexicon.score("idiot proof") == lexicon.score("x")
    assert lexicon.score("іdіоt") > lexicon.score("idiots")  # Cyrillic letters; a whole word only
    rows = [(i, ("you scumbag fool " if i % 2 else "kind words ") + str(i), i % 2) for i in range(60)] + [(99, None, 1)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int")
    fitted = toxicity.fit(labelled, "doc_id", "text", "label", toxicity.ToxicityOptions())
    assert fitted.score("scumbag 7") >= 0.3 > fitted.score("kind words")
    scored = toxicity.score_toxicity(docs, fitted)
    assert scored.count() == docs.count() and toxicity.score_toxicity(empty, fitted).count() == 0


def test_quality(spark, docs, empty):
    rows = [(i, f"| a{i} | b{i} | !!" if i % 2 else f"plain words number {i} here.", 1 - i % 2) for i in range(200)]
    labelled = spark.createDataFrame([*rows, (999, None, None)], "doc_id long, text string, label int")
    model = quality.fit(labelled, "doc_id", "text", "label", quality.QualityOptions(bits=12))
    assert model.score("| x | y | !!") < 0.3 < model.score("plain words number 5 here.")
    assert 0.0 <= model.score(None) == model.score("") <= 1.0
    assert quality.score_quality(docs, model).count() == docs.count()
    none = quality.fit(labelled.limit(0), "doc_id", "text", "label", quality.QualityOptions(bits=8))
    assert none.score("x") == 0.5 and quality.score_quality(empty, none).count() == 0


def test_vector_searches(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 8))
    x[200:260] = x[7]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (903, [1.0]), (None, rows[0][1]), (0, rows[0][1])]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    usable = vectors.usable(frame, "id", "vector")
    assert usable.count() == 300
    scaled = np.floor(256 * x)
    for function, data, k, step in (
        (lambda r, q: exact_topk.exact_top_k(r, q, 5, scale=256), scaled, 5, 50),
        # as many probes as there are cells in reach: the hashing alone finds all
        (lambda r, q: multiprobe.search(r, q, 20, multiprobe.HashOptions(probes=11**4, reach=5)), x, 20, 20),
    ):
        got = function(usable, F.col("vec_id") % step == 0).orderBy("query_id", "rank").collect()
        for i in range(0, 300, step):
            score = np.einsum("ij,j->i", data, data[i])
            score[i] = -np.inf
            best = np.lexsort((np.arange(300), -score))[:k]
            assert [r.vec_id for r in got if r.query_id == i] == best.tolist()
        assert function(usable.limit(0), F.lit(True)).count() == 0
        two = function(usable.filter("vec_id < 2"), F.col("vec_id") == 0).collect()
        assert [(r.query_id, r.vec_id) for r in two] == [(0, 1)]


@pytest.mark.parametrize("number", [500, 3000])
def test_recall_of_the_hashing(spark, number):
    """By the default rule, without any comparison with all vectors, nine of ten nearest are found at any size."""
    rng = np.random.default_rng(number)
    centres = rng.standard_normal((12, 24))
    x = centres[rng.integers(0, 12, number)] + rng.standard_normal((number, 24))
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, vector array<double>")
    found = {}
    for r in multiprobe.search(frame, F.col("vec_id") % 50 == 0, 20).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for i in range(0, number, 50):
        score = np.einsum("ij,j->i", x, x[i])
        own = sorted(found[i])
        assert [r for r, _, _ in own] == list(range(1, 21)) and i not in [v for _, v, _ in own]
        assert all(np.isclose(s, score[v]) for _, v, s in own)
        score[i] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & {v for _, v, _ in own})
    assert hits >= 0.9 * 20 * len(found) and len(found) == -(-number // 50)


def test_pipeline_on_small_rows(spark, tmp_path):
    import corpus_pipeline

    texts = [(i, passage(i % 7, i % 7 + 60), "en", "s", 1) for i in range(20)] + [
        (50, None, "en", "s", None), (51, "token: abcdefghij", "en", "s", 3), (52, "an idiot and scum, a worthless moron", "en", "s", 3),
    ]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(texts, kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {52}
    hidden = {r.doc_id: r.text for r in corpus_pipeline.hide_secrets(spark, docs, str(tmp_path)).collect()}
    assert hidden[51] == "[SECRET]" and hidden[50] is None
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {50, 51} <= {r.doc_id for r in pieces} and 52 not in {r.doc_id for r in pieces}
