import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import bpe, packing, quality_rules, simhash, subword_classifier, toxicity_cnn, unigram_count
from tests.llm.data import SF, awkward, frame

TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\tabAB'sré.,1Σß|#"), st.characters(exclude_categories=["Cs"])), max_size=60)


# quality rules


def brute_quality(text):
    words = quality_words(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, dup = [x for x in (text or "").split("\n")], 0
    seen = set()
    for x in lines:
        if quality_words(x):
            dup += x in seen
            seen.add(x)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    base = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(hit), base


def quality_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_rules(spark):
    rows = awkward()
    found = quality_rules.evaluate(frame(spark, rows, ("kept", "n_words")), ("doc_id",)).collect()
    assert len(found) == len(rows)
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert got == sorted((r[0] or 0, *brute_quality(r[1])) for r in rows)
    by = {r.doc_id: r for r in found}
    assert by[13].kept and by[13].n_failed_lines == 1
    assert not by[14].kept and not by[4].kept
    assert not quality_rules.evaluate(frame(spark, [])).collect()


def test_line_rules():
    clean = quality_rules.clean_text("Home | News | About\nA good line of words here.\n### $$$ ***\nCopyright (c) us\nA good line of words here.")
    assert clean == "A good line of words here."


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14))
def test_repeat_words(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    assert quality_rules.repeat_words(words) == len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})


# tokenizers


@pytest.fixture(scope="module")
def word_bpe(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path("word_bpe_49k.json")), bpe.load(path("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_bpe_equals_library(word_bpe, text):
    theirs, ours = word_bpe
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert ours.encode(text) == ids
    assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_query(spark, path, word_bpe):
    rows = awkward()
    found = bpe.round_trip(frame(spark, rows, ("n_tokens",)), path("word_bpe_49k.json")).collect()
    want = []
    for i, t, *_ in rows:
        ids = word_bpe[0].encode(t or "", add_special_tokens=False).ids
        text = word_bpe[0].decode(ids, skip_special_tokens=False)
        want.append((i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(want)


def test_bpe_table_overflow(path, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    b = bpe.WordBpe(path("word_bpe_49k.json"))
    assert b.encode("one two three four five one") == bpe.load(path("word_bpe_49k.json")).encode("one two three four five one")


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_byte_bpe_equals_library(path, text):
    from tokenizers import Tokenizer

    test_byte_bpe_equals_library.t = t = getattr(test_byte_bpe_equals_library, "t", None) or Tokenizer.from_file(path("byte_bpe_50k.json"))
    assert packing.encoder(path("byte_bpe_50k.json"))(text) == t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def unigram(path):
    from tokenizers import Tokenizer, models

    vocab = unigram_count.vocabulary(path("piece_bpe_32k.model"))
    full = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)] + [(t, float(s)) for t, s in vocab]
    return Tokenizer(models.Unigram(full, unk_id=0, byte_fallback=True)), unigram_count.load(path("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_unigram_equals_library(unigram, text):
    theirs, ours = unigram
    n = len(theirs.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0
    assert ours(text)[0] == n


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=4), st.integers(-6, -1), min_size=1, max_size=12), st.text("abcd", max_size=12))
def test_unigram_ties(vocab, text):
    """Few scores, so ties abound: counts equal those of a plain search by start in the library's order."""
    c = unigram_count.Counter(sorted(vocab.items()))
    low = min(vocab.values()) - 10
    best = [(0, 0)] + [None] * len(text)
    for s in range(len(text)):
        for size in range(1, len(text) - s + 1):
            t = text[s : s + size]
            score, n = (vocab[t], 1) if t in vocab else (low, 1) if size == 1 else (None, 0)
            if score is not None and (best[s + size] is None or best[s][0] + score > best[s + size][0]):
                best[s + size] = (best[s][0] + score, best[s][1] + n)
    if text:
        assert c.solve(text) == best[-1][::-1]


def test_unigram_whole_documents(spark, path, unigram):
    """Counts and scores of whole texts are those of the library's segmentation."""
    theirs, table = unigram[0], dict(unigram_count.vocabulary(path("piece_bpe_32k.model")))
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 20000")
    found = {r.doc_id: (r.n_tokens, r.best_score) for r in unigram_count.count_tokens(docs, path("piece_bpe_32k.model")).collect()}
    low = min(table.values()) - unigram_count.UNKNOWN_PENALTY
    for r in docs.collect():
        got = theirs.encode("▁" + r.text.replace(" ", "▁"), add_special_tokens=False)
        known = [table.get(t) for t in got.tokens]
        missing = len({i for i, (k, o) in enumerate(zip(known, got.offsets, strict=True)) if k is None and (i == 0 or got.offsets[i - 1] != o)})
        assert found[r.doc_id] == (len(got.ids), sum(k for k in known if k is not None) + missing * low)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=4), st.floats(-9, -0.5), min_size=1, max_size=12), st.text("abc", max_size=14))
def test_unigram_log_probabilities(vocab, text):
    """Scores that are no whole numbers are kept: the best of all segmentations."""
    c = unigram_count.Counter(sorted(vocab.items()))
    best = [(0.0, 0)] + [None] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(e):
            t = text[s:e]
            score = vocab.get(t, c.unknown if len(t) == 1 else None)
            if score is not None and (best[e] is None or best[s][0] + score > best[e][0] + 1e-9):
                best[e] = (best[s][0] + score, best[s][1] + 1)
    assert not text or abs(c.solve(text)[1] - best[-1][0]) < 1e-6


def test_unigram_long_text_is_small(path, unigram):
    import tracemalloc

    text = "abcdefghij" * 50_000
    tracemalloc.start()
    n, _ = unigram[1](text)
    assert n > 50_000 and tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


def test_unigram_query(spark, path, unigram):
    rows = awkward()
    found = unigram_count.count_tokens(frame(spark, rows, ("best_score",)), path("piece_bpe_32k.model")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == sorted((r[0] or 0, unigram[1](r[1] or "")[0]) for r in rows)


# packing


def test_packing(spark, path):
    from tokenizers import Tokenizer

    t, rows = Tokenizer.from_file(path("byte_bpe_50k.json")), awkward()
    rows = [r for r in rows if r[0] not in (None, 10)]
    found = packing.pack(frame(spark, rows, ("start",)), path("byte_bpe_50k.json")).collect()
    ids = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows}
    cover = {i: 0 for i in ids}
    for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == cover[r.doc_id] and len(own) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        cover[r.doc_id] += r.length
    assert cover == {i: len(x) for i, x in ids.items()}
    at = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048
    assert not packing.pack(frame(spark, []), path("byte_bpe_50k.json")).collect()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=40))
def test_best_fit_decreasing(sizes):
    where, offset, opened = packing.best_fit_decreasing(np.array(sizes, np.int64), 16)
    left = []  # a plain search for the tightest window
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = [w for w in left if w >= sizes[i]]
        if fit:
            left[left.index(min(fit))] -= sizes[i]
        else:
            left.append(16 - sizes[i])
    assert opened == len(left)
    used = {}
    for w, o, s in sorted(zip(where.tolist(), offset.tolist(), sizes, strict=True)):
        assert o == used.get(w, 0)
        used[w] = o + s
    assert sorted(16 - u for u in used.values()) == sorted(left)


# classifiers


def labelled(seed, n, mark):
    rng = random.Random(seed)
    plain = ["sun", "river", "stone", "walks", "green", "under", "light", "house", "again", "tree"]
    rows = []
    for i in range(n):
        w = [rng.choice(plain) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(5, 80))]
        y = i % 3 == 0
        if y:
            w[rng.randrange(len(w))] = mark + ","
        rows.append((" ".join(w), int(y)))
    return rows


def test_toxicity_finds_held_out():
    net = toxicity_cnn.train(labelled(1, 400, "grumbleface"))
    test = labelled(2, 200, "Grumbleface")
    s = net.scorer()([t.encode() for t, _ in test])
    assert np.mean((s >= 0.3) == [bool(y) for _, y in test]) > 0.95
    again = toxicity_cnn.train(labelled(1, 400, "grumbleface")).scorer()([t.encode() for t, _ in test])
    assert np.allclose(s, again)


def test_toxicity_batches_do_not_matter():
    s = toxicity_cnn.train(labelled(1, 200, "grumbleface")).scorer()
    texts = [b"", b"x", b"grumbleface", b"sun river grumbleface", b"stone"]
    assert np.allclose(s(texts), np.concatenate([s([t]) for t in texts]))


def test_quality_classifier():
    rng = random.Random(5)
    rows = []
    for i in range(300):
        w = [rng.choice(["sun", "river", "stone", "walks"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(20, 90))]
        rows.append((" ".join(x + "$$$" * (i % 2) for x in w), i % 2))
        rows.append((" ".join(x for x in w[:8] for _ in range(6)) if i % 2 else " ".join(w), i % 2))
    net = subword_classifier.train(rows[:400])
    s = net([t.encode() for t, _ in rows[400:]])
    assert np.mean((s >= 0.5) == [bool(y) for _, y in rows[400:]]) > 0.95
    assert np.allclose(s[:20], np.concatenate([net([t.encode()]) for t, _ in rows[400:420]]))


@pytest.mark.parametrize("module", [toxicity_cnn, subword_classifier])
def test_classifiers_on_odd_tables(spark, module):
    net, rows = module.train(labelled(1, 60, "zzz")), awkward()
    found = module.score(frame(spark, rows, ("score", "predicted")), net).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    blank = module.train([])
    assert {r.score < 0.01 for r in module.score(frame(spark, rows), blank).collect()} == {True}
    assert not module.score(frame(spark, []), net).collect()


# SimHash


def brute_components(prints, radius=4):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_fingerprint():
    import xxhash

    words = "A b c D e f g".lower().encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 4)
    assert simhash.fingerprint(b"A b  c D\ne f g", 4) == want
    assert simhash.fingerprint(b" \n", 4) == 0
    assert simhash.fingerprint(b"One two", 4) == xxhash.xxh64_intdigest(b"one two", 42)


def test_near_duplicates(spark):
    rows = awkward()
    found = simhash.near_duplicates(frame(spark, rows, ("component_id", "fingerprint"))).collect()
    prints = [simhash.fingerprint((r[1] or "").encode(), 4) for r in rows]
    group = brute_components(prints)
    least = {}
    for r, g in zip(rows, group, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = sorted((r[0] or 0, f"{p:016x}", least.get(g) or 0) for r, p, g in zip(rows, prints, group, strict=True))
    assert sorted((r.doc_id or 0, r.fingerprint, r.component_id or 0) for r in found) == want
    assert not simhash.near_duplicates(frame(spark, [])).collect()


@pytest.mark.parametrize("tile", [4096, 8])
def test_links_connect_what_is_near(spark, tile):
    """Clusters around a few centres, larger than a small tile, so tiles are cut and paired."""
    rng = random.Random(9)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            p = centre
            for _ in range(rng.randint(0, 4)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, tile).collect()
    at = {p: i for i, p in enumerate(signed)}
    assert all((prints[at[r.x]] ^ prints[at[r.y]]).bit_count() <= 4 for r in found)
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for r in found:
        x, y = find(at[r.x]), find(at[r.y])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(prints))] == brute_components(prints)


def test_keep_one(spark):
    rows = awkward()
    kept = simhash.keep_one(frame(spark, rows)).collect()
    prints = [simhash.fingerprint((r[1] or "").encode(), 4) for r in rows]
    assert len(kept) == len(set(brute_components(prints)))
    ids = [r.doc_id for r in kept]
    assert 1 in ids and 2 not in ids and ids.count(10) == 1
    assert set(kept[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_empty_tables(spark, path):
    none = frame(spark, [], ("n_tokens", "score"))
    assert not unigram_count.count_tokens(none, path("piece_bpe_32k.model")).collect()
    assert not bpe.round_trip(none, path("word_bpe_49k.json")).collect()
    assert not subword_classifier.score(none, subword_classifier.train([])).collect()
    assert not toxicity_cnn.score(none, toxicity_cnn.train([])).collect()
