import hashlib
import io
import random
import zipfile
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import components, media_chunks, suffix_dedup, warc_zip
from tessella.llm.suffix_array import suffix_array
from tests.llm.data import awkward, frame, prose

# suffix arrays


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 2), max_size=40), st.lists(st.integers(0, 300), max_size=30), st.tuples(st.lists(st.integers(0, 1), min_size=1, max_size=5), st.integers(1, 9)).map(lambda x: x[0] * x[1])))
def test_suffix_array(s):
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


# repeated passages


def brute_removal(texts, length=200):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        kept = bytes(c for c, h in zip(t, hit, strict=True) if not h)
        out.append((len(t), sum(hit), sum(1 for i in range(len(t)) if hit[i] and not (i and hit[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def passages():
    rng = random.Random(4)
    shared = [prose(rng, n) for n in (40, 60, 90)]
    rows = awkward()
    for i in range(30):
        parts = [prose(rng, rng.randint(3, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared)[rng.randint(0, 30) :], prose(rng, rng.randint(1, 40))]
        rows.append((100 + i, " ".join(parts), None, None, None))
    rows.append((200, "z" * 700, None, None, None))
    rows.append((201, "ab" * 350, None, None, None))
    return rows


@pytest.mark.parametrize("group", [1500, 2])
def test_repeats_are_removed(spark, group):
    """With a group of 2 most anchors take the way of very large groups."""
    rows = passages()
    df = frame(spark, rows, ("kept", "n_bytes", "spans"))
    found = suffix_dedup.digests(suffix_dedup.remove_repeats(df, ("doc_id",), group=group)).collect()
    want = brute_removal([(r[1] or "").encode() for r in rows])
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == sorted(
        (r[0] or 0, *w) for r, w in zip(rows, want, strict=True)
    )


@pytest.mark.parametrize(("length", "gram"), [(400, 100), (300, 10), (50, 49), (20, 1)])
def test_repeats_of_other_lengths(spark, length, gram):
    rows = passages()
    rows += [(900, rows[0][1] * 3, None, None, 0), (901, "x" * 1000, None, None, 0)]
    found = suffix_dedup.digests(suffix_dedup.remove_repeats(frame(spark, rows), ("doc_id",), length=length, gram=gram)).collect()
    want = brute_removal([(r[1] or "").encode() for r in rows], length)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == sorted(
        (r[0] or 0, *w) for r, w in zip(rows, want, strict=True)
    )


@pytest.mark.parametrize(("length", "gram"), [(100, 100), (100, 0), (70_000, 10)])
def test_lengths_that_cannot_be(spark, length, gram):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(frame(spark, []), length=length, gram=gram)


def test_repeats_text_and_empty(spark):
    rows = passages()
    out = suffix_dedup.as_text(suffix_dedup.remove_repeats(frame(spark, rows), ("doc_id", "lang"))).collect()
    assert len(out) == len(rows) and {r.text for r in out if r.doc_id in (1, 2)} == {""}
    assert not suffix_dedup.remove_repeats(frame(spark, [])).collect()


def test_anchor_blocks(monkeypatch):
    """Every window has one anchor, whatever the blocks; equal windows have anchors at the same place in them."""
    import numpy as np

    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (0, 10, 200, 900, 1500)] + [b"q" * 500]
    texts.append(texts[3][100:600] + b"!" + texts[4][:300])
    offsets = np.cumsum([0, *map(len, texts)])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    for block in (1 << 19, 300):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        where = {}
        for _, t, first, left, n in zip(*suffix_dedup.anchors(flat, offsets), strict=True):
            for w in range(n):
                assert (t, first + w) not in where
                where[t, first + w] = left - w
        assert set(where) == {(t, w) for t, x in enumerate(texts) for w in range(len(x) - 199)}
        by = {}
        for (t, w), at in where.items():
            assert by.setdefault(texts[t][w : w + 200], at) == at


# components


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5, None)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in pairs:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert found == {a: find(a) for a in list(root)}
    assert not components.components(spark.createDataFrame([], "a long, b long")).collect()


# WARC


def pages():
    big, small = "<p>" + "x" * 200, "<p>tiny"
    return [(1, "u1", big), (2, "u2", big), (3, "u3", small), (4, "u4", small), (5, None, None), (6, "u\r\n6", ""), (7, "u7", big + "é"), (8, "u8", big), (None, "u9", big)]


def test_warc_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, payload string, digest long")
    found = {r.page_id: r for r in warc_zip.round_trip(df.repartition(3)).collect()}
    assert len(found) == len(rows)
    for i, _, html in rows:
        b, r = (html or "").encode(), found[i]
        assert (r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
    assert {i: r.refers_to for i, r in found.items() if r.record_type == "revisit"} == {2: 1, 8: 1, None: 1}
    assert not warc_zip.round_trip(df.limit(0)).collect()


@pytest.mark.parametrize("always64", [False, True])
def test_zip_forms(always64):
    out = io.BytesIO()
    z = warc_zip.ZipWriter(out, always64)
    z.add("a/b", [b"hello ", b"world"])
    z.add("empty", [])
    size = z.close()
    r = warc_zip.ZipReader(io.BytesIO(out.getvalue()), size)
    assert r.read("a/b") == b"hello world" and r.read("a/b", 6, 3) == b"wor" and r.read("empty") == b""
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as std:  # the standard library reads what we write
        assert std.testzip() is None and std.read("a/b") == b"hello world"
    with pytest.raises(ValueError):
        r.read("a/b", 6, 30)
    broken = bytearray(out.getvalue())
    broken[broken.index(b"hello")] ^= 1
    with pytest.raises(ValueError):
        warc_zip.ZipReader(io.BytesIO(bytes(broken)), size).read("a/b")
    with pytest.raises(ValueError):
        warc_zip.ZipReader(io.BytesIO(b"nothing"), 7)


def test_zip_reads_foreign_archives():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("x", b"123")
        with z.open("y", "w", force_zip64=True) as f:
            f.write(b"4567")
        z.writestr("packed", b"0" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"a note"
    r = warc_zip.ZipReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert r.read("x") == b"123" and r.read("y") == b"4567"
    with pytest.raises(ValueError):
        r.read("packed")


def test_damaged_record():
    good = warc_zip.record("u", 1, b"body", "d", None, False)
    assert warc_zip.parse(good)[1] == b"body"
    for bad in (good[:-3], b"HTTP/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            warc_zip.parse(bad)


# media


def test_media_round_trip(spark):
    rows = awkward()
    found = media_chunks.round_trip(frame(spark, rows, ("feature", "media_bytes")).repartition(3)).collect()
    want, same = [], {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        full = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        want.append((i or 0, len(b), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == sorted(want)
    for r in found:
        assert same.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    assert not media_chunks.round_trip(frame(spark, [])).collect()


def test_chunks_are_shared(spark, tmp_path):
    """Equal stretches in two media are stored once, wherever they stand."""
    rng = random.Random(8)
    body = prose(rng, 4000)
    rows = [(1, body, None, None, None), (2, "prefix " + body, None, None, None)]
    stored = media_chunks.store(frame(spark, rows).coalesce(1), f"file://{tmp_path}/m")
    places = [[c["digest"] for c in r["recipe"]] for r in media_chunks.recipes(stored).collect()]
    assert len(set(places[0]) & set(places[1])) > 0.6 * len(places[0])
    built = media_chunks.rebuild(stored, f"file://{tmp_path}/m", media=True).collect()
    assert {media_chunks.from_wav(bytes(r.media))[: r.n_bytes].decode() for r in built} == {r[1] for r in rows}


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000), st.integers(1, 900))
def test_gear_cuts(data, block):
    h, m, want = 0, (1 << 64) - 1, []
    for i, c in enumerate(data):
        h = ((h << 1) + int(media_chunks.GEAR[c])) & m
        if h >> 58 == 0:
            want.append(i + 1)
    assert media_chunks.cut_places(data, 6, max(64, block)).tolist() == want
    ends = media_chunks.chunk_ends(data, 32, 256, 6)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert sum(sizes) == len(data) and all(s <= 256 for s in sizes) and all(s >= 32 for s in sizes[:-1])
