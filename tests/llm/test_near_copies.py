"""The pipeline's near-duplicates stage against all pairs compared by whole shingle sets."""

import random
from itertools import combinations

import numpy as np
import pytest

from tessella.llm import shingle_sets, simhash
from tests.llm.data import SF, awkward, frame, prose


def brute_least(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().encode().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
    return group


def copies(seed=7):
    """Texts with copies in which a few words differ, on both sides of the similarity 0.8, and a chain."""
    rng, texts = random.Random(seed), []
    for n in (60, 100, 150, 300):
        base = prose(rng, n).split()
        for changed in (0, 1, n // 60, n // 45, n // 20):
            words = list(base)
            for i in rng.sample(range(n), changed):
                words[i] = f"new{rng.randint(0, 10**9)}"
            texts.append(" ".join(words))
    for _ in range(6):
        words = texts[-1].split()
        words[rng.randrange(len(words))] = "link"
        texts.append(" ".join(words))
    return texts


def test_near_duplicates_stage(spark):
    import corpus_pipeline

    texts = copies()
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    group = brute_least(texts)
    want = {i for i, g in enumerate(group) if g == i}
    assert len(want) < len(texts)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), SF).collect()} == want
    # four bits of a fingerprint leave some of these copies
    assert {r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()} - want


def test_near_duplicates_stage_on_odd_rows(spark):
    import corpus_pipeline

    rows = awkward()
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, rows), SF).collect()
    assert len(kept) == len(set(brute_least([r[1] for r in rows])))
    ids = [r.doc_id for r in kept]
    assert 1 in ids and 2 not in ids and ids.count(10) == 1 and 4 in ids and 5 not in ids


@pytest.mark.parametrize("tile", [4, 4096])
def test_large_groups_in_tiles(spark, tile):
    """Groups larger than a tile: copies of one text that are alike, and others that share a band but stay apart."""
    rng, texts = random.Random(5), []
    base = prose(rng, 120).split()
    for changed in [1] * 25 + [3] * 25 + [6] * 20:
        words = list(base)
        for i in rng.sample(range(len(words)), changed):
            words[i] = f"w{rng.randint(0, 10**9)}"
        texts.append(" ".join(words))
    texts += [prose(rng, 80) for _ in range(10)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    kept = simhash.keep_one(frame(spark, rows), shingle=5, similarity=0.8, tile=tile).collect()
    want = {i for i, g in enumerate(brute_least(texts)) if g == i}
    assert 11 < len(want) < len(texts) and {r.doc_id for r in kept} == want


def test_postings_equal_pairwise():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 0, 5, 40, 41, 42, 60)]
    index, every = shingle_sets.Postings(sets), np.arange(len(sets))
    for i, a in enumerate(sets):
        assert index.similar(i, every, 0.5).tolist() == [shingle_sets.similar(a, b, 0.5) for b in sets]


def test_buckets_bring_near_fingerprints_together():
    """Any two within the radius agree in a bucket, whatever number of fingerprints the buckets are made for."""
    rng = np.random.default_rng(8)
    for n in (10, 5000, 10**6, 10**8, 10**10, 10**12):
        m, bits = simhash.choice(n, 4, 4096)
        a = rng.integers(0, 1 << 63, 200, np.uint64)
        b = a.copy()
        for _ in range(4):
            b ^= np.uint64(1) << rng.integers(0, 64, 200, np.uint64)
        met = np.array([x == y for x, y in zip(simhash.bucket_keys(a, 4, m, bits), simhash.bucket_keys(b, 4, m, bits), strict=True)])
        assert met.any(axis=0).all()
