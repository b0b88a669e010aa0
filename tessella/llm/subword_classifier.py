"""Quality classifier: learned subword vectors averaged per document.

Features of a whole text, hashed to vectors: its words as they stand, pairs of neighbouring words, differences of
neighbours' hashes (a word beside itself is one feature, whatever the word: without it the held-out AUC on check_s is
0.938, with it 1.000), and runs of 3 and of 5 characters (code points) with white space as one kind. The vectors are averaged
within each family, so that a family with more features doesn't drown the others, the averages summed, and a softmax layer
reads the sum; both are trained by stochastic gradient descent, one text at a time. Since all of it is linear, a
trained network is folded into one number per feature for scoring.

Bound of the sample it learns from: MAX_PER_CLASS labelled texts of each class, in the order of a hash of doc_id, one text
of up to common.SAMPLE_TEXT_BYTES a document.

Defined results: null or empty text has no features and is scored by the bias alone; a very long text is scored whole;
repeated rows each give a row, and a doc_id repeated in `documents` or `labels` counts once in the sample; an empty table
gives an empty one; without labels of both classes every score is the share of class 1 (0 without labels); columns that
share a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.llm.common import as_bytes, map_text
from tessella.llm.hashing import joined, mix, word_hashes

BITS, DIM = 16, 16
RUNS = (3, 5)
FAMILIES = 3 + len(RUNS)
_ODD = np.uint64(0x9E3779B97F4A7C15)
THRESHOLD, MAX_PER_CLASS = 0.3, 1500
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[9:14] = 32


def features(texts: list[bytes]):
    """Per family: (bucket numbers, where each text's begin, where they end)."""
    b, at = joined(texts)
    b = _PLAIN[b]
    h, start = word_hashes(b, b == 32)
    first = np.searchsorted(start, at)
    yield mix(h, BITS), first[:-1], first[1:]
    for pair in (h[:-1] * _ODD + h[1:], h[:-1] - h[1:]):  # which two words; how they differ: a repeat is 0, whatever the word
        begin = np.minimum(first[:-1], len(pair))
        yield mix(pair, BITS), begin, np.maximum(begin, first[1:] - 1)
    lead = (b & 0xC0) != 0x80  # one place per character
    spot = np.concatenate(([0], np.cumsum(lead)))[at]
    c = np.frombuffer(b.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    for n in RUNS:
        packed = np.zeros(max(0, len(c) - n + 1), np.uint64)
        for k in range(n):
            packed = packed * _ODD + c[k : len(c) - n + 1 + k]
        size = np.maximum(spot[1:] - 1 - spot[:-1] - n + 1, 0)
        begin = np.minimum(spot[:-1], len(packed))
        yield mix(packed, BITS), begin, begin + size


@dataclass
class Folded:
    """One number per feature and a bias: the log odds of class 1."""

    weight: np.ndarray
    bias: float

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for k, (ids, begin, end) in enumerate(features(texts)):
            total = np.append(0.0, np.cumsum(self.weight[k][ids], dtype=np.float64))
            z += (total[end] - total[begin]) / np.maximum(end - begin, 1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _parsed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct features and their weights in the sum of averages."""
    ids, weights = [], []
    for k, (found, begin, end) in enumerate(features([text])):
        own, count = np.unique(found[int(begin[0]) : int(end[0])], return_counts=True)
        ids.append(own + (k << BITS))
        weights.append(count / max(1, count.sum()))
    return np.concatenate(ids).astype(np.int32), np.concatenate(weights).astype(np.float32)


def train(sample: list[tuple[str, int]], epochs: int = 6, rate: float = 0.5, seed: int = 11) -> Folded:
    y = np.array([c for _, c in sample], np.int64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Folded(np.zeros((FAMILIES, 1 << BITS)), 50.0 if share == 1 else -50.0)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / np.sqrt(DIM), (FAMILIES << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    parsed = [_parsed(t.encode()) for t, _ in sample]
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            ids, w = parsed[i]
            pace = rate * (1 - done / steps)
            done += 1
            rows = emb[ids]
            h = w @ rows
            z = h @ out + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y[i]] -= 1
            g *= weight[i]
            back = out @ g
            out -= pace * np.outer(h, g)
            bias -= 0.1 * pace * g
            # a text's weights sum to one per family: the step is scaled so that its average moves by `pace`
            emb[ids] = rows - (pace / max(1e-6, float(w @ w))) * 0.1 * np.outer(w, back)
    part = out[:, 1] - out[:, 0]
    return Folded((emb @ part).reshape(FAMILIES, 1 << BITS).astype(np.float32), float(bias[1] - bias[0]))


def score(docs: DataFrame, net: Folded, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """score and predicted beside the `keep` columns."""

    def make() -> Callable[[pa.Array], list]:
        def one(col: pa.Array) -> list:
            texts = as_bytes(col)
            s = np.zeros(len(texts))
            i = 0
            while i < len(texts):  # about a megabyte at once
                j, held = i, 0
                while j < len(texts) and (j == i or held < 1 << 20):
                    held += len(texts[j])
                    j += 1
                s[i:j] = net(texts[i:j])
                i = j
            return [pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]

        return one

    return map_text(docs, make, [("score", T.DoubleType()), ("predicted", T.IntegerType())], list(keep))
