"""Toxicity: a convolutional text classifier in numpy.

Words (lower case, letters, digits and bytes above 127) are hashed to 2**BITS buckets, and their first PREFIX bytes to as
many; buckets that enough texts of the sample hold have an embedding each, all others share one. A word is embedded as the
sum of both. Filters of several widths slide over whole documents, each filter keeps its maximum, and a softmax layer reads the maxima. Training is Adagrad on mini-batches;
only the places of the maxima carry gradient, so an update touches few embeddings. Thresholds are then calibrated on texts
held back from training, one for each language, drawn towards that of all texts the fewer texts of the rarer class the
language has; the language is guessed from the text's own function words, and texts without any are one more language.
A score is moved along its logit so that each language's threshold stands at THRESHOLD.

For scoring, embeddings times filters are folded into a table per width and offset: a window is a sum of looked-up rows.

Bound of the sample it learns from: MAX_PER_CLASS labelled texts of each class, in the order of a hash of doc_id, one text
of up to common.SAMPLE_TEXT_BYTES a document.

Defined results: null or empty text is scored as one blank word; a very long text is scored whole; repeated rows each give
a row, and a doc_id repeated in `documents` or `labels` counts once in the sample; an empty table gives an empty one;
without labels of both classes every score is the constant 0; columns that share a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.llm.common import as_bytes, map_text
from tessella.llm.hashing import joined, mix, word_hashes

BITS, DIM, FILTERS, WIDTHS, PREFIX, LEAST_TEXTS = 21, 12, 8, (1, 2, 3), 4, 5
#: Updates that training makes at least, over however few texts.
LEAST_STEPS = 250
#: Text bytes scored at once: a window's filters take some ten times their words' room.
SCORE_BYTES = 1 << 19
#: Embedding rows: no word, and words without a row of their own.
NONE, RARE = 0, 1
THRESHOLD, MAX_PER_CLASS = 0.3, 1500
#: Texts of the rarer class that a language's own threshold weighs as much as the common one.
SHRINK = 10
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on with as by from are this be at or an not have which",
    "de": "der die und das ist den von zu mit sich des auf für nicht ein eine dem im auch als es wird",
    "fr": "le la les des et en du une est que pour dans qui sur pas au par plus avec ce il sont aux",
    "es": "el los las y en que del se por con una para es su al lo como más pero sus le ya",
}
_FOLD = np.full(256, 32, np.uint8)
for _c in range(256):
    if 48 <= _c < 58 or 97 <= _c < 123 or _c > 127:
        _FOLD[_c] = _c
    elif 65 <= _c < 91:
        _FOLD[_c] = _c + 32


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its prefix (two rows) with max(WIDTHS) - 1 blanks (zeros) after each text, and where each text starts (and the end).

    A text without words is a blank of its own.
    """
    b, at = joined(texts)
    b = _FOLD[b]
    h, start = word_hashes(b, b == 32)
    ids = np.stack([mix(h, BITS), mix(word_hashes(b, b == 32, PREFIX)[0], BITS)])
    ids = np.maximum(ids, 1)
    ids[1] += 1 << BITS
    own = np.searchsorted(at, start, "right") - 1
    count = np.bincount(own, minlength=len(texts))
    pad = max(WIDTHS) - 1
    size = np.maximum(count, 1) + pad
    begin = np.cumsum(size) - size
    out = np.zeros((2, int(size.sum())), np.int64)
    first = np.cumsum(count) - count
    out[:, begin[own] + np.arange(len(start)) - first[own]] = ids
    return out, np.append(begin, out.shape[1])


def windows(begin: np.ndarray) -> np.ndarray:
    """Whether a window starts at each place: at every word (or the blank one), not at the zeros after a text."""
    ok = np.ones(int(begin[-1]), bool)
    for k in range(1, max(WIDTHS)):
        ok[begin[1:] - k] = False
    return ok


@lru_cache(maxsize=1)
def _function_words() -> list[np.ndarray]:
    return [np.unique(mix(word_hashes(*_folded(text))[0], BITS)) for text in FUNCTION_WORDS.values()]


def _folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    b = _FOLD[np.frombuffer(text.encode(), np.uint8)]
    return b, b == 32


def languages(ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Guess of each text's language: 0 none, then the order of FUNCTION_WORDS."""
    n = len(begin) - 1
    score = np.zeros((n, len(FUNCTION_WORDS) + 1))
    for k, known in enumerate(_function_words(), 1):
        score[:, k] = np.add.reduceat(known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids, begin[:-1], dtype=np.int64)
    return np.where(score.max(axis=1) > 0, score.argmax(axis=1), 0)


@dataclass
class Cnn:
    known: np.ndarray  # buckets that have a row of their own, which stand in this order after RARE
    emb: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    cut: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS) + 1))
    blank: bool = False

    def rows(self) -> np.ndarray:
        """Embedding row of each bucket."""
        row = np.full(2 << BITS, RARE, np.int32)
        row[0] = NONE
        row[self.known] = np.arange(len(self.known)) + RARE + 1
        return row

    def tables(self) -> dict[int, list[np.ndarray]]:
        return {w: [np.ascontiguousarray(self.emb @ f[j]) for j in range(w)] for w, f in self.filters.items()}

    def logits(self, ids: np.ndarray, begin: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """ids: embedding rows of words and of prefixes."""
        ok, tops = windows(begin), []
        for w, parts in tables.items():
            conv = parts[0][ids[0]] + parts[0][ids[1]]
            for j in range(1, w):
                conv[:-j] += parts[j][ids[0, j:]] + parts[j][ids[1, j:]]
            conv[~ok] = -np.inf
            tops.append(np.maximum.reduceat(conv, begin[:-1], axis=0))
        h = np.maximum(np.concatenate(tops, axis=1) + self.bias, 0)
        z = h @ self.out + self.out_bias
        return z[:, 1] - z[:, 0]

    def scorer(self) -> Callable[[list[bytes]], np.ndarray]:
        tables, row = ({}, None) if self.blank else (self.tables(), self.rows())

        def run(texts: list[bytes]) -> np.ndarray:
            if self.blank or not texts:
                return np.zeros(len(texts))
            ids, begin = words(texts)
            z = self.logits(row[ids], begin, tables) - self.cut[languages(ids[0], begin)] + np.log(THRESHOLD / (1 - THRESHOLD))
            return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

        return run


def _batches(texts: list[bytes], order: np.ndarray, size: int):
    for i in range(0, len(order), size):
        yield order[i : i + size], [texts[k] for k in order[i : i + size]]


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The logit that best parts the classes (rate of hits less rate of false alarms), midway between its neighbours."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    gain = np.cumsum(np.where(y == 0, 1 / max(1, (y == 0).sum()), -1 / max(1, (y == 1).sum())))
    gain = np.append(0.0, gain)
    top = np.flatnonzero(gain >= gain.max() - 1e-12)
    k = int(top[len(top) // 2])
    if k == 0:
        return float(z[0]) - 1
    return float(z[-1]) + 1 if k == len(z) else float(z[k - 1] + z[k]) / 2


def known_buckets(parsed: list[tuple[np.ndarray, np.ndarray]], least: int) -> np.ndarray:
    """Buckets that at least `least` texts hold."""
    held = np.concatenate([np.unique(ids) for ids, _ in parsed])
    bucket, count = np.unique(held, return_counts=True)
    return bucket[(count >= least) & (bucket > 0)]


def train(sample: list[tuple[str, int]], epochs: int = 8, batch: int = 32, rate: float = 0.1, seed: int = 7) -> Cnn:
    rng = np.random.default_rng(seed)
    texts, y = [t.encode() for t, _ in sample], np.array([c for _, c in sample], np.int64)
    parsed = [words([t]) for t in texts]
    n_out = FILTERS * len(WIDTHS)
    known = known_buckets(parsed, min(LEAST_TEXTS, 2 + len(y) // 200)) if texts else np.zeros(0, np.int64)
    n_rows = len(known) + RARE + 1
    net = Cnn(
        known,
        rng.normal(0, 0.1, (n_rows, DIM)).astype(np.float32),
        {w: rng.normal(0, 0.4 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(n_out, np.float32),
        np.stack([rng.uniform(-0.4, 0, n_out), rng.uniform(0, 0.4, n_out)], axis=1).astype(np.float32),
        np.zeros(2, np.float32),
    )
    net.emb[NONE] = 0
    if len(set(y.tolist())) < 2:
        net.blank = True
        return net
    held = rng.random(len(y)) < 0.2
    for c in (0, 1):  # both classes on both sides
        own = np.flatnonzero(y == c)
        if len(own) > 1:
            held[own[0]], held[own[1]] = False, True
        else:
            held[own] = False
    learn = np.flatnonzero(~held)
    weight = np.where(y == 1, len(learn) / (2 * max(1, (y[learn] == 1).sum())), len(learn) / (2 * max(1, (y[learn] == 0).sum())))
    row = net.rows()
    ranked = [row[ids] for ids, _ in parsed]
    sums = {k: np.full(v.shape, 1e-2, np.float32) for k, v in (("b", net.bias), ("o", net.out), ("ob", net.out_bias))}
    fsum = {w: np.full(f.shape, 1e-2, np.float32) for w, f in net.filters.items()}
    esum = np.full(n_rows, 1e-2, np.float32)

    def step(x: np.ndarray, s: np.ndarray, g: np.ndarray) -> None:
        s += g * g
        x -= (rate * g / np.sqrt(s)).astype(np.float32)

    for _ in range(max(epochs, LEAST_STEPS * batch // max(1, len(learn)))):
        order = rng.permutation(learn)
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            ids = np.concatenate([ranked[k] for k in some], axis=1)
            begin = np.cumsum([0, *(ranked[k].shape[1] for k in some)])
            ok, e = windows(begin), net.emb[ids[0]] + net.emb[ids[1]]
            tops, places = [], []
            for w, f in net.filters.items():
                conv = e @ f[0]
                for j in range(1, w):
                    conv[:-j] += e[j:] @ f[j]
                conv[~ok] = -np.inf
                place = np.stack([a + conv[a:b].argmax(axis=0) for a, b in zip(begin[:-1], begin[1:], strict=True)])
                tops.append(np.take_along_axis(conv, place, axis=0))
                places.append(place)
            h = np.maximum(np.concatenate(tops, axis=1) + net.bias, 0)
            z = h @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p *= (weight[some] / len(some))[:, None]
            dh = (p @ net.out.T) * (h > 0)
            step(net.out, sums["o"], h.T @ p)
            step(net.out_bias, sums["ob"], p.sum(axis=0))
            step(net.bias, sums["b"], dh.sum(axis=0))
            touched, grads = [], []
            for k, w in enumerate(WIDTHS):
                g = dh[:, k * FILTERS : (k + 1) * FILTERS]
                df = np.zeros_like(net.filters[w])
                for j in range(w):
                    at = places[k] + j
                    rows = e[at]  # text, filter, dim
                    df[j] = np.einsum("bf,bfd->df", g, rows)
                    grad = (g[:, :, None] * net.filters[w][j].T[None]).reshape(-1, DIM)
                    touched += [ids[0][at].ravel(), ids[1][at].ravel()]
                    grads += [grad, grad]
                step(net.filters[w], fsum[w], df)
            touched, grads = np.concatenate(touched), np.concatenate(grads)
            live = (touched > NONE) & (np.abs(grads).sum(axis=1) > 0)
            rows, back = np.unique(touched[live], return_inverse=True)
            total = np.zeros((len(rows), DIM), np.float32)
            np.add.at(total, back, grads[live])
            esum[rows] += (total * total).mean(axis=1)
            net.emb[rows] -= rate * total / np.sqrt(esum[rows])[:, None]
    tables, z, lang = net.tables(), np.zeros(len(y)), np.zeros(len(y), np.int64)
    check = np.flatnonzero(held)
    for some, part in _batches(texts, check, 64):
        ids, begin = words(part)
        z[some], lang[some] = net.logits(row[ids], begin, tables), languages(ids[0], begin)
    net.cut[:] = best_cut(z[check], y[check])
    for k in range(len(net.cut)):
        own = check[lang[check] == k]
        n = int(min((y[own] == 1).sum(), (y[own] == 0).sum()))
        if n:
            net.cut[k] += (best_cut(z[own], y[own]) - net.cut[k]) * n / (n + SHRINK)
    return net


def score(docs: DataFrame, net: Cnn, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """score and predicted beside the `keep` columns. The network is of fixed size and travels with the function."""

    def make() -> Callable[[pa.Array], list]:
        run = net.scorer()

        def one(col: pa.Array) -> list:
            s = run(as_bytes(col))
            return [pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]

        return one

    return map_text(docs, make, [("score", T.DoubleType()), ("predicted", T.IntegerType())], list(keep), limit=SCORE_BYTES)
