"""BPE with word ends: encode and decode by batched numpy merge rounds.

The distinct new words of a batch lie in one flat symbol array. A round looks up every adjacent pair among the
sorted pair keys (binary search), takes each word's lowest rank, and merges its occurrences from the left; words
without a known pair are done. Word results are kept in a bounded table per task, so a frequent word merges once.

Defined results: null text is empty; an empty text has no ids and decodes to ""; a very long text is encoded whole (its
words are distinct symbols' runs, so room grows with the text, not with its merges); repeated rows each give a row; an
empty table gives an empty one; columns that share a result's name are replaced, others are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, pre_tokenizers

from tessella.llm.common import as_text, map_text, resident
from tessella.llm.packing import byte_symbols

#: Words whose ids a task remembers; the table is emptied when full.
KNOWN_WORDS = 150_000
NONE = np.iinfo(np.int64).max


class WordBpe:
    """A tokenizers file: NFC, white space to one space, lower case; split by its pattern; byte symbols with a word end.

    Texts with characters beyond the common Latin ones are folded and split by the library, whose Unicode tables count.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        suffix = model["end_of_word_suffix"] or ""
        names = {b: c for c, b in byte_symbols().items()}
        self.plain = np.array([vocab[names[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[names[b] + suffix] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys, first = np.unique(keys, return_index=True)  # a pair given twice counts as it first stands
        self.keys, self.rank, self.made = keys, first.astype(np.int64), made[first]
        self.by_rank = np.zeros(len(merges), np.int64)
        self.by_rank[first] = made[first]
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # beyond these letters, Unicode tables of another age would class or fold some characters otherwise
        self.rare = regex.compile("[^\u0000-\u024f\u2010-\u2027\u20ac]")
        self.theirs = Tokenizer.from_file(path).normalizer
        self.cut = pre_tokenizers.Split(Regex(self.split.pattern), "removed", invert=True)
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.known: dict[str, tuple[int, str, str]] = {}

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and where each word starts (one more at the end)."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), sizes)
        sym = self.plain[raw]
        tail = np.cumsum(sizes) - 1
        sym[tail] = self.last[raw[tail]]
        done_sym, done_word = [], []
        while len(sym):
            pair = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (word[:-1] == word[1:]), self.rank[at], NONE)
            rank = np.append(rank, NONE)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            count = np.diff(np.append(starts, len(word)))
            live = np.repeat(best != NONE, count)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
            lowest = np.repeat(best, count)
            hit = live & (rank == lowest)
            # overlapping hits (a a a): of each run, every other one from the left
            idx = np.flatnonzero(hit)
            if len(idx):
                run = np.flatnonzero(np.append(True, np.diff(idx) != 1))
                order = np.arange(len(idx)) - np.repeat(run, np.diff(np.append(run, len(idx))))
                idx = idx[order % 2 == 0]
                sym[idx] = self.by_rank[rank[idx]]
                live[idx + 1] = False
            sym, word = sym[live], word[live]
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def pieces(self, text: str) -> list[str]:
        """Special tokens and words of the text, in order; a special token stands as it is."""
        out: list[str] = []
        at = 0
        for m in self.marks.finditer(text) if self.marks else ():
            out += self.words(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.words(text[at:])

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        if text.isascii():
            text = text.lower()
        elif self.rare.search(text):
            return [w for w, _ in self.cut.pre_tokenize_str(self.theirs.normalize_str(text))]
        else:
            text = unicodedata.normalize("NFC", text).lower()
        # white space separates words wherever it stands, and no word holds any; runs need no rewriting here
        return self.split.findall(text)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
            new = list(words)
        for i in range(0, len(new), 50_000):
            some = new[i : i + 50_000]
            usual = [w for w in some if w not in self.special]
            ids, at = self.merge_words([w.encode() for w in usual])
            flat, bounds = ids.tolist(), at.tolist()
            for k, w in enumerate(usual):
                own = flat[bounds[k] : bounds[k + 1]]
                self.known[w] = (len(own), " ".join(map(str, own)), " ".join(self.text_of[x] for x in own))
            for w in some:
                if w in self.special:
                    self.known[w] = (1, str(self.special[w]), w)

    def encode_all(self, texts: list[str]) -> list[list[tuple[int, str, str]]]:
        """For each text its words' (number of ids, ids as text, decoded text)."""
        split = [self.pieces(t) for t in texts]
        self.learn({w for words in split for w in words})
        return [[self.known[w] for w in words] for words in split]

    def encode(self, text: str) -> list[int]:
        return [int(i) for n, ids, _ in self.encode_all([text])[0] if n for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by a space, word ends and byte symbols as they are."""
        return " ".join(self.text_of[i] for i in ids if i in self.text_of)


def load(path: str) -> WordBpe:
    return resident(("word-bpe", path), lambda: WordBpe(path))


def round_trip(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Number and digest of each text's ids, and the digest of what they decode to."""

    def make() -> Callable[[pa.Array], list]:
        bpe = load(path)

        def run(col: pa.Array) -> list:
            counts, ids, texts = [], [], []
            for words in bpe.encode_all(as_text(col)):
                counts.append(sum(w[0] for w in words))
                ids.append(hashlib.sha256(" ".join([w[1] for w in words]).encode()).hexdigest())
                texts.append(hashlib.sha256(" ".join([w[2] for w in words]).encode()).hexdigest())
            return [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]

        return run

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return map_text(docs, make, fields, list(keep))
