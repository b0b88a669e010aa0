"""Token packing: overlong documents are cut into full windows, the rest fills windows best-fit decreasing.

Each input partition packs its own pieces, so nothing is shuffled and no key can be hot. The open
windows' remaining capacities index a segment tree; a piece goes to the tightest window that holds it.

So padding depends on how the table is split: a partition leaves some windows partly filled, each ROUND pieces of it
again. Of whole tables the share of padding is in the README.

Defined results: null or empty text is the end id alone (one piece of one token); repeated rows are packed
one by one; equal lengths keep their row order; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.llm.common import as_text, one_thread, resident, slices, small_batches, tidy

WINDOW, END_ID = 2048, 1
#: Pieces that one round of packing holds; a partition with more starts a new round.
ROUND = 1 << 18


class CapacityTree:
    """Segment tree over remaining capacities 0..size: is there an open window with at least c left, and the least such."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.full = [False] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(self.leaves)]

    def push(self, capacity: int, window: int) -> None:
        self.at[capacity].append(window)
        node = capacity + self.leaves
        while node and not self.full[node]:
            self.full[node] = True
            node >>= 1

    def pop(self, capacity: int) -> int:
        window = self.at[capacity].pop()
        if not self.at[capacity]:
            node = capacity + self.leaves
            self.full[node] = False
            node >>= 1
            while node and not (self.full[2 * node] or self.full[2 * node + 1]):
                self.full[node] = False
                node >>= 1
        return window

    def tightest(self, need: int) -> int:
        """The least capacity >= need with an open window, or -1."""
        node = need + self.leaves
        if self.full[node]:
            return need
        while node > 1:
            if not node & 1 and self.full[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.full[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Window number and offset of each piece (lengths 1..window), and how many windows were opened."""
    tree, opened = CapacityTree(window), 0
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        have = tree.tightest(need)
        if have < 0:
            have, number = window, opened
            opened += 1
        else:
            number = tree.pop(have)
        where[i], offset[i] = number, window - have
        if have > need:
            tree.push(have - need, number)
    return where, offset, opened


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, other bytes for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Encoder:
    """ids as the tokenizers library gives for a byte-level file.

    Ids in that file follow merge order, so an id is its rank and tiktoken gives the same ids, faster. Texts with
    characters beyond the common Latin ones go to the library itself, whose Unicode tables count.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(symbols[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
        # the byte-level pre-tokenizer's pattern
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.path, self.slow = path, None
        self.rare = re.compile("[^\u0000-\u024f\u2010-\u2027\u20ac]")

    def __call__(self, text: str) -> list[int]:
        if not text.isascii() and self.rare.search(text):
            if self.slow is None:  # read when first needed
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
                self.slow.no_truncation()
                self.slow.no_padding()
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special=self.special)


def encoder(path: str) -> Encoder:
    return resident(("byte-bpe", path), lambda: Encoder(path))


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document: where it starts, and its place in a window of `window` tokens."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        one_thread()
        out, enc = to_arrow_schema(schema), encoder(path)
        base, used = TaskContext.get().partitionId() << 33, 0
        held: list[tuple] = []

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(out)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

        def close() -> pa.RecordBatch:
            nonlocal used
            where, offset, opened = best_fit_decreasing(np.array([p[2] for p in held], np.int64), window)
            rows = [(*p, base + used + w, o) for p, w, o in zip(held, where.tolist(), offset.tolist(), strict=True)]
            used += opened
            held.clear()
            return emit(rows)

        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), as_text(part.column(1)), strict=True):
                    ids = enc(text)
                    ids.append(end_id)
                    raw, n = memoryview(np.array(ids, "<u4").tobytes()), len(ids)
                    for start in range(0, n, window):
                        size = min(window, n - start)
                        piece = (doc, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), n)
                        if size == window:
                            rows.append((*piece, base + used, 0))
                            used += 1
                        else:
                            held.append(piece)
                if rows:
                    yield emit(rows)
                if len(held) >= ROUND:
                    yield close()
        if held:
            yield close()
        tidy()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, schema)
