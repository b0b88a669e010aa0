"""Exact repeated passages: every byte under a string of `length` bytes that also starts elsewhere is removed.

1. Each `length`-byte window belongs to its anchor, the leftmost least hash among its `gram`-byte strings. Equal windows
   have equal anchors, so a window can only repeat among the windows of equal anchors. An anchor that occurs once in
   the corpus settles all its windows.
2. Windows of one anchor are neighbours: a region. Equal regions are counted before they are shuffled; a region that
   occurs twice repeats whole.
3. The distinct regions of one anchor go to one suffix array (suffix_array.py) with the shared gram as a single symbol;
   neighbours in it that agree over a whole window repeat. An anchor with over GROUP distinct regions (a very common
   passage within as many contexts) would be one array in one task that grows with the corpus; its windows are counted by
   128-bit digests over all tasks instead, with the same result (README gives the share).
4. The repeated runs return to their documents, where they are merged and cut out.

Texts are shuffled compressed, and only to meet their regions and, in the end, their runs.

A row is known by 96 bits of hashes of its kept columns and text (equal rows share them and have equal results): at 10**10
documents a chance meeting of two is below one in 10**8. (64 of them lead to its anchors: rows that share those by chance
are cut into more regions than they need.) Shared strings are known by 96 bits, regions by 64 more among those of one.

Defined results: null text is empty and keeps nothing; texts under `length` bytes keep all; a very long text is read whole,
in blocks (up to 2**31 bytes, Spark's own limit); repeated rows are texts of their own, so they remove each other; an empty
table gives an empty one; kept columns named as a result are replaced, other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import apart, as_bytes, discard, release, slices, small_batches, tidy, written
from tessella.llm.suffix_array import suffix_array

LENGTH, GRAM, GROUP = 200, 100, 1500
_LOW = (1 << 64) - 1
#: Symbols of a suffix array beside bytes: a region's end, and the gram.
_END, _GRAM = np.array([0], np.uint16), np.array([1], np.uint16)
#: Windows handled at once when anchors are sought.
BLOCK = 1 << 19
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x2545F4914F6CDD1D))


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each `gram` consecutive bytes, by doubling."""
    h, p, s = b.astype(np.uint64) + np.uint64(1), _A, 1
    with np.errstate(over="ignore"):
        while 2 * s <= gram:
            h = h[:-s] * p + h[s:]
            p, s = p * p, 2 * s
        if s < gram:
            h = h[: len(h) - (gram - s)] * _C + h[gram - s :]
        h ^= h >> np.uint64(29)
        h *= _B
        h ^= h >> np.uint64(32)
    return h


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values, by doubling."""
    m, s = h, 1
    while 2 * s <= width:
        m, s = np.minimum(m[:-s], m[s:]), 2 * s
    return np.minimum(m[: len(m) - (width - s)], m[width - s :]) if s < width else m


def anchors(b: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows by anchor, over texts laid end to end: (hash, text, first window, anchor - first, windows).

    offsets: where each text starts, and the end. A run never leaves its text.
    """
    width = length - gram + 1
    found: list[tuple[np.ndarray, ...]] = []
    texts = np.flatnonzero(np.diff(offsets) >= length)
    if not len(texts):
        return tuple(np.zeros(0, t) for t in (np.uint64, *[np.int64] * 4))
    first, last = offsets[texts], offsets[texts + 1] - length  # first and last window of each text
    for lo in range(0, len(b) - length + 1, BLOCK):
        hi = min(lo + BLOCK, len(b) - length + 1)
        h = gram_hashes(b[lo : hi + length - 1], gram)
        m = least_of(h, width)
        new = np.append(True, m[1:] != m[:-1])
        a, z = int(np.searchsorted(last, lo)), int(np.searchsorted(first, hi))
        f, e = np.maximum(first[a:z], lo) - lo, np.minimum(last[a:z], hi - 1) - lo
        if not len(f):
            continue
        inside = np.zeros(hi - lo + 1, np.int64)
        np.add.at(inside, f, 1)
        np.add.at(inside, e + 1, -1)
        new[f] = True
        start = np.flatnonzero(new & (np.cumsum(inside[:-1]) > 0))
        own = np.searchsorted(f, start, "right") - 1
        stop = np.minimum(np.append(start[1:] - 1, hi - lo - 1), e[own])
        pos = np.empty(len(start), np.int64)
        for i in range(0, len(start), 2048):
            s = start[i : i + 2048]
            pos[i : i + 2048] = s + np.argmax(h[s[:, None] + np.arange(width)] == m[s][:, None], axis=1)
        tied = np.flatnonzero(stop > pos)  # the least hash occurs again: later windows have a later anchor
        if len(tied):
            more: list[tuple] = []
            for r in tied.tolist():
                s, t = int(start[r]), int(stop[r])
                equal = s + np.flatnonzero(h[s : t + width] == m[s])
                begin = np.maximum(np.append(s, equal[:-1] + 1), s)
                until = np.minimum(equal, t)
                fit = begin <= until
                more.append((begin[fit], until[fit], equal[fit], np.full(int(fit.sum()), own[r])))
            usual = np.ones(len(start), bool)
            usual[tied] = False
            start, stop, pos, own = (
                np.concatenate([x[usual], *(y[k] for y in more)]) for k, x in enumerate((start, stop, pos, own))
            )
        text = texts[a:z][own]
        found.append((h[pos], text, start + lo - offsets[text], pos - start, stop - start + 1))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = as_bytes(part.column(1))
                offsets = np.cumsum([0, *map(len, texts)])
                h, text, first, left, n = anchors(np.frombuffer(b"".join(texts), np.uint8), offsets, length, gram)
                at = first << 32 | left << 16 | n
                keys = part.column(0).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), keys, pa.array(at)], names=["h", "key", "at"])
        tidy()

    return run


def _compressed(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch, "text"):
                z = [pack.compress(b) for b in as_bytes(part.column(1))]
                rest = [part.column(i) for i in range(3, part.num_columns)]
                row = pa.StructArray.from_arrays([pa.array(z, pa.binary()), *rest], names=["z", *fields])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), row], names=["key", "also", "row"])
        tidy()

    return run


def _regions(length: int, gram: int):
    """Rows (key, also, row, at: list of packed runs): one row per region: digests of its gram (96 bits: gram, mark) and of all of
    it, and its bytes but the gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, digest, wide = zstandard.ZstdDecompressor(), xxhash.xxh3_64_intdigest, xxhash.xxh3_128_intdigest
        kinds = (pa.int64(), pa.int32(), pa.uint64(), pa.uint32(), pa.uint64(), pa.int64(), pa.int32(), pa.binary())
        names = ["key", "also", "gram", "mark", "region", "first", "left", "rest"]

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)]
            cols[2:5] = [c.view(pa.int32() if c.type == pa.uint32() else pa.int64()) for c in cols[2:5]]
            return pa.RecordBatch.from_arrays(cols, names=names)

        rows: list[tuple] = []
        for batch in batches:
            z = batch.column(2).field(0)
            for i, (key, also) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                text = unpack.decompress(z[i].as_py())
                for at in batch.column(3)[i].as_py():
                    first, left, n = at >> 32, at >> 16 & 0xFFFF, at & 0xFFFF
                    region = text[first : first + n + length - 1]
                    if len(region) < n + length - 1:
                        continue  # another row's run, whose key is the same by chance
                    shared = region[left : left + gram]
                    h = wide(shared)
                    rows.append((key, also, h & _LOW, h >> 64 & 0xFFFFFFFF, digest(region, left), first, left, region[:left] + region[left + gram :]))
                    if len(rows) >= 20_000:
                        yield emit(rows)
                        rows = []
        yield emit(rows)
        tidy()

    return run


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    m = min(len(a), len(b))
    x = int.from_bytes(a[:m], "big") ^ int.from_bytes(b[:m], "big")
    return m - (x.bit_length() + 7) // 8


def _reach(parts: list[bytes]) -> list[int]:
    """How far each string agrees with some other one, from the beginning."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:], strict=False):
        n = _common(parts[i], parts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def repeated_windows(regions: list[tuple[int, bytes]], length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """Which windows of each region (bytes before the shared gram, all its other bytes) start in another place too.

    What no other region has at the same distance from the gram can't repeat and stays out of the suffix array.
    """
    width = length - gram + 1  # symbols of a window, with the gram as one
    masks = [np.zeros(len(rest) + 2 - width, bool) for _, rest in regions]
    before, after = _reach([rest[:left][::-1] for left, rest in regions]), _reach([rest[left:] for left, rest in regions])
    kept = [k for k, (a, b) in enumerate(zip(before, after, strict=True)) if a + b + 1 >= width]
    if len(kept) < 2:
        return masks
    parts: list[np.ndarray] = []
    for k in kept:
        left, rest = regions[k]
        b = np.frombuffer(rest, np.uint8).astype(np.uint16) + np.uint16(2)
        parts += [b[left - before[k] : left], _GRAM, b[left : left + after[k]], _END]
    flat = np.concatenate(parts)
    sizes = np.array([before[k] + after[k] + 2 for k in kept])
    counts = sizes - width
    begin = np.cumsum(sizes) - sizes
    opens = np.zeros(len(flat), bool)
    for s, n in zip(begin.tolist(), counts.tolist(), strict=True):
        opens[s : s + n] = True
    order = np.array(suffix_array(flat.tolist()), np.int64)
    order = order[opens[order]]
    again = np.zeros(len(flat), bool)
    span = np.arange(width)
    for i in range(0, len(order) - 1, 4096):
        a, b = order[i : i + 4096], order[i + 1 : i + 4097]
        a = a[: len(b)]
        same = (flat[a[:, None] + span] == flat[b[:, None] + span]).all(axis=1)
        again[a[same]] = True
        again[b[same]] = True
    for k, s, n in zip(kept, begin.tolist(), counts.tolist(), strict=True):
        start = regions[k][0] - before[k]
        masks[k][start : start + n] = again[s : s + n]
    return masks


def runs_of(mask: np.ndarray) -> list[int]:
    """First and last of each run of set places, flat."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [x for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) for x in (a, b - 1)]


def _grouped(length: int, gram: int):
    """Rows (gram, mark, region, n, left, rest) sorted by gram and mark: (gram, region, runs of repeated windows). A group may
    span batches."""

    def solve(rows: list[tuple]) -> list[tuple]:
        masks = repeated_windows([(r[4], r[5]) for r in rows], length, gram)
        out = []
        for (g, _, region, n, _, _), mask in zip(rows, masks, strict=True):
            runs = [0, len(mask) - 1] if n > 1 else runs_of(mask)
            if runs:
                out.append((g, region, runs))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 3
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["gram", "region", "runs"])

        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:2] != row[:2]:
                    out += solve(group)
                    group = []
                group.append(row)
            yield emit(out)
        if group:
            yield emit(solve(group))
        tidy()

    return run


def _window_rows(length: int, gram: int):
    """Rows (gram, mark, region, n, left, rest) of a very large group: a digest for each window, which covers the gram too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, one = length - gram, xxhash.xxh3_128_digest
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64())

        def emit(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["digest", "gram", "region", "w", "n"])

        for batch in batches:
            out: list[tuple] = []
            for g, mark, region, n, left, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = struct.pack("<qi", g, mark)
                for w in range(len(rest) - width + 1):
                    # the gram's digest, the window's other bytes, and where the gram stands among them
                    out.append((one(own + rest[w : w + width], left - w), g, region, w, n))
                if len(out) >= 20_000:
                    yield emit(out)
                    out = []
            yield emit(out)
        tidy()

    return run


def merge_spans(runs: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Sorted maximal byte spans [a, b) under runs of windows {first, last}."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["first"], r["last"] + length) for r in runs or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _repeated_regions(source: DataFrame, packed: DataFrame, length: int, gram: int, group: int) -> tuple[DataFrame, DataFrame]:
    """(key, also, gram, region, first) of the regions whose anchor repeats, and (gram, region, runs of repeated windows).

    Each step is a written table, so nothing is computed twice and shuffles of done steps can go. Counts by a key are
    tables of their own before they are joined back: the other side's partition of a hot key can then be split.
    """
    spark = source.sparkSession
    small_batches(spark)
    found = written(source.select("key", "text").mapInArrow(_anchor_rows(length, gram), "h long, key long, at long"), "anchors")
    twice = written(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "anchors-repeated")
    sought = written(
        found.join(twice, "h", "left_semi").groupBy(F.col("key").alias("k")).agg(F.collect_set("at").alias("at")), "anchors-sought"
    )
    discard(found, twice)
    release(spark)
    regions = written(
        packed.join(sought, packed["key"] == sought["k"]).select("key", "also", "row", "at")
        .mapInArrow(_regions(length, gram), "key long, also int, gram long, mark int, region long, first long, left int, rest binary"), "regions",
    )
    discard(sought)
    release(spark)
    distinct = written(
        regions.groupBy("gram", "mark", "region").agg(F.count("*").alias("n"), F.first("left").alias("left"), F.first("rest").alias("rest")), "regions-distinct"
    )
    once = F.sum((F.col("n") == 1).cast("long"))
    stats = distinct.groupBy("gram", "mark").agg(F.count("*").alias("d"), once.alias("once"), F.sum("n").alias("all")).where("all > 1").drop("all")
    stats = written(stats, "grams")
    release(spark)
    cols = ["gram", "mark", "region", "n", "left", "rest"]
    judged = distinct.join(stats, ["gram", "mark"])
    # nothing is left to ask where every region of an anchor repeats whole
    whole = judged.where("once = 0").select(
        "gram", "region", F.array(F.lit(0), (F.length("rest") - (length - gram)).cast("int")).alias("runs")
    )
    some = (
        judged.where(f"once > 0 and d <= {group}").select(*cols).repartition("gram", "mark").sortWithinPartitions("gram", "mark")
        .mapInArrow(_grouped(length, gram), "gram long, region long, runs array<int>")
    )
    windows = written(
        judged.where(f"once > 0 and d > {group}").select(*cols).mapInArrow(_window_rows(length, gram), "digest binary, gram long, region long, w int, n long"), "windows"
    )
    common = windows.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select(apart("digest", "binary").alias("d"))
    many = windows.join(common, F.col("digest") == F.col("d"), "left_semi").select("gram", "region", F.array("w", "w").alias("runs"))
    runs = written(whole.union(some).union(many), "runs")
    discard(distinct, stats, windows)
    release(spark)
    return regions, runs


def remove_repeats(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP
) -> DataFrame:
    """`keep` columns, kept (binary: the bytes left), n_bytes, and spans (array of removed [start, stop) byte pairs).

    A span may begin or end inside a character; as_text() drops what is left of one.
    """
    if not 1 <= gram < length or length - gram >= 1 << 16:
        raise ValueError("length and gram: 1 <= gram < length, and less than 65536 apart")
    keep = tuple(c for c in keep if c not in ("kept", "n_bytes", "spans"))
    row = [*[docs[c] for c in keep], docs[text]]
    source = docs.select(
        F.xxhash64(*row).alias("key"), docs[text].cast("string").alias("text"), F.shiftright(F.xxhash64(F.lit(1), *row), 32).cast("int").alias("also"),
        *[docs[c].alias(f"c{i}") for i, c in enumerate(keep)],
    )
    kinds = [T.StructField("z", T.BinaryType())] + [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    packed = source.mapInArrow(
        _compressed([f"c{i}" for i in range(len(keep))]),
        T.StructType([T.StructField("key", T.LongType()), T.StructField("also", T.IntegerType()), T.StructField("row", T.StructType(kinds))]),
    )
    regions, runs = _repeated_regions(source, packed, length, gram, group)
    places = regions.select("key", "also", "gram", "region", "first").join(runs, ["gram", "region"])
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)),
        lambda i: F.struct(
            (F.col("first") + F.element_at("runs", i + 1)).alias("first"), (F.col("first") + F.element_at("runs", i + 2)).alias("last")
        ),
    )
    per_doc = places.select("key", "also", F.explode(pairs).alias("run")).groupBy("key", "also").agg(F.collect_set("run").alias("runs"))
    per_doc = per_doc.select(F.col("key").alias("k"), F.col("also").alias("k2"), "runs")

    schema = T.StructType(
        [T.StructField(c, docs.schema[c].dataType) for c in keep]
        + [T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType())]
        + [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])))]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, unpack = to_arrow_schema(schema), zstandard.ZstdDecompressor()
        for batch in batches:
            row = batch.column(0)
            kept, sizes, spans = [], [], []
            for z, runs in zip(row.field(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = unpack.decompress(z)
                own = merge_spans(runs, length)
                left, at = [], 0
                for a, b in own:
                    left.append(data[at:a])
                    at = b
                kept.append(b"".join([*left, data[at:]]))
                sizes.append(len(data))
                spans.append([{"start": a, "stop": b} for a, b in own])
            made = [row.field(i + 1).cast(out.field(i).type) for i in range(len(keep))]
            made += [pa.array(x, out.field(len(keep) + i).type) for i, x in enumerate((kept, sizes, spans))]
            yield pa.RecordBatch.from_arrays(made, schema=out)
        tidy()

    return (
        packed.join(per_doc, (packed["key"] == per_doc["k"]) & (packed["also"] == per_doc["k2"]), "left").select("row", "runs").mapInArrow(cut, schema)
    )


def as_text(found: DataFrame, column: str = "text") -> DataFrame:
    """The operator's rows with what is kept as a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b.decode("utf-8", "ignore") for b in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], column])

    rest = [c for c in found.columns if c not in ("kept", "n_bytes", "spans", column)]
    schema = T.StructType([found.schema[c] for c in rest] + [T.StructField(column, T.StringType())])
    return found.select(*rest, "kept").mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """The query's columns from the operator's: sizes, number of spans and a digest of what is kept."""
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return found.select(
        "doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
