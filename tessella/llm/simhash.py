"""SimHash near-duplicates: fingerprints of word shingles, linked by tiled exact comparison.

A tile is up to TILE fingerprints sorted by bit count. It is compared with itself, or with another, by exclusive-or and
bit counts; parts of a tile, and whole tiles, whose bit counts differ beyond the radius are skipped. What a tile gives is
a spanning forest of its links, never all pairs.

Tiles are filled so that any two fingerprints that may be linked meet in one, and so that work grows with the rows:

* `links`: up to a tile of fingerprints is one tile. For more, the 64 bits are cut into radius + m blocks; two
  fingerprints within the radius agree on m blocks at least, so a bucket for each choice of m blocks (m the least that
  gives buckets of a tile on average) brings them together. That is exact.
* `similar_links`, for sets of shingles at a similarity: 0.8 is some 10 bits of 64, up to 20, for which no choice of
  blocks parts anything. There the buckets are minimum-hash bands (shingle_sets.py; a pair at 0.8 meets in none of them in about 3
  of a million cases), tiles keep the pairs within the radius, and each link is confirmed on the two whole sets: first
  a forest of every tile, then whatever pairs of a tile are still in two groups.

A bucket over TILE is laid out by bit count and cut into tiles; pairs of tiles within reach are each dealt to a task.
Groups come from components over nodes that are ordered as the rows are (least doc_id first), so the group's least node
is its answer, and no row is joined by a group's id.

Defined results: null or empty text has fingerprint zero and no shingles, linked like any other; a very long text is read
whole, in blocks; repeated rows each give a row with the same component; a null doc_id joins a component but never names
one unless nothing else is in it (then null); other columns are not read, whatever their names; an empty table gives
an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import shingle_sets as S
from tessella.llm.common import apart, as_bytes, checkpoint, map_text, small_batches, tidy, written
from tessella.llm.components import components

TILE = 512
#: Bits by which sets at a similarity of 0.8 may differ: 10 on average, 20 or more in one of some thousands.
WIDE = 20
#: Nodes (some 40 bytes each) up to which a list of them is broadcast.
BROADCAST_NODES = 200_000
#: Rows of whole groups that a task holds at once.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int) -> int:
    return S.fingerprint(S.shingles(text, shingle))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), shingle: int = 4) -> DataFrame:
    def make() -> Callable[[pa.Array], list]:
        def run(col: pa.Array) -> list:
            out = np.array([fingerprint(b, shingle) for b in as_bytes(col)], np.uint64)
            return [pa.array(out.view(np.int64))]

        return run

    return map_text(docs, make, [("fp", T.LongType())], list(keep))


class Forest:
    """Union-find over the rows of a tile or a pair of tiles; keeps the links that joined something."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            new = ra != rb
            if not new.any():
                return
            a, b, ra, rb = a[new], b[new], ra[new], rb[new]
            _, first = np.unique(np.maximum(ra, rb), return_index=True)
            # of the links of each higher root, one is kept a pass: its tree goes below the lower root
            for i in first.tolist():
                x, y = self.root[a[i]], self.root[b[i]]
                if x != y:
                    low, high = (x, y) if x < y else (y, x)
                    self.root[self.root == high] = low
                    self.kept.append((int(a[i]), int(b[i])))


def near_pairs(fp: np.ndarray, split: int, radius: int, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius: all pairs if split is 0, else the rows before it against those after it.

    Each side is sorted by bit count; blocks of `step` rows whose counts differ beyond the radius are skipped.
    """
    count = np.bitwise_count(fp).astype(np.int64)
    n = len(fp)
    order = np.argsort(count, kind="stable") if not split else np.concatenate(
        [np.argsort(count[:split], kind="stable"), split + np.argsort(count[split:], kind="stable")]
    )
    fp, count = fp[order], count[order]
    for i in range(0, split or n, step):
        stop = min(i + step, split or n)
        for j in range(split or i, n, step):
            end = min(j + step, n)
            if count[j] - count[stop - 1] > radius:
                break
            if count[i] - count[end - 1] > radius:
                continue
            near = np.bitwise_count(fp[i:stop, None] ^ fp[None, j:end]) <= radius
            if not split and i == j:
                near = np.triu(near, 1)
            a, b = np.nonzero(near)
            yield order[a + i], order[b + j]


def forest(fp: np.ndarray, split: int, radius: int, fits: Callable | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the rows within the radius, closer ones first where the radius is wide."""
    found = Forest(len(fp))
    for r in (radius // 3, radius) if fits else (radius,):
        for a, b in near_pairs(fp, split, r):
            if fits is not None:
                ok = fits(a, b)
                a, b = a[ok], b[ok]
            found.link(a, b)
    return found.kept


def choice(n: int, radius: int, tile: int) -> tuple[int, int]:
    """(m, bits): blocks to agree on, and bits of their keys to use, for n fingerprints in buckets of about a tile."""
    need = max(0, int(np.ceil(np.log2(max(1, n) / tile))))
    m = 0
    while m < 64 - radius and 64 * m // (radius + m) < need:
        m += 1
    return m, need


def bucket_keys(fp: np.ndarray, radius: int, m: int, bits: int) -> list[np.ndarray]:
    """Bucket numbers of each fingerprint, one per choice of m of radius + m blocks: the choice, then its last `bits` bits."""
    blocks = radius + m
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    part = [(fp >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    size = [b - a for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for k, chosen in enumerate(combinations(range(blocks), m)):
        key = np.zeros(len(fp), np.uint64)
        for c in chosen:
            key = (key << np.uint64(size[c])) | part[c]
        out.append((np.uint64(k) << np.uint64(bits)) | (key & np.uint64((1 << bits) - 1)))
    return out


_PAIR = ("bucket", "t1", "t2")
_OPEN = (*_PAIR, "side", "node", "fp", "group")


def tiled(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """rows (bucket, fp, ...) dealt to tiles and pairs of tiles: the rows' columns after _PAIR and side (0 left, 1 right).

    A bucket of up to `tile` rows is one tile; buckets of one row are dropped.
    """
    columns = [c for c in rows.columns if c != "bucket"]
    size = checkpoint(rows.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1").select(apart("bucket").alias("_k"), "_n"))
    shared = rows.join(size, F.col("bucket") == F.col("_k")).drop("_k")
    zero = F.lit(0).cast("int")
    out = shared.where(F.col("_n") <= tile).select("bucket", *[zero.alias(c) for c in _PAIR[1:]], zero.alias("side"), *columns)
    if (size.agg(F.max("_n")).first()[0] or 0) > tile:
        big = shared.where(F.col("_n") > tile).withColumn("_o", F.bit_count("fp").cast("int"))
        before = F.sum("_c").over(Window.partitionBy("bucket").orderBy("_o")) - F.col("_c")  # of 65 rows a bucket at most
        cut = checkpoint(big.groupBy("bucket", "_o").agg(F.count("*").alias("_c")).withColumn("_before", before))
        number = lambda place: F.floor(place / tile).cast("int")
        held = F.sequence(number(F.col("_before")), number(F.col("_before") + F.col("_c") - 1))
        each = cut.select("bucket", "_o", F.explode(held).alias("t")).groupBy("bucket", "t").agg(F.min("_o").alias("low"), F.max("_o").alias("high"))
        left, right = each.toDF("bucket", "t1", "low1", "high1"), each.toDF("b2", "t2", "low2", "high2")
        reach = (F.col("t2") >= F.col("t1")) & (F.col("low2") - F.col("high1") <= radius)
        pairs = checkpoint(left.join(right, (F.col("bucket") == F.col("b2")) & reach).select(apart("bucket").alias("bucket"), "t1", "t2"))
        sides = pairs.select(*_PAIR, F.col("t1").alias("_t"), zero.alias("side")).union(
            pairs.where("t1 < t2").select(*_PAIR, "t2", F.lit(1).cast("int"))
        )
        parts = cut.select(apart("bucket").alias("b"), F.col("_o").alias("o"), "_c", "_before")
        placed = big.join(parts, (F.col("bucket") == F.col("b")) & (F.col("_o") == F.col("o"))).select(
            F.col("bucket").alias("_b"), number(F.col("_before") + F.pmod(F.xxhash64("fp"), F.col("_c"))).alias("_own"), *columns
        )
        met = placed.join(sides, (F.col("_b") == F.col("bucket")) & (F.col("_own") == F.col("_t")))
        out = out.union(met.select(*_PAIR, "side", *columns))
    return out


def together(rows: DataFrame) -> DataFrame:
    """`tiled` rows with those of a tile, or pair of tiles, in one task, one after another."""
    return rows.repartition(*_PAIR).sortWithinPartitions(*_PAIR, "side")


def whole_groups(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[tuple[pa.Table, list[tuple[int, int, int]]]]:
    """Tables of whole tiles of `tiled` rows, about `chunk` rows each, with (start, rows, rows of the left side or 0) of each tile."""

    def closed(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(parts).combine_chunks()
        key = np.stack([np.asarray(t.column(c)).astype(np.int64) for c in _PAIR])
        return t, np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))

    def dealt(t: pa.Table, edge: np.ndarray) -> list[tuple[int, int, int]]:
        ends = np.append(edge[1:], t.num_rows)
        left = np.concatenate(([0], np.cumsum(np.asarray(t.column("side")) == 0)))
        lefts = left[ends] - left[edge]
        return [(a, n, 0 if k == n else k) for a, n, k in zip(edge.tolist(), (ends - edge).tolist(), lefts.tolist(), strict=True)]

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= chunk:
            t, edge = closed(held)
            if edge[-1]:
                yield t.slice(0, int(edge[-1])), dealt(t.slice(0, int(edge[-1])), edge[:-1])
            rest = t.slice(int(edge[-1])).combine_chunks()
            held, rows = rest.to_batches(), rest.num_rows if len(edge) > 1 else 0
    if held:
        t, edge = closed(held)
        yield t, dealt(t, edge)


def _taken(t: pa.Table, name: str, at: list[int] | np.ndarray) -> pa.Array:
    return t.column(name).combine_chunks().take(pa.array(at, pa.int64()))


def _forests(radius: int, similarity: float | None = None):
    """Rows of tiles with fp and node (and n: sizes of sets): the nodes x, y of the links of their forests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, groups in whole_groups(batches):
            fp, x, y = np.asarray(t.column("fp")).view(np.uint64), [], []
            size = np.asarray(t.column("n")).astype(np.int64) if similarity else None
            two = np.array([a for a, n, _ in groups if n == 2], np.int64)  # most shared buckets hold two: compared in one go
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
            if similarity:
                near &= _fit(size, two, two + 1, similarity)
            x += two[near].tolist()
            y += (two[near] + 1).tolist()
            for start, n, left in groups:
                if n > 2:
                    fits = None if size is None else (lambda a, b, s=size[start : start + n]: _fit(s, a, b, similarity))
                    for a, b in forest(fp[start : start + n], left, radius, fits):
                        x.append(start + a)
                        y.append(start + b)
            yield pa.RecordBatch.from_arrays([_taken(t, "node", x), _taken(t, "node", y)], names=["x", "y"])
        tidy()

    return run


def _fit(size: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Sets whose sizes allow the similarity."""
    return np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9


def links(fps: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(x, y) pairs of nodes that connect all fingerprints within the radius. fps: fp (long, distinct) and node (fp if not given)."""
    fps = fps.select("fp", "node" if "node" in fps.columns else F.col("fp").alias("node"))
    m, bits = choice(fps.count(), radius, tile)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = bucket_keys(np.asarray(batch.column(0)).view(np.uint64), radius, m, bits)
            for key in keys:
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], names=["bucket", "fp", "node"])

    dealt = fps.mapInArrow(deal, T.StructType([T.StructField("bucket", T.LongType()), *fps.schema.fields]))
    kind = fps.schema["node"].dataType
    return together(tiled(dealt, radius, tile)).mapInArrow(_forests(radius), T.StructType([T.StructField("x", kind), T.StructField("y", kind)]))


def _prints(docs: DataFrame, keep: tuple[str, ...], shingle: int) -> DataFrame:
    """`keep` columns with each document's set of shingles: fp, n (its size), key (its digest), bands."""

    def make() -> Callable[[pa.Array], list]:
        def run(col: pa.Array) -> list:
            fp, n, key, bands = [], [], [], []
            for text in as_bytes(col):
                own = np.unique(S.shingles(text, shingle))
                fp.append(S.fingerprint(own))
                n.append(len(own))
                key.append(xxhash.xxh3_128_digest(own.tobytes()))
                bands.append(S.band_keys(own))
            ends = pa.array(np.arange(len(n) + 1) * S.BANDS, pa.int32())
            flat = np.concatenate([np.zeros(0, np.uint64), *bands]).view(np.int64)
            return [pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(key, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(flat))]

        return run

    fields = [("fp", T.LongType()), ("n", T.IntegerType()), ("key", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))]
    return map_text(docs, make, fields, list(keep))


def _sets(texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of the nodes asked for. texts: id, hash (which the nodes carry too) and text."""

    def make() -> Callable[[pa.Array], list]:
        def run(col: pa.Array) -> list:
            sets = [np.unique(S.shingles(b, shingle)).view(np.int64) for b in as_bytes(col)]
            ends = np.cumsum([0, *map(len, sets)])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))]

        return run

    if nodes.count() <= BROADCAST_NODES:  # else the texts are shuffled to meet them
        nodes = F.broadcast(nodes)
    same = texts["id"].eqNullSafe(nodes["id"]) & (texts["hash"] == nodes["hash"])
    wanted = texts.join(nodes, same).select("node", "text")
    return map_text(wanted.dropDuplicates(["node"]), make, [("hashes", T.ArrayType(T.LongType()))], ["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (x, y) pairs whose whole sets are similar."""
    left, right = sets.toDF("nx", "hx"), sets.toDF("ny", "hy")
    both = pairs.join(left, F.col("x") == F.col("nx")).join(right, F.col("y") == F.col("ny")).select("x", "y", "hx", "hy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hx, hy = batch.column(2), batch.column(3)
            near = [S.similar(*(np.asarray(h[i].values).view(np.uint64) for h in (hx, hy)), similarity) for i in range(batch.num_rows)]
            yield batch.select(["x", "y"]).filter(pa.array(near, pa.bool_()))
        tidy()

    return both.mapInArrow(run, pairs.select("x", "y").schema)


def _open_rows(radius: int, similarity: float):
    """Rows of tiles with fp, node, n and group: those that have a row of another group within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, groups in whole_groups(batches):
            fp, size, code = np.asarray(t.column("fp")).view(np.uint64), np.asarray(t.column("n")).astype(np.int64), np.asarray(t.column("group"))
            hit = np.zeros(t.num_rows, bool)
            for start, n, left in groups:
                own = slice(start, start + n)
                c, s = code[own], size[own]
                if (c == c[0]).all():
                    continue
                for a, b in near_pairs(fp[own], left, radius):
                    ok = (c[a] != c[b]) & _fit(s, a, b, similarity)
                    hit[start + a[ok]] = hit[start + b[ok]] = True
            at = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays([_taken(t, c, at) for c in _OPEN], names=list(_OPEN))
        tidy()

    return run


def _settled(radius: int, similarity: float):
    """Rows of tiles with fp, node, group and hashes: links that were still missing, confirmed on the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, groups in whole_groups(batches, 1 << 12):
            fp, code, x, y = np.asarray(t.column("fp")).view(np.uint64), np.asarray(t.column("group")), [], []
            hashes = t.column("hashes").combine_chunks()
            values, ends = np.asarray(hashes.values).view(np.uint64), np.asarray(hashes.offsets)
            for start, n, left in groups:
                sets = [values[ends[start + i] : ends[start + i + 1]] for i in range(n)]
                size, index, root = np.array([len(s) for s in sets]), S.Postings(sets), np.unique(code[start : start + n], return_inverse=True)[1]
                for a, b in near_pairs(fp[start : start + n], left, radius):
                    for i in np.unique(a).tolist():
                        js = b[a == i]
                        js = js[(root[js] != root[i]) & _fit(size, np.full(len(js), i), js, similarity)]
                        for j in js[index.similar(i, js, similarity)].tolist() if len(js) else ():
                            if root[i] != root[j]:
                                root[root == root[j]] = root[i]
                                x.append(start + i)
                                y.append(start + j)
            yield pa.RecordBatch.from_arrays([_taken(t, "node", x), _taken(t, "node", y)], names=["x", "y"])
        tidy()

    return run


def similar_links(sets: DataFrame, texts: DataFrame, shingle: int, similarity: float, radius: int = WIDE, tile: int = TILE) -> DataFrame:
    """(x, y) pairs of nodes that connect all sets at the similarity that share a band and lie within the radius.

    sets: a row per distinct set: node (long), id and hash (of its row), fp, n, bands. texts: id, hash and text of those rows.
    """
    pair, row = "x long, y long", sets.select("node", "id", "hash")
    dealt = sets.select(F.explode("bands").alias("bucket"), "fp", "n", "node")
    rows = written(tiled(dealt, radius, tile), "tiles")
    first = checkpoint(together(rows).mapInArrow(_forests(radius, similarity), pair).distinct())
    ends = first.select(F.col("x").alias("node")).union(first.select("y")).distinct()
    found = checkpoint(_confirmed(first, written(_sets(texts, checkpoint(row.join(ends, "node", "left_semi")), shingle), "sets"), similarity))
    # what is still apart: pairs of a tile in two groups
    group = components(found).select(apart("node").alias("g"), F.col("component").alias("c"))
    placed = rows.join(group, F.col("node") == F.col("g"), "left").withColumn("group", F.coalesce("c", "node")).drop("g", "c")
    fields = T.StructType([placed.schema[c] for c in _OPEN])
    apart_yet = checkpoint(together(placed).mapInArrow(_open_rows(radius, similarity), fields))
    asked = checkpoint(row.join(apart_yet.select("node").distinct(), "node", "left_semi"))
    more = written(_sets(texts, asked, shingle), "sets")
    wide = apart_yet.join(more.select(apart("node").alias("m"), "hashes"), F.col("node") == F.col("m")).drop("m")
    return found.union(together(wide).mapInArrow(_settled(radius, similarity), pair))


def _order(hash_: Column) -> Column:
    """A row's node: nodes are ordered as rows are kept, by doc_id (nulls last), then by a hash."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), hash_.alias("hash"))


def _numbered(first: DataFrame) -> DataFrame:
    """first with node (its order) as a whole number of the same order, and the row's id and hash."""
    found = checkpoint(first.orderBy("node").withColumn("_at", F.monotonically_increasing_id()))
    return found.select(F.col("_at").alias("node"), "node.id", "node.hash", *[c for c in first.columns if c != "node"])


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links."""
    found = checkpoint(fingerprints(docs, ("doc_id",), shingle))
    first = checkpoint(found.groupBy("fp").agg(F.min(_order(F.col("fp"))).alias("node")))
    joined = components(links(first, radius, tile))
    # a node holds the fingerprint it stands for, so a linked fingerprint's answer needs no other join
    linked = joined.select(F.col("node.hash").alias("fp"), F.col("component.id").alias("least"))
    least = first.join(linked.withColumnRenamed("fp", "l"), F.col("fp") == F.col("l"), "left").select("fp", F.when(F.col("l").isNull(), F.col("node.id")).otherwise(F.col("least")).alias("least"))
    least = checkpoint(least)  # so both sides are exchanged, and a hot fingerprint's partition can be split
    return found.join(least.select(apart("fp").alias("k"), "least"), F.col("fp") == F.col("k")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").cast(docs.schema["doc_id"].dataType).alias("component_id")
    )


def keep_one(docs: DataFrame, shingle: int = 4, radius: int | None = None, similarity: float | None = None, tile: int = TILE) -> DataFrame:
    """docs with one row of each group: the smallest doc_id (a null one only if the group has no other), then text hash.

    Groups are linked by fingerprints within `radius` bits (4 unless given), or, with `similarity`, by sets of shingles at
    that Jaccard similarity among those within `radius` (WIDE unless given). Rows equal in doc_id and text are one row.
    The rows that stay come back by a semi-join on those two.
    """
    columns, spark = docs.columns, docs.sparkSession
    small_batches(spark)
    marked = docs.withColumn("_text_hash", F.xxhash64(docs["text"]))
    node = F.min(_order(F.col("_text_hash"))).alias("node")
    if similarity is None:
        found = checkpoint(fingerprints(marked, ("doc_id", "_text_hash"), shingle))
        first = _numbered(found.groupBy("fp").agg(node))
        joined = components(links(first, 4 if radius is None else radius, tile))
    else:
        found = written(_prints(marked, ("doc_id", "_text_hash"), shingle), "prints")
        first = _numbered(found.groupBy("key").agg(node, *[F.first(c).alias(c) for c in ("fp", "n", "bands")]).drop("key"))
        texts = marked.select(F.col("doc_id").cast("long").alias("id"), F.col("_text_hash").alias("hash"), "text")
        joined = components(similar_links(first, texts, shingle, similarity, WIDE if radius is None else radius, tile))
    later = joined.where(F.col("node") != F.col("component")).select(F.col("node").alias("l"))
    kept = first.join(later, F.col("node") == F.col("l"), "left_anti").select("id", "hash")
    same = marked["doc_id"].cast("long").eqNullSafe(kept["id"]) & (marked["_text_hash"] == kept["hash"])
    return marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_text_hash"]).select(*columns)
