"""Media columns: payloads cut by content, chunks stored once, media rebuilt from ordered chunk lists.

A text's bytes, padded with spaces to a multiple of 192, become an 8-bit mono WAV file. A rolling gear hash cuts the file
where its top bits are zero, so equal stretches give equal chunks wherever they stand. Tasks append new chunks to
pack files in the shared folder; a Spark join on the chunk digest then gives every chunk one place for all documents
(a chunk that two tasks wrote is read from the least place), and the ordered list of places is a document's recipe.
The reader range-reads the chunks, checks each digest and the whole file's, and computes features from the samples.

Only packs named by checkpointed rows are read, so a lost or repeated task leaves nothing but unused files.

Defined results: null text is empty: 192 spaces; equal texts give equal values; repeated rows each give a row; a very long
text is one file of many chunks; an empty table gives an empty one; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import apart, as_bytes, checkpoint, filesystem, new_folder, slices, small_batches

UNIT, RATE = 192, 8000
LEAST, MOST, BITS = 512, 16_384, 11
PACK_BYTES = 64 << 20
#: Open pack files a reader keeps.
OPEN_PACKS = 32
#: Media that one task rebuilds.
TASK_BYTES = 32 << 20


def gear_table(seed: int = 0x5EED) -> np.ndarray:
    """256 64-bit values by the splitmix64 rule."""
    out, x, m = [], seed, (1 << 64) - 1
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) & m
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


GEAR = gear_table()


def cut_places(data: bytes, bits: int = BITS, block: int = 1 << 20) -> np.ndarray:
    """Ends of the prefixes whose gear hash (h = 2h + gear[byte], so the last 64 bytes) has `bits` zero top bits."""
    b, out = np.frombuffer(data, np.uint8), []
    for lo in range(0, len(b), block):
        pre = min(lo, 63)
        h, s = GEAR[b[lo - pre : lo + block]], 1
        while s < 64:
            h[s:] = h[s:] + (h[:-s] << np.uint64(s)) if len(h) > s else h[s:]
            s *= 2
        hit = np.flatnonzero(h >> np.uint64(64 - bits) == 0)
        out.append(hit[hit >= pre] + lo - pre + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def chunk_ends(data: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Chunk ends: the first cut at least `least` on, at most `most` on; the last chunk may be shorter."""
    cuts, n, start, ends = cut_places(data, bits).tolist(), len(data), 0, []
    while start < n:
        k = bisect_left(cuts, start + least)
        end = cuts[k] if k < len(cuts) else n
        end = min(end, start + most, n)
        ends.append(end)
        start = end
    return ends


def padded(text: bytes) -> bytes:
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as w:
        return w.readframes(w.getnframes())


def feature(samples: bytes) -> str:
    """Seconds (ms), mean and mean square about 128 (thousandths), extremes, and crossings of the middle."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    n = len(x)
    up = x >= 0
    return (
        f"ms={n * 1000 // RATE};mean={int(x.sum()) * 1000 // n};power={int((x * x).sum()) * 1000 // n};"
        f"min={int(x.min())};max={int(x.max())};cross={int(np.count_nonzero(up[1:] != up[:-1]))}"
    )


PLACE = T.StructType(
    [T.StructField("pack", T.StringType()), T.StructField("at", T.LongType()), T.StructField("packed", T.LongType())]
)
_CHUNK = T.StructType([T.StructField("digest", T.BinaryType()), *PLACE.fields])


def store(docs: DataFrame, folder: str, keep: tuple[str, ...] = ("doc_id",), pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Write every document's media as chunks; a checkpointed row each: row, keep columns, n_bytes, media digest, chunks."""
    schema = T.StructType(
        [T.StructField("row", T.LongType())]
        + [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
        + [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("chunks", T.ArrayType(_CHUNK))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, squeeze = to_arrow_schema(schema), zstandard.ZstdCompressor(level=3)
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        row = task.partitionId() << 33
        number, at, out = 0, 0, None
        known: dict[bytes, dict] = {}
        try:
            for batch in batches:
                for part in slices(batch, "t"):
                    rows = []
                    for text in as_bytes(part.column(len(keep))):
                        data = to_wav(padded(text))
                        chunks, start = [], 0
                        for end in chunk_ends(data):
                            chunk = data[start:end]
                            start = end
                            digest = hashlib.sha256(chunk).digest()
                            place = known.get(digest)
                            if place is None:
                                if out is None:
                                    pack = f"{task.partitionId()}-{task.taskAttemptId()}-{number}"
                                    out = fs.open_output_stream(f"{root}/{pack}")
                                z = squeeze.compress(chunk)
                                out.write(z)
                                place = known[digest] = {"digest": digest, "pack": pack, "at": at, "packed": len(z)}
                                at += len(z)
                            chunks.append(place)
                        rows.append((row, len(text), hashlib.sha256(data).digest(), chunks))
                        row += 1
                        if at >= pack_bytes:
                            out.close()
                            out, at, number = None, 0, number + 1
                            known.clear()
                    cols = list(zip(*rows, strict=True))
                    made = [pa.array(cols[0], pa.int64())]
                    made += [part.column(i).cast(kinds.field(i + 1).type) for i in range(len(keep))]
                    made += [pa.array(c, kinds.field(len(keep) + 1 + j).type) for j, c in enumerate(cols[1:])]
                    yield pa.RecordBatch.from_arrays(made, schema=kinds)
        finally:
            if out is not None:
                out.close()

    source = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs["text"].cast("string").alias("t"))
    small_batches(docs.sparkSession)
    return checkpoint(source.mapInArrow(run, schema))


def recipes(stored: DataFrame) -> DataFrame:
    """(row, recipe): each document's chunks in order, every digest at its one place."""
    each = stored.select("row", F.posexplode("chunks").alias("seq", "c")).select("row", "seq", "c.digest", "c.pack", "c.at", "c.packed")
    place = each.groupBy("digest").agg(F.min(F.struct("pack", "at", "packed")).alias("place"))
    place = place.select(apart("digest", "binary").alias("of"), "place")
    return (
        each.select("row", "seq", "digest").join(place, F.col("digest") == F.col("of"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "digest", "place"))).alias("recipe"))
    )


def rebuild(stored: DataFrame, folder: str, keep: tuple[str, ...] = ("doc_id",), media: bool = False) -> DataFrame:
    """keep columns, n_bytes, payload and media sizes and digests, tail_crc32, feature; with `media` the file itself."""
    fields = [
        ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()),
        ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()),
    ]
    fields += [("media", T.BinaryType())] * media
    schema = T.StructType([T.StructField(c, stored.schema[f"k{i}"].dataType) for i, c in enumerate(keep)] + [T.StructField(*f) for f in fields])
    rows = stored.drop("chunks").join(recipes(stored), "row").select(*[f"k{i}" for i in range(len(keep))], "n_bytes", "media", "recipe")
    # recipes are small whatever they stand for, so tasks are counted by the media and dealt by number
    total = stored.agg(F.sum("n_bytes")).first()[0] or 0
    rows = rows.repartition(int(total // TASK_BYTES) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, expand = to_arrow_schema(schema), zstandard.ZstdDecompressor()
        fs, root = filesystem(folder)
        files: dict[str, object] = {}

        def read(pack: str, at: int, n: int) -> bytes:
            f = files.pop(pack, None) or fs.open_input_file(f"{root}/{pack}")
            files[pack] = f  # the last used stands last
            if len(files) > OPEN_PACKS:
                files.pop(next(iter(files))).close()
            f.seek(at)
            return f.read(n)

        def fetch(recipe: list[dict]) -> bytes:
            parts, i = [], 0
            while i < len(recipe):
                pack, at, end, j = recipe[i]["place"]["pack"], recipe[i]["place"]["at"], recipe[i]["place"]["at"], i
                while j < len(recipe) and recipe[j]["place"]["pack"] == pack and recipe[j]["place"]["at"] == end:
                    end += recipe[j]["place"]["packed"]
                    j += 1
                run_, here = read(pack, at, end - at), 0
                for r in recipe[i:j]:
                    chunk = expand.decompress(run_[here : here + r["place"]["packed"]])
                    here += r["place"]["packed"]
                    if hashlib.sha256(chunk).digest() != r["digest"]:
                        raise ValueError(f"damaged chunk in {pack}")
                    parts.append(chunk)
                i = j
            return b"".join(parts)

        try:
            for batch in batches:
                out = []
                k = len(keep)
                for i in range(batch.num_rows):
                    data = fetch(batch.column(k + 2)[i].as_py())
                    digest = hashlib.sha256(data)
                    if digest.digest() != batch.column(k + 1)[i].as_py():
                        raise ValueError("rebuilt media differs from what was stored")
                    body = from_wav(data)
                    row = (
                        batch.column(k)[i].as_py(), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), len(data),
                        digest.hexdigest(), feature(body),
                    )
                    out.append((*row, data) if media else row)
                cols = list(zip(*out, strict=True)) or [[]] * len(fields)
                made = [batch.column(i).cast(kinds.field(i).type) for i in range(k)]
                made += [pa.array(c, kinds.field(k + j).type) for j, c in enumerate(cols)]
                yield pa.RecordBatch.from_arrays(made, schema=kinds)
        finally:
            for f in files.values():
                f.close()

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), folder: str | None = None) -> DataFrame:
    folder = folder or new_folder(docs.sparkSession, "media")
    return rebuild(store(docs, folder, keep), folder, keep)
