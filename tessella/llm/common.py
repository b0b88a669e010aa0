"""Shared plumbing: Arrow maps over text, shared-folder files, seeds and caches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes a Python worker handles at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch whose texts sum to about `limit` bytes, one row at least."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.binary_length(col).fill_null(0), dtype=np.int64)
    ends, start, n = np.cumsum(sizes), 0, batch.num_rows
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


#: Rows of an Arrow batch, for sessions that left Spark's default: whole texts are long.
BATCH_ROWS = 1000
_resident: dict[tuple, object] = {}


def resident(key: tuple, make: Callable[[], object]) -> object:
    """A worker's one large table (a vocabulary, say), kept between its tasks until another is asked for."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def tidy() -> None:
    """Give memory that a task has freed back to the machine: workers live on, and idle ones count too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Ask for BATCH_ROWS rows in an Arrow batch, in a session that left the number at Spark's default (a setting of the session,
    so it stays). Spark also ends a batch at spark.sql.execution.arrow.maxBytesPerBatch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def map_text(
    df: DataFrame,
    make: Callable[[], Callable[[pa.Array], list]],
    fields: list[tuple[str, T.DataType]],
    keep: list[str],
    text: str = "text",
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """`keep` columns of df plus `fields`, computed from whole texts.

    `make()` runs once a task and gives a function from an Arrow string array (nulls
    included) to one array or list per field, about `limit` bytes of text at a time. A kept column that a field
    names anew is dropped; other columns of df are never read.
    """
    new = {name.lower() for name, _ in fields}
    kept = [c for c in keep if c.lower() not in new]
    source = [df[c].alias(f"k{i}") for i, c in enumerate(kept)]
    if text in kept and df.schema[text].dataType == T.StringType():
        column, name = kept.index(text), f"k{kept.index(text)}"  # the text goes to Python once
    else:
        column, name = len(kept), "t"
        source.append(df[text].cast("string").alias("t"))
    schema = T.StructType(
        [T.StructField(c, df.schema[c].dataType) for c in kept] + [T.StructField(n, t) for n, t in fields]
    )
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, fn = to_arrow_schema(schema), make()
        for batch in batches:
            for part in slices(batch, name, limit):
                made = fn(part.column(column))
                cols = [part.column(i).cast(out.field(i).type) for i in range(width)]
                cols += [
                    (c if isinstance(c, pa.Array) else pa.array(c)).cast(out.field(width + j).type)
                    for j, c in enumerate(made)
                ]
                yield pa.RecordBatch.from_arrays(cols, schema=out)
        del fn
        tidy()

    small_batches(df.sparkSession)
    return df.select(*source).mapInArrow(run, schema)


def as_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives none."""
    return [b or b"" for b in col.cast(pa.binary()).to_pylist()]


def as_text(col: pa.Array) -> list[str]:
    return [s or "" for s in col.to_pylist()]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all runs on one machine (tests) may it be
    unset: then a temporary folder is made."""
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_:
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
        if now.isDefined():
            set_ = now.get()
        elif spark.sparkContext.master.startswith("local["):
            set_ = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(set_)
    return set_


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows and bytes that a task holds before it writes them to its file.
GROUP_ROWS, GROUP_BYTES = 1 << 17, 16 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage cut, columns read as needed, and no partitioning assumed,
    so a join with it may split its large partitions.

    Workers write the files and report them, and only reported files are read, so a lost or repeated task leaves nothing but an
    unused file. (Spark's own writers start a process for each file's permissions where Hadoop has no native library.)
    """
    spark, folder, schema = df.sparkSession, new_folder(df.sparkSession, name), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        store, root = filesystem(folder)
        task = TaskContext.get()
        file = f"part-{task.partitionId()}-{task.taskAttemptId()}.parquet"
        out = writer = None
        held: list[pa.RecordBatch] = []
        rows = size = 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if writer is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{file}")
                    writer = pq.ParquetWriter(out, batch.schema, compression="zstd", compression_level=3)
                held.append(batch)
                rows, size = rows + batch.num_rows, size + batch.nbytes
                if rows >= GROUP_ROWS or size >= GROUP_BYTES:
                    writer.write_table(pa.Table.from_batches(held), row_group_size=rows)
                    held, rows, size = [], 0, 0
            if held:
                writer.write_table(pa.Table.from_batches(held), row_group_size=rows)
        finally:
            if writer is not None:
                writer.close()
                out.close()
        if writer is not None:
            yield pa.RecordBatch.from_arrays([pa.array([file])], names=["file"])
        tidy()

    files = sorted(r.file for r in df.mapInArrow(run, "file string").collect())
    if not files:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(*[f"{folder}/{f}" for f in files])
    found.written_to = folder
    return found


def discard(*tables: DataFrame) -> None:
    """Delete `written` tables that nothing will read any more: all that was made of them is written itself."""
    for t in tables:
        folder = getattr(t, "written_to", None)
        if folder in _made:
            _made.remove(folder)
            _delete(t.sparkSession, folder)


def apart(key: Column | str, kind: str = "long") -> Column:
    """The same key as a new expression. An aggregate's rows lie by its key already, so a join on that key would not move
    them, and then the other side's partition of a hot key cannot be split; joined on this, both sides are exchanged."""
    c = F.col(key) if isinstance(key, str) else key
    return F.concat(c, F.lit("") if kind == "string" else F.lit(b"")) if kind != "long" else c + F.lit(0).cast("long")


def release(spark: SparkSession) -> None:
    """Ask the driver to drop shuffle files of finished jobs that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A name in the shared folder that no one else uses."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def forget(spark: SparkSession) -> int:
    """Delete what this driver's operators have written to the shared folder so far, and say how many folders.

    Results read those tables lazily, so this is for the caller, who knows that a result is stored.
    """
    deleted = 0
    while _made:
        deleted += _delete(spark, _made.pop())
    return deleted


def _delete(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; works on executors too."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes beyond which a labelled text is left out of a sample, so that a sample is 2 * max_per_class times this at most.
SAMPLE_TEXT_BYTES = 1 << 17


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, max_per_class: int, max_bytes: int = SAMPLE_TEXT_BYTES
) -> list[tuple[str, int]]:
    """Up to `max_per_class` whole texts a class whose crc32(doc_id) leaves another remainder than `held_out`.

    Bound: one text of at most `max_bytes` bytes for each of 2 * max_per_class documents is joined and collected, however
    often a doc_id or a label is repeated. Documents are taken in the order of a hash of doc_id and a repeated one by
    the least hash of its texts, so the sample is the same on each run. Of contrary labels of a document the larger counts.
    """
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    ids = ids.where(F.crc32(F.col("doc_id").cast("string")) % modulus != held_out)
    order = F.xxhash64("doc_id")
    ids = ids.where("y = 1").orderBy(order, "doc_id").limit(max_per_class).union(
        ids.where("y = 0").orderBy(order, "doc_id").limit(max_per_class)
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    met = docs.select("doc_id", text.alias("text")).where(F.octet_length("text") <= max_bytes).join(F.broadcast(ids), "doc_id")
    rows = met.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "y", "t.text").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["y"]))
    return [(r["text"], r["y"]) for r in rows]


def one_thread() -> None:
    """Native libraries of a worker keep to the one core a task has."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
