"""Tiles as files z/x/y.pbf, and the metadata beside them."""

from __future__ import annotations

import json
import os

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.storage import filesystem


def write(tiles: DataFrame, folder: str, metadata: dict) -> None:
    """Each task writes its own tiles; a file appears whole or not at all, so a repeated task does no harm.

    The folder must be one that executors share.
    """

    def run(rows):
        store, root = filesystem(folder)
        attempt = TaskContext.get().taskAttemptId()
        for r in rows:
            d = f"{root}/{r.z}/{r.x}"
            store.create_dir(d, recursive=True)
            with store.open_output_stream(f"{d}/.{r.y}.{attempt}") as f:
                f.write(bytes(r.data))
            store.move(f"{d}/.{r.y}.{attempt}", f"{d}/{r.y}.pbf")

    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    tiles.select("z", "x", "y", "data").foreachPartition(run)
    with store.open_output_stream(f"{root}/metadata.json") as f:
        f.write(json.dumps(metadata).encode())


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(z, x, y, data) of all tiles under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pbf").load(folder)
    at = lambda k: F.regexp_extract("path", r"/(\d+)/(\d+)/(\d+)\.pbf$", k).cast("int")
    return files.select(at(1).alias("z"), at(2).alias("x"), at(3).alias("y"), F.col("content").alias("data"))


def tile(folder: str, z: int, x: int, y: int) -> bytes | None:
    path = f"{folder}/{z}/{x}/{y}.pbf"
    if not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        return f.read()
