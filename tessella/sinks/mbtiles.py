"""MBTiles: tiles in SQLite, rows counted from the south. Read, write and merge."""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import sqlite3
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.sinks.compression import decompress
from tessella.storage import local_path, on_disk, open_output

#: Rows of the file that a task reads.
ROWS = 4096


def flip(z: int, y: int) -> int:
    return (1 << z) - 1 - y


def create(path: str, merge: bool = False) -> sqlite3.Connection:
    if os.path.exists(path) and not merge:
        os.remove(path)
    con = sqlite3.connect(path)
    # fixed values of the format: its tables and columns
    con.executescript(
        "PRAGMA synchronous=OFF; PRAGMA journal_mode=MEMORY;"
        "CREATE TABLE IF NOT EXISTS metadata (name text, value text, UNIQUE (name));"
        "CREATE TABLE IF NOT EXISTS tiles (zoom_level integer, tile_column integer, tile_row integer, tile_data blob, UNIQUE (zoom_level, tile_column, tile_row));"
    )
    return con


def write(tiles: DataFrame, path: str, metadata: dict, merge: bool = False) -> int:
    """Tiles (z, x, y, data) into a file on the driver, a partition in memory at a time; gives how many.

    SQLite wants one writer, so compressing and encoding are done before, by all tasks. A file in a store is made on the
    driver's disk and then copied.
    """
    if local_path(path) is None:
        with tempfile.TemporaryDirectory() as folder:
            own = f"{folder}/tiles.mbtiles"
            if merge:
                with on_disk(path) as old:
                    shutil.copy(old, own)
            n = write(tiles, own, metadata, merge)
            with open(own, "rb") as source, open_output(path) as to:
                shutil.copyfileobj(source, to, 1 << 20)
            return n
    path = local_path(path)
    con, n = create(path, merge), 0
    verb = "REPLACE" if merge else "INSERT"
    with con:
        rows = []
        for r in tiles.select("z", "x", "y", "data").toLocalIterator(prefetchPartitions=True):
            rows.append((r.z, r.x, flip(r.z, r.y), bytes(r.data)))
            n += 1
            if len(rows) >= 500:
                con.executemany(f"{verb} INTO tiles VALUES (?, ?, ?, ?)", rows)
                rows = []
        con.executemany(f"{verb} INTO tiles VALUES (?, ?, ?, ?)", rows)
        for k, v in metadata.items():
            con.execute("REPLACE INTO metadata VALUES (?, ?)", (k, v if isinstance(v, str) else json.dumps(v)))
    con.close()
    return n


def metadata(path: str) -> dict[str, str]:
    with on_disk(path) as own, contextlib.closing(sqlite3.connect(f"file:{own}?mode=ro", uri=True)) as con:
        return dict(con.execute("SELECT name, value FROM metadata"))


def bounds(path: str) -> tuple[float, ...]:
    return tuple(float(v) for v in metadata(path)["bounds"].split(","))


def tile(path: str, z: int, x: int, y: int) -> bytes | None:
    """One tile, decompressed."""
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        row = con.execute("SELECT tile_data FROM tiles WHERE zoom_level=? AND tile_column=? AND tile_row=?", (z, x, flip(z, y))).fetchone()
        return None if row is None else decompress(row[0])
    finally:
        con.close()


class MbtilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self):
        with on_disk(self.path) as path, contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
            ends = con.execute("SELECT min(rowid), max(rowid) FROM tiles").fetchone()
        if ends[0] is None:
            return [InputPartition((0, 0))]
        return [InputPartition((a, min(a + ROWS, ends[1] + 1))) for a in range(ends[0], ends[1] + 1, ROWS)]

    def read(self, partition):
        with on_disk(self.path) as path, contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
            found = con.execute("SELECT zoom_level, tile_column, tile_row, tile_data FROM tiles WHERE rowid >= ? AND rowid < ?", partition.value)
            for z, x, row, data in found:
                yield z, x, flip(z, row), bytes(data)


class MbtilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessella_mbtiles"

    def schema(self) -> str:
        return "z int, x int, y int, data binary"

    def reader(self, schema):
        return MbtilesReader(dict(self.options))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All tiles of a file, a partition for each ROWS of them."""
    spark.dataSource.register(MbtilesSource)
    return spark.read.format("tessella_mbtiles").option("path", path).load()
