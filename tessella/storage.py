"""Files wherever they are: local paths, or URIs that pyarrow's file systems know. Readers and writers go through here."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


def filesystem(uri: str):
    """(pyarrow file system, path) of a path or URI; works in any process."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def local_path(uri: str) -> str | None:
    """The path of a local file, None for any other."""
    return None if "://" in uri and not uri.startswith("file:") else "/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri


def open_input(uri: str):
    """A file to read and seek in."""
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    store, place = filesystem(uri)
    return store.open_input_file(place)


def open_output(uri: str):
    """A new file; its folder is made if need be."""
    store, place = filesystem(uri)
    store.create_dir(os.path.dirname(place) or ".", recursive=True)
    return store.open_output_stream(place)


def size(uri: str) -> int:
    store, place = filesystem(uri)
    return store.get_file_info(place).size


@contextlib.contextmanager
def on_disk(uri: str) -> Iterator[str]:
    """A local path of a file, for libraries that need one: its own, or that of a copy for the time being."""
    path = local_path(uri)
    if path is not None:
        yield path
        return
    with tempfile.TemporaryDirectory() as folder:
        path = f"{folder}/{uri.rsplit('/', 1)[1]}"
        with open_input(uri) as source, open(path, "wb") as to:
            shutil.copyfileobj(source, to, 1 << 20)
        yield path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
        if now.isDefined():
            return now.get()
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
