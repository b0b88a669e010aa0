"""gzip and zlib over binary columns."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

MODES = ("gzip", "deflate", "none")


def compress(data: bytes, mode: str = "gzip", level: int = 6) -> bytes:
    if mode not in MODES:
        raise ValueError(f"compress must be one of {MODES}")
    return gzip.compress(data, level, mtime=0) if mode == "gzip" else zlib.compress(data, level) if mode == "deflate" else data


def decompress(data: bytes, mode: str | None = None) -> bytes:
    """The bytes before compression; without a mode it is told by the first bytes."""
    if mode is None:
        data = memoryview(data).cast("B")
        mode = "gzip" if data[:2] == b"\x1f\x8b" else "deflate" if data[:1] == b"\x78" else "none"
    return gzip.decompress(data) if mode == "gzip" else zlib.decompress(data) if mode == "deflate" else data


def gzipped(column: str, mode: str = "gzip", level: int = 6) -> Column:
    @pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else b if b[:2] == b"\x1f\x8b" else compress(bytes(b), mode, level))

    return run(column)


def plain(column: str) -> Column:
    """The bytes before compression, told by their first bytes."""

    @pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else decompress(bytes(b)))

    return run(column)
