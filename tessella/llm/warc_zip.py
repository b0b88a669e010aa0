"""WARC records in ZIP-packaged archives: written by tasks, read back by range.

An archive is a ZIP of stored members: `archive/data.warc.gz` (one gzip member per record) and `indexes/index.cdx`
(a line per record: page, offset and length in that member). The reader opens nothing but the ends and ranges it needs:
the end-of-central-directory record, its ZIP64 forms where a size or count says so, the central directory, the index
member, then each record's own range. Nothing is extracted.

A task writes its archives under names of its own and reports them in rows that are checkpointed, so only archives of
tasks that succeeded are read; archives go to the folder that driver and executors share.

Defined results: null html is an empty payload; payloads under `min_revisit` bytes never revisit; of equal longer payloads
the smallest page_id is the response and the others revisit it, a null page_id (no candidate itself) among them; rows
that repeat the smallest page_id with that payload are all responses; every row of the table gives a row; a very long page
is one record; an empty table gives no archive and no row; other columns are not read, whatever their names.
"""

from __future__ import annotations

import gzip
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import apart, checkpoint, filesystem, new_folder, slices, small_batches

#: An archive closes beyond this; a task holds one archive's compressed records.
ARCHIVE_BYTES = 16 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_LOCAL, _CENTRAL, _END, _END64, _AT64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_32 = 0xFFFFFFFF


class ZipWriter:
    """Stored members one after another on a stream; ZIP64 where sizes or counts need it, or throughout if `always64`."""

    def __init__(self, stream, always64: bool = False):
        self.out, self.at, self.entries, self.always64 = stream, 0, [], always64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, chunks: list[bytes]) -> int:
        """Store a member; gives where its data starts."""
        size, crc, start = sum(map(len, chunks)), 0, self.at
        for c in chunks:
            crc = zlib.crc32(c, crc)
        big = self.always64 or size >= _32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        raw, short = name.encode(), _32 if big else size
        self._put(struct.pack("<4s5H3I2H", _LOCAL, 45 if big else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra)) + raw + extra)
        data = self.at
        for c in chunks:
            self._put(c)
        self.entries.append((raw, crc, size, start))
        return data

    def close(self) -> int:
        start = self.at
        for raw, crc, size, where in self.entries:
            big = self.always64 or size >= _32 or where >= _32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, where) if big else b""
            short, place = (_32, _32) if big else (size, where)
            self._put(
                struct.pack("<4s6H3I5H2I", _CENTRAL, 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, place)
                + raw + extra
            )
        length, n = self.at - start, len(self.entries)
        if self.always64 or start >= _32 or n >= 0xFFFF:
            where = self.at
            self._put(struct.pack("<4sQ2H2I4Q", _END64, 44, 45, 45, 0, 0, n, n, length, start))
            self._put(struct.pack("<4sIQI", _AT64, 0, where, 1))
            self._put(struct.pack("<4s4H2IH", _END, 0, 0, 0xFFFF, 0xFFFF, _32, _32, 0))
        else:
            self._put(struct.pack("<4s4H2IH", _END, 0, 0, n, n, length, start, 0))
        return self.at


class ZipReader:
    """Members of an archive by name, found from its directories; data is read by range."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size
        self.found: dict[str, tuple[int, int]] = {}
        tail_at = max(0, size - 65_557)
        tail = self._range(tail_at, size - tail_at)
        end = tail.rfind(_END)
        if end < 0:
            raise ValueError("not a ZIP archive: no end of central directory")
        _, _, _, _, n, length, start, _ = struct.unpack("<4s4H2IH", tail[end : end + 22])
        if n == 0xFFFF or length == _32 or start == _32:
            mark = self._range(tail_at + end - 20, 20)
            if mark[:4] != _AT64:
                raise ValueError("ZIP64 locator missing")
            where = struct.unpack("<4sIQI", mark)[2]
            *_, n, length, start = struct.unpack("<4sQ2H2I4Q", self._range(where, 56))
        self.members: dict[str, tuple[int, int, int, int]] = {}
        data, at = self._range(start, length), 0
        for _ in range(n):
            f = struct.unpack("<4s6H3I5H2I", data[at : at + 46])
            if f[0] != _CENTRAL:
                raise ValueError("central directory entry expected")
            method, crc, packed, size_, name_n, extra_n, note_n, place = f[4], f[7], f[8], f[9], f[10], f[11], f[12], f[16]
            name = data[at + 46 : at + 46 + name_n].decode()
            extra = data[at + 46 + name_n : at + 46 + name_n + extra_n]
            packed, place = self._wide(extra, size_, packed, place)
            self.members[name] = (method, crc, packed, place)
            at += 46 + name_n + extra_n + note_n

    @staticmethod
    def _wide(extra: bytes, size: int, packed: int, place: int) -> tuple[int, int]:
        """Packed size and place, from the ZIP64 field where the entry says 0xFFFFFFFF: it holds just those, in order."""
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                if size == _32:
                    next(values)
                packed = next(values) if packed == _32 else packed
                place = next(values) if place == _32 else place
            at += 4 + n
        return packed, place

    def _range(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError(f"archive ends before {at + n}")
        return bytes(data)

    def stored(self, name: str) -> tuple[int, int]:
        """Where a stored member's data starts, and its size."""
        if name in self.found:
            return self.found[name]
        method, _, size, place = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        head = struct.unpack("<4s5H3I2H", self._range(place, 30))
        if head[0] != _LOCAL:
            raise ValueError("local header expected")
        self.found[name] = place + 30 + head[9] + head[10], size
        return self.found[name]

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        start, size = self.stored(name)
        n = size - at if n is None else n
        if at < 0 or at + n > size:
            raise ValueError("range beyond the member")
        data = self._range(start + at, n)
        if n == size and zlib.crc32(data) != self.members[name][1]:
            raise ValueError(f"{name} is damaged")
        return data


def record(url: str, page: int | None, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record. A revisit has no payload of its own."""
    body = b"" if revisit else payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record; raises on a damaged one."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) < n + 4 or rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("record ends early")
    return fields, rest[:n]


def plan_records(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """page_id, url, payload, digest, and what a revisit refers to (null: a response)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    long = F.length("payload") >= min_revisit
    # digests that occur twice are few; their least page is found before any payload moves
    twice = p.where(long).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("least")).where("n > 1")
    return p.join(twice.select(apart("digest", "string").alias("d2"), "least"), long & (F.col("digest") == F.col("d2")), "left").select(
        "page_id", "url", "payload", "digest", "least"
    )


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, size, n) of the archives written, checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        chunks: list[bytes] = []
        index: list[str] = []
        at = number = 0

        def close() -> pa.RecordBatch:
            nonlocal at, number
            path = f"{folder}/part-{task.partitionId()}-{task.taskAttemptId()}-{number}.wacz"
            with fs.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}") as out:
                z = ZipWriter(out)
                z.add(DATA, chunks)
                z.add(INDEX, ["\n".join(index).encode()])
                size = z.close()
            row = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([len(index)])], names=["path", "size", "n"])
            chunks.clear()
            index.clear()
            at, number = 0, number + 1
            return row

        for batch in batches:
            for part in slices(batch, "payload"):
                for page, url, payload, digest, least in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    revisit = least is not None and least != page
                    data = gzip.compress(record((url or "").replace("\r", "").replace("\n", ""), page, payload, digest, least, revisit), 6, mtime=0)
                    chunks.append(data)
                    index.append(json.dumps({"page": page, "offset": at, "length": len(data)}))
                    at += len(data)
                    if at >= archive_bytes:
                        yield close()
        if index:
            yield close()

    small_batches(records.sparkSession)
    return checkpoint(records.select("page_id", "url", "payload", "digest", "least").mapInArrow(run, "path string, size long, n long"))


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives: page_id, url, record_type, refers_to, digest named, and the payload (null: revisit).

    Records are located by the index members, then range-read one by one. The archives are dealt by number, one to a task:
    a list of them is small whatever they hold, so partitions must not be merged by its size. archives: checkpointed.
    """
    schema = "page_id long, url string, record_type string, refers_to long, named_digest string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = [x.split()[0] for x in schema.split(", ")]

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = filesystem(path)
                with fs.open_input_file(place) as f:
                    z = ZipReader(f, size)
                    rows, held = [], 0
                    for line in z.read(INDEX).splitlines():
                        entry = json.loads(line)
                        fields, block = parse(gzip.decompress(z.read(DATA, entry["offset"], entry["length"])))
                        revisit = fields["WARC-Type"] == "revisit"
                        refers = int(fields["WARC-Refers-To"][10:-1]) if revisit else None
                        rows.append((entry["page"], fields["WARC-Target-URI"], fields["WARC-Type"], refers, fields["WARC-Payload-Digest"][7:], None if revisit else block))
                        held += len(block)
                        if held > 4 << 20:
                            yield emit(rows)
                            rows, held = [], 0
                    if rows:
                        yield emit(rows)

    return archives.select("path", "size").repartition(max(1, archives.count())).mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str | None = None, min_revisit: int = 100) -> DataFrame:
    """Write each page as a record, read all back, and describe every page's full payload.

    A response is described by the bytes read back; a revisit by those of the response it refers to.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    read = read_archives(write_archives(plan_records(pages, min_revisit), folder))
    own = checkpoint(
        read.select(
            "page_id", "record_type", "refers_to", "named_digest",
            F.length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("found"),
        )
    )
    sizes = own.where("record_type = 'response'").groupBy("found").agg(F.max("n").alias("size")).select(apart("found", "string").alias("of"), "size")
    damaged = F.raise_error(F.concat(F.lit("payload differs from its digest: page "), F.col("page_id").cast("string")))
    return own.join(sizes, F.col("named_digest") == F.col("of"), "left").select(
        "page_id",
        F.when(F.col("size").isNull() | (F.col("found") != F.col("named_digest")), damaged.cast("long")).otherwise(F.col("size")).alias("payload_bytes"),
        F.col("named_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


#: DuckDB SQL over `pages` for the same rows.
ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, min(page_id) AS least FROM p GROUP BY digest)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN p.n >= 100 AND p.page_id <> g.least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.n >= 100 AND p.page_id <> g.least THEN g.least END AS refers_to
FROM p JOIN g ON p.digest = g.digest
"""
