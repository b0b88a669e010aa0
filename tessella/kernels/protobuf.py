"""The few parts of the protobuf wire format that tiles and map extracts use."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

VARINT, I64, LEN, I32 = 0, 1, 2, 5


def uvarint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def unzigzag(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def signed(n: int) -> int:
    """A varint read as a 64-bit two's complement number."""
    return n - (1 << 64) if n >> 63 else n


def number(field: int, n: int) -> bytes:
    return uvarint(field << 3 | VARINT) + uvarint(n & (1 << 64) - 1)


def block(field: int, data: bytes) -> bytes:
    return uvarint(field << 3 | LEN) + uvarint(len(data)) + data


def double(field: int, v: float) -> bytes:
    return uvarint(field << 3 | I64) + struct.pack("<d", v)


def single(field: int, v: float) -> bytes:
    return uvarint(field << 3 | I32) + struct.pack("<f", v)


def packed(field: int, values) -> bytes:
    return block(field, b"".join(uvarint(v & (1 << 64) - 1) for v in values))


def packed_deltas(field: int, values) -> bytes:
    out, last = [], 0
    for v in values:
        out.append(zigzag(v - last))
        last = v
    return packed(field, out)


def read_uvarint(b, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7
        if shift > 63:
            raise ValueError("varint too long")


def fields(b) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value): numbers for varints, memory for the rest."""
    b, at = memoryview(b), 0
    while at < len(b):
        tag, at = read_uvarint(b, at)
        kind = tag & 7
        if kind == VARINT:
            v, at = read_uvarint(b, at)
        elif kind == LEN:
            n, at = read_uvarint(b, at)
            if at + n > len(b):
                raise ValueError("field ends beyond the message")
            v, at = b[at : at + n], at + n
        elif kind in (I64, I32):
            n = 8 if kind == I64 else 4
            v, at = b[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, kind, v


def varints(b) -> np.ndarray:
    """All varints of a packed field at once."""
    raw = np.frombuffer(b, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(raw < 128)
    start = np.append(0, last[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(start, last - start + 1)
    parts = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.bitwise_or.reduceat(parts, start)


def varint_matrix(values) -> tuple[np.ndarray, np.ndarray]:
    """Varints of whole numbers as rows of bytes, and how many bytes of each row count."""
    v = np.asarray(values).astype(np.uint64)
    wide = max(1, -(-int(v.max()).bit_length() // 7)) if len(v) else 1
    size = np.ones(len(v), np.int64)
    for k in range(1, wide):
        size += v >= np.uint64(1 << 7 * k)
    out = (v[:, None] >> (7 * np.arange(wide)).astype(np.uint64)).astype(np.uint8) & 127
    out |= (np.arange(wide) < size[:, None] - 1).astype(np.uint8) << 7
    return out, size


def joined_rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Rows of several (bytes, how many count), side by side, one after another."""
    mask = np.hstack([np.arange(m.shape[1]) < n[:, None] for m, n in parts])
    return np.hstack([m for m, _ in parts])[mask].tobytes()


def varint_bytes(values) -> bytes:
    return joined_rows([varint_matrix(values)])


def zigzags(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.int64)
    return (v << 1 ^ v >> 63).view(np.uint64)


def svarints(b) -> np.ndarray:
    """Zigzag numbers of a packed field."""
    return unzigzags(varints(b))


def deltas(b) -> np.ndarray:
    return np.cumsum(svarints(b))


# many messages at once


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each row, one row after another."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each row's values."""
    total, end = np.append(0, np.cumsum(values)), np.cumsum(counts)
    return total[end] - total[end - counts]


def row_deltas(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Differences within each row as zigzag numbers; a row's first value is as it is."""
    d = np.diff(values, prepend=np.int64(0))
    first = (np.cumsum(counts) - counts)[counts > 0]
    d[first] = values[first]
    return zigzags(d)


def row_totals(numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Running sums within each row: row_deltas read back."""
    d = unzigzags(numbers)
    total, first = np.append(np.int64(0), np.cumsum(d)), np.cumsum(counts) - counts
    return total[1:] - np.repeat(total[first], counts)


def unzigzags(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)


def varint_sizes(values) -> np.ndarray:
    """Bytes of each varint."""
    v = np.asarray(values).astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, -(-int(v.max()).bit_length() // 7) if len(v) else 1):
        size += v >= np.uint64(1 << 7 * k)
    return size


def messages(field: int, parts: list[tuple]) -> bytes:
    """A message of a field for each row, joined. parts: (field, values, counts) in order; counts: of each row's packed list,
    None for one number a row. Fields are under 16."""
    made = []
    body, tokens = 0, 2
    for k, v, counts in parts:
        size = varint_sizes(v)
        if counts is None:
            made.append((k << 3 | VARINT, v, v, None))
            body, tokens = body + 1 + size, tokens + 2
        else:
            size = row_sums(size, counts)
            made.append((k << 3 | LEN, size, v, counts))
            body, tokens = body + 1 + varint_sizes(size) + size, tokens + 2 + counts
    tokens = np.broadcast_to(tokens, np.shape(body))
    out, at = np.empty(int(tokens.sum()), np.uint64), np.cumsum(tokens) - tokens
    out[at], out[at + 1] = field << 3 | LEN, body
    at = at + 2
    for tag, head, v, counts in made:
        out[at], out[at + 1] = tag, head
        at = at + 2
        if counts is not None:
            out[ranges(at, counts)] = v
            at = at + counts
    return varint_bytes(out)


def spans(b: bytes, field: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the values with a length of one field."""
    starts, ends, at, size, wanted = [], [], 0, len(b), field << 3 | LEN
    while at < size:
        tag = b[at]
        if tag < 128:
            at += 1
        else:
            tag, at = read_uvarint(b, at)
        kind = tag & 7
        if kind == LEN:
            n, at = read_uvarint(b, at)
            if at + n > size:
                raise ValueError("field ends beyond the message")
            if tag == wanted:
                starts.append(at)
                ends.append(at + n)
            at += n
        elif kind == VARINT:
            _, at = read_uvarint(b, at)
        elif kind in (I64, I32):
            at += 8 if kind == I64 else 4
        else:
            raise ValueError(f"wire type {kind}")
    return np.array(starts, np.int64), np.array(ends, np.int64)


class Messages:
    """Messages that stand in b at starts..ends, read field by field in all of them at once; a repeated field's last value counts."""

    def __init__(self, b: bytes, starts: np.ndarray, ends: np.ndarray):
        self.raw = np.frombuffer(b + bytes(20), np.uint8)
        self.n = len(starts)
        self.found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        rows, at = np.arange(self.n), np.array(starts)
        while True:
            rows = rows[at[rows] < ends[rows]]
            if not len(rows):
                break
            tag, place = self._uvarints(at[rows])
            kind = (tag & np.uint64(7)).astype(np.int64)
            fixed = np.isin(kind, (I64, I32))
            if not (fixed | (kind == VARINT) | (kind == LEN)).all():
                raise ValueError("unknown wire type")
            after_tag = place
            value, place = self._uvarints(np.where(fixed, 0, place))
            room = ends[rows] - np.where(fixed, after_tag, place)
            n = np.where(fixed, np.where(kind == I64, 8, 4), np.where(kind == LEN, np.minimum(value, np.uint64(1 << 40)).astype(np.int64), 0))
            if (n > room).any():
                raise ValueError("field ends beyond the message")
            place = np.where(fixed, after_tag, place)
            for t in np.unique(tag):
                some = tag == t
                has, number, begin = self.found.setdefault((int(t) >> 3, int(t) & 7), (np.zeros(self.n, bool), np.zeros(self.n, np.uint64), np.zeros(self.n, np.int64)))
                has[rows[some]], number[rows[some]], begin[rows[some]] = True, value[some], place[some]
            at[rows] = place + n

    def _uvarints(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, where they end) of varints that begin at places."""
        first = self.raw[at]
        value, size = (first & 127).astype(np.uint64), np.ones(len(at), np.int64)
        more = np.flatnonzero(first > 127)
        for k in range(1, 11):
            if not len(more):
                return value, at + size
            if k == 10:
                break
            c = self.raw[at[more] + k]
            value[more] |= (c & 127).astype(np.uint64) << np.uint64(7 * k)
            size[more] += 1
            more = more[c > 127]
        raise ValueError("varint too long")

    def has(self, field: int, kind: int) -> np.ndarray:
        return self.found[field, kind][0] if (field, kind) in self.found else np.zeros(self.n, bool)

    def numbers(self, field: int) -> np.ndarray:
        """A number of every message."""
        if not self.has(field, VARINT).all():
            raise ValueError(f"a message has no field {field}")
        return self.found[field, VARINT][1] if self.n else np.zeros(0, np.uint64)

    def lists(self, field: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, how many of each message) of a packed field."""
        if (field, LEN) not in self.found:
            return np.zeros(0, np.uint64), np.zeros(self.n, np.int64)
        has, size, start = self.found[field, LEN]
        size = np.where(has, size, 0).astype(np.int64)
        b = self.raw[ranges(start, size)]
        end = np.cumsum(size)[size > 0]
        if len(end) and (b[end - 1] > 127).any():
            raise ValueError("a packed field ends inside a number")
        return varints(b), row_sums(b < 128, size)
