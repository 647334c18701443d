"""Numpy helpers shared by the operators: batches of texts as one byte array, words, and content names.

A *unit* is a group of rows whose texts are concatenated into one uint8 array ``x`` with document
boundaries ``off`` (n + 1 offsets). Nulls are empty. Units are bounded by ``UNIT_ROWS`` and by ``UNIT_BYTES`` unless one
document is longer; arrays wider than a byte are then built over slices (``SLICE``) of it.

*Names* are 64-bit hashes of content, the same in every task; they choose candidates and partitions. *Ids* are numbers
of one unit, equal exactly where the bytes are; decisions are made on ids, digests of 128 bits, or the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UNIT_BYTES, UNIT_ROWS = 2 << 20, 4096
SLICE = 1 << 20
U64 = np.uint64

#: ASCII white space of the words pattern: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tune(spark) -> None:
    """Small Arrow batches, so that a Python worker holds few long documents at once.

    The two settings are read when a plan runs, so they stay set in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


#: A name of each single byte.
BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    x = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return x, off - off[0]


def units(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = UNIT_BYTES, rows: int = UNIT_ROWS) -> Iterator[pa.Table]:
    """Regroup record batches into tables of about ``limit`` bytes of ``column`` and at most ``rows`` rows."""
    held, size, count = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, cum = 0, np.cumsum(lengths)
        while at < batch.num_rows:
            room = (cum[at - 1] if at else 0) + max(0, limit - size)
            to = min(batch.num_rows, max(int(np.searchsorted(cum, room, "right")), at + (0 if held else 1)), at + rows - count)
            if to > at:
                held.append(batch.slice(at, to - at))
                size, count = size + int(cum[to - 1] - (cum[at - 1] if at else 0)), count + to - at
                at = to
            if at < batch.num_rows or size >= limit or count >= rows:
                yield pa.Table.from_batches(held)
                held, size, count = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def owner(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row that holds each byte position."""
    return np.searchsorted(off, at, "right") - 1


def word_spans(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run without white space; words never cross documents."""
    if not len(x):
        z = np.zeros(0, np.int64)
        return z, z, z
    w = ~SPACE[x]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    cuts = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(x))]
    first[cuts] = w[cuts]
    last[cuts - 1] = w[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, owner(off, starts)


#: Seeds of names; two lanes are independent.
SEEDS = [U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)]
_MASK = np.array([2 ** (8 * k) - 1 for k in range(9)], U64)


def _blocks(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of spans in blocks of 8, filled up with zeros (an empty span has one); the first block of each span; each block's place in it."""
    wide = np.ndarray((len(x) + 1,), "<u8", np.concatenate([x, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    lengths = ends - starts
    n = np.maximum((lengths + 7) >> 3, 1)
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    left = np.minimum(np.repeat(lengths, n) - 8 * place, 8)
    return wide[np.repeat(starts, n) + 8 * place] & _MASK[left], first, place


def _cuts(starts: np.ndarray, ends: np.ndarray) -> Iterator[slice]:
    """Slices of spans of about SLICE bytes together (but for a longer span)."""
    total = np.cumsum(ends - starts + 8)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, "right")))
        yield slice(at, to)
        at = to


def word_names(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit name of the bytes of each span; equal bytes have equal names everywhere.

    Every block of 8 bytes goes through a finaliser under a key of its place, so unlike a polynomial no pattern of letters
    collides by construction. Different spans can still share a name: see ``exact_ids``.
    """
    out = np.empty(len(starts), U64)
    with np.errstate(over="ignore"):
        for c in _cuts(starts, ends):
            s, e = starts[c], ends[c]
            low = int(s.min())
            block, first, place = _blocks(x[low : int(e.max())], s - low, e - low)
            keys = mix(np.arange(int(place.max()) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + SEEDS[lane])
            out[c] = mix(np.add.reduceat(mix(block ^ keys[place]), first) ^ ((e - s).astype(U64) * U64(0x9E3779B97F4A7C15)))
    return out


def same_bytes(x: np.ndarray, s1: np.ndarray, e1: np.ndarray, s2: np.ndarray, e2: np.ndarray) -> np.ndarray:
    """Whether spans hold the same bytes, pair by pair."""
    out = (e1 - s1) == (e2 - s2)
    todo = np.flatnonzero(out & (s1 != s2))
    for c in _cuts(s1[todo], e1[todo]):
        t = todo[c]
        a, first, _ = _blocks(x, s1[t], e1[t])
        b, _, _ = _blocks(x, s2[t], e2[t])
        out[t] = np.add.reduceat((a != b).astype(np.int64), first) == 0
    return out


def exact_ids(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of spans, equal exactly where their bytes are: found by name, and every span compared with the first of its name."""
    if not len(starts):
        return np.zeros(0, np.int64)
    _, head, ids = np.unique(word_names(x, starts, ends), return_index=True, return_inverse=True)
    first = head[ids]
    if same_bytes(x, starts, ends, starts[first], ends[first]).all():
        return ids
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(x[a:b].tobytes(), len(seen)) for a, b in zip(starts.tolist(), ends.tolist())])


def exact_windows(ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of all windows of k consecutive ids, equal exactly where the ids are (by doubling); len(ids) - k + 1 of them."""
    if len(ids) < k:
        return np.zeros(0, np.int64)
    size = 1
    while size < k:
        step = min(size, k - size)
        ids = np.unique((ids[:-step].astype(U64) << U64(32)) | ids[step:].astype(U64), return_inverse=True)[1]
        size += step
    return ids


def pair_names(left: np.ndarray, right: np.ndarray, salt: int = 0) -> np.ndarray:
    """A name of each ordered pair of names."""
    return mix(left * U64(0x9E3779B97F4A7C15) + (right ^ (right >> U64(29))) * U64(0xC2B2AE3D27D4EB4F) + U64(salt * 2 + 1))


def window_names(h: np.ndarray, k: int) -> np.ndarray:
    """Names of all windows of k consecutive names (by doubling); len(h) - k + 1 of them."""
    if len(h) < k:
        return np.zeros(0, U64)
    size = 1
    while size < k:
        step = min(size, k - size)
        h = pair_names(h[:-step], h[step:], step)
        size += step
    return h


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the offset of its leftmost least value."""
    kind = np.uint8 if w < 256 else np.int32
    size, low, at = 1, h, np.zeros(len(h), kind)
    while size < w:
        step = min(size, w - size)
        less = low[step:] < low[:-step]
        at = np.where(less, at[step:] + kind(step), at[:-step])
        low = np.where(less, low[step:], low[:-step])
        size += step
    return at


def strings(rows: list[bytes], kind=pa.binary()) -> pa.Array:
    return pa.array(rows, kind)
