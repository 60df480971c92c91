"""Words and shingles of whole texts as numpy arrays, read from Arrow buffers.

Words are maximal runs of bytes other than space and ``\\x09``-``\\x0D``. Every
word gets a 64-bit hash that depends on its bytes alone, so equal words have
equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
STEP = U64(0xD6E8FEB86659FD93)
GROUP_BYTES = 4 << 20
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, from exponent 0."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        inverse = pow(int(BASE), -1, 1 << 64)
        tables = []
        for factor in (BASE, U64(inverse)):
            steps = np.full(size, factor, U64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def _hash_slice(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(raw))
    weighted = (raw.astype(U64) + U64(1)) * up[: len(raw)]
    total = np.cumsum(weighted)
    value = (total[ends - 1] - total[starts] + weighted[starts]) * down[starts]
    return mix(value + (ends - starts).astype(U64) * STEP)


class Words:
    """Words of a group of texts: byte bounds, hashes and the first word of each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool):
        offsets = offsets.astype(np.int64) - int(offsets[0])
        n = len(raw)
        if lower and n:
            raw = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
        self.raw = raw
        if n == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hashes = np.zeros(0, U64)
        else:
            word = ~_SPACE[raw]
            begins, stops = word.copy(), word.copy()
            begins[1:] &= ~word[:-1]
            stops[:-1] &= ~word[1:]
            inner = offsets[(offsets > 0) & (offsets < n)]
            begins[inner] = word[inner]
            stops[inner - 1] = word[inner - 1]
            self.starts = np.flatnonzero(begins)
            self.ends = np.flatnonzero(stops) + 1
            self.hashes = self._hash()
        self.first = np.searchsorted(self.starts, offsets)

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.starts), U64)
        at = 0
        while at < len(self.starts):
            begin = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, begin + SLICE_BYTES, side="right")))
            piece = slice(at, to)
            out[piece] = _hash_slice(
                self.raw[begin : self.ends[to - 1]], self.starts[piece] - begin, self.ends[piece] - begin
            )
            at = to
        return out

    def runs(self, width: int) -> np.ndarray:
        """Hash of the ``width`` words from each position; wrong where a run leaves its text."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, U64)
        value = np.zeros(n, U64)
        for j in range(width):
            value *= STEP
            value += self.hashes[j : j + n]
        return mix(value + U64(width))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """All shingle hashes text after text, and the bounds of each text's part.

        A text with fewer than ``width`` words, but at least one, has its whole
        word sequence as its only shingle.
        """
        counts = np.diff(self.first)
        full = np.maximum(counts - width + 1, 0)
        per_text = np.where((full == 0) & (counts > 0), 1, full)
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        out = np.empty(int(bounds[-1]), U64)
        runs = self.runs(width)
        long = np.flatnonzero(full)
        if len(long):
            text = np.repeat(long, full[long])
            within = np.arange(len(text)) - np.repeat(np.cumsum(full[long]) - full[long], full[long])
            out[bounds[text] + within] = runs[self.first[text] + within]
        for t in np.flatnonzero((full == 0) & (counts > 0)):
            value = U64(0)
            with np.errstate(over="ignore"):
                for h in self.hashes[self.first[t] : self.first[t + 1]]:
                    value = value * STEP + h
                out[bounds[t]] = mix(np.array([value + U64(counts[t])], U64))[0]
        return out, bounds


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_utf8())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def groups(batch: pa.RecordBatch, text: str = "text", limit: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text (one row at least)."""
    raw, bounds = text_buffer(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        to = min(to, batch.num_rows)
        part = bounds[at : to + 1]
        yield batch.slice(at, to - at), raw[part[0] : part[-1]], part - part[0]
        at = to
