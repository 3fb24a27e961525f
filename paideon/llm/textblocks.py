"""Words and hashes of Arrow text columns in numpy, a few megabytes at a time.

Word hashes are 64-bit sums of random byte values times powers of an odd number,
taken from running sums, so that one pass over the bytes gives all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 4 << 20  # rows handled together; only speed and memory depend on it
BLOCK_BYTES = 1 << 20  # bytes hashed together, cut at separators

_random = np.random.default_rng(20240229)
_BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

WHITE_SPACE = np.zeros(256, bool)
WHITE_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_code = np.arange(256)
NOT_ALPHANUMERIC = (_code < 0x80) & ~(
    ((_code >= 0x30) & (_code <= 0x39)) | ((_code >= 0x61) & (_code <= 0x7A)) | ((_code >= 0x41) & (_code <= 0x5A)))
LOWER_ASCII = np.where((_code >= 0x41) & (_code <= 0x5A), _code + 32, _code).astype(np.uint8)

_powers: dict[str, np.ndarray] = {}


def _power_table(kind: str, base: int, length: int) -> np.ndarray:
    table = _powers.get(kind)
    if table is None or len(table) < length:
        steps = np.full(length, base, np.uint64)
        steps[0] = 1
        table = _powers[kind] = np.multiply.accumulate(steps)
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def row_groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` text bytes, one row at least."""
    offsets = text_offsets(column)
    first, rows = 0, len(column)
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, rows)
        yield first, last
        first = last


def text_offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], kind) if column.buffers()[1] else np.zeros(1, kind)
    return raw[column.offset:column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the rows and where each begins; the column has no nulls."""
    offsets = text_offsets(column)[first:last + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _cuts(separator: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    begin, size = 0, len(separator)
    while begin < size:
        end = min(begin + BLOCK_BYTES, size)
        if end < size:
            row = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            spaces = np.flatnonzero(separator[begin:end])
            space = begin + int(spaces[-1]) if len(spaces) else begin
            if max(row, space) > begin:
                end = max(row, space)
            else:  # a word longer than the block
                later = np.flatnonzero(separator[end:])
                after = int(offsets[np.searchsorted(offsets, begin, "right")])
                end = min(after, end + int(later[0]) if len(later) else size)
        yield begin, end
        begin = end


class Words:
    """Words of consecutive rows: hash, row, and byte range within `data`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool):
        self.data, self.offsets = data, offsets
        if lower:
            data = LOWER_ASCII[data]
        self.lowered = data
        separator = separators[data]
        letter = ~separator
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.ones(len(data), bool)
        before[1:] = separator[:-1]
        after = np.ones(len(data), bool)
        after[:-1] = separator[1:]
        self.begin = np.flatnonzero(letter & (before | edge[:-1]))
        self.end = np.flatnonzero(letter & (after | edge[1:])) + 1
        bounds = np.searchsorted(self.begin, offsets)
        self.counts = np.diff(bounds)
        self.first = bounds
        self.hashes = np.empty(len(self.begin), np.uint64)
        for a, b in _cuts(separator, offsets):
            i, j = np.searchsorted(self.begin, (a, b))
            if i == j:
                continue
            powers = _power_table("up", _BASE, max(b - a, BLOCK_BYTES))
            sums = np.empty(b - a + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE_VALUES[data[a:b]] * powers[:b - a], out=sums[1:])
            down = _power_table("down", _BASE_INVERSE, max(b - a, BLOCK_BYTES))
            at = self.begin[i:j] - a
            self.hashes[i:j] = mix((sums[self.end[i:j] - a] - sums[at]) * down[at])

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def words_of(column: pa.Array, first: int, last: int, separators: np.ndarray = WHITE_SPACE, lower: bool = False) -> Words:
    data, offsets = text_bytes(column, first, last)
    return Words(data, offsets, separators, lower)


def window_hashes(words: Words, size: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `size` words of one row, and the index of its first word."""
    n = len(words.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    factor = 1
    step = (0xD6E8FEB86659FD93 + 2 * seed) & ((1 << 64) - 1) | 1
    for j in range(size):
        factor = factor * step & ((1 << 64) - 1)
        total += words.hashes[j:j + n] * np.uint64(factor)
    row = words.rows
    starts = np.flatnonzero(row[:n] == row[size - 1:])
    return mix(total[starts]), starts


def sequence_hashes(words: Words, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the word sequence [begin, end) for each pair of word indices."""
    n = len(words.hashes)
    size = max(n + 1, 1 << 20)
    up, down = _power_table("word up", _BASE, size), _power_table("word down", _BASE_INVERSE, size)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hashes * up[:n], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
