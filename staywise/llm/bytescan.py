"""Vectorised scanning of many texts at once: words, lines and hashes over one buffer of UTF-8 bytes.

A ``Block`` holds whole texts, each followed by one line feed, so no word or line crosses two texts. Blocks are cut by bytes
(``BLOCK_BYTES``, a longer text makes a block of its own), which bounds the memory of a task whatever the row sizes are.
"""
import numpy as np

BLOCK_BYTES = 2 << 20
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x):
    """A finaliser that spreads every input bit over 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n):
    """Powers of the odd base modulo 2^64 and of its inverse, for at least ``n`` places."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, np.uint64(base), np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def span_hashes(codes, starts, ends):
    """64-bit hash of each span ``codes[start:end]``; equal spans hash equal wherever they stand."""
    up, down = _power_tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(hashes, width):
    """Hash of each run of ``width`` hashes; the last ``width - 1`` places have none."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        total *= np.uint64(_BASE)
        total += hashes[k : k + n]
    return mix(total)


class Block:
    """Whole texts as one buffer. ``values``: a list of bytes, None stands for an empty text."""

    def __init__(self, values, lower=False):
        values = [v or b"" for v in values]
        self.rows = len(values)
        self.blob = b"\n".join(values) + b"\n" if values else b""
        if lower:
            self.blob = self.blob.lower()
        self.codes = np.frombuffer(self.blob, np.uint8)
        self.row_ends = np.cumsum(np.fromiter((len(v) + 1 for v in values), np.int64, self.rows))
        self.row_starts = self.row_ends - np.diff(self.row_ends, prepend=0)

    def words(self):
        """Starts and ends of the runs without ASCII white space, and the first word of each row (one more at the end)."""
        space = SEPARATORS[self.codes]
        edges = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        starts, ends = edges[0::2], edges[1::2]
        return starts, ends, np.append(np.searchsorted(starts, self.row_starts), len(starts))

    def per_row(self, flags):
        """Sum of a per-byte array over each row."""
        return np.add.reduceat(flags, self.row_starts, dtype=np.int64) if self.rows else np.zeros(0, np.int64)


def in_row_windows(first, width):
    """Places of an array over words where ``width`` words of one row begin, and the row of each."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    begin = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
    return np.arange(len(rows)) - begin[rows] + first[:-1][rows], rows


def binary_values(column):
    """The UTF-8 bytes of an Arrow text column as a Python list."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def slices(values, limit=BLOCK_BYTES):
    """Index ranges of consecutive values of about ``limit`` bytes, at least one value each."""
    start = size = 0
    for k, value in enumerate(values):
        step = len(value or b"") + 1
        if size and size + step > limit:
            yield start, k
            start, size = k, 0
        size += step
    if start < len(values):
        yield start, len(values)
