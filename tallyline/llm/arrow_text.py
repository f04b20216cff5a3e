"""Whole texts of an Arrow batch as flat NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are worked on in pieces of about so many bytes; a longer text is a piece
# of its own, and whole.
PIECE_BYTES = 1 << 19

_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start, rows = 0, batch.num_rows
    while start < rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes (UTF-8) and the n + 1 borders of the texts; null counts as empty."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    borders = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1]
    borders = borders.astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), borders - borders[0]
    return np.frombuffer(data, np.uint8)[borders[0] : borders[-1]], borders - borders[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose result looks random."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def _is_word(separators: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


LOWER = _lower()
SPACES = b" \t\n\v\f\r"
# Everything below 128 but digits and letters (after A-Z are lowered).
NOT_ALNUM = bytes(c for c in range(128) if not chr(c).isalnum())


_BASE = 0x5851F42D4C957F2D
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers_upto(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < size:
        size = 1 << (size - 1).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, A-Z lowered: a polynomial over random
    numbers for the bytes, taken from running sums over all bytes, then mixed."""
    up, down = _powers_upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[LOWER[data]] * up[: len(data)], out=sums[1:])
    spans = (sums[end] - sums[start]) * down[start]
    return mix(spans + (end - start).astype(np.uint64) * GOLDEN)


class Words:
    """The words of some texts, with A-Z lowered: where each starts and ends in
    the bytes, its text's number, and a 64-bit hash."""

    def __init__(self, texts: pa.Array, separators: bytes):
        data, borders = flat_bytes(texts)
        inside = _is_word(separators)[LOWER[data]]
        size = len(data)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = np.zeros(size + 1, bool)
        ends[1:] = inside
        ends[:-1] &= ~inside
        # A word never goes on from one text into the next.
        cuts = borders[(borders > 0) & (borders < size)]
        begins[cuts] = inside[cuts]
        ends[cuts] = inside[cuts - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.borders = borders
        # Words of text i: first[i] up to first[i + 1].
        self.first = np.searchsorted(self.start, borders)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(borders) - 1), self.count)
        self.data = data
        self.hash = span_hashes(data, self.start, self.end)
