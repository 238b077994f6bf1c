"""Vectorised word splitting and hashing of Arrow text columns.

Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. A word's hash is a polynomial over a fixed
random table of byte values, finished with a bijective mix, so equal words have equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; bounds the temporary arrays.
WINDOW = 1 << 18
#: Bytes of text in a slice of a batch; a longer text is a slice of its own.
SLICE = 4 << 20
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)
U64 = np.uint64

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=U64) | U64(1)
#: The values of bytes as they are; in _BYTE A-Z have those of a-z.
AS_IS = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, WINDOW)
        for name, base in (("up", _R), ("down", _R_INVERSE)):
            x = np.full(size, base, U64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) for slices of a text column; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + SLICE, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def words(raw: np.ndarray, offs: np.ndarray, values: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, offsets of the rows among the words) of all words; with the values AS_IS case counts."""
    n = len(raw)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e.astype(U64), np.zeros(len(offs), np.int64)
    inside = ~_SEPARATOR[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offs[:-1][offs[:-1] < n]
    first[at] = inside[at]
    at = offs[1:][offs[1:] > 0] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    del inside, first, last
    hashes = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + WINDOW, "right")))
        base, top = starts[i], ends[j - 1]
        up, down = _power(int(top - base))
        sums = np.cumsum(values[raw[base:top]] * up[: top - base], dtype=U64)
        s, e = starts[i:j] - base, ends[i:j] - base
        h = sums[e - 1]
        h[s > 0] -= sums[s[s > 0] - 1]
        hashes[i:j] = mix(h * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return starts, ends, hashes, np.searchsorted(starts, offs)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; row i is the run that starts at word i. Rows' bounds are the caller's matter."""
    n = max(0, len(hashes) - k + 1)
    h = np.full(n, k, U64)
    for i in range(k):
        h = mix(h * U64(0xC2B2AE3D27D4EB4F) + hashes[i : i + n])
    return h
