"""Whole Arrow batches of texts as flat byte arrays, for vectorised work inside tasks.

Hashes are polynomials over the bytes modulo 2**64 passed through a mixer, so every worker names the same string
alike and no per-word Python runs. Memory is a small multiple of ``CHUNK_BYTES`` or of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: What is neither an ASCII letter or digit nor part of a longer character.
SIGNS = np.array([not (b >= 0x80 or chr(b).isalnum()) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept by the worker for the usual chunk."""
    if "up" not in _powers or len(_powers["up"]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    up, down = _powers["up"], _powers["down"]
    if len(up) > 8 * CHUNK_BYTES:
        _powers.clear()
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants), in place on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets between them; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64) if len(at) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for each chunk of a column."""
    raw, offsets = flat(column)
    for i, j in chunks(offsets):
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def word_bounds(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` (or of runs of bytes not in ``between``), and for each text the number of its first word."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = ~between[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1]
    first[at[at < len(raw)]] = inside[at[at < len(raw)]]
    last = np.zeros(len(raw) + 1, bool)
    last[1:] = inside[:-1] & ~inside[1:]
    cut = offsets[1:]
    cut = cut[cut > 0]
    last[cut] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = powers(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return LOWER[raw]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
