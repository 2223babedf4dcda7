"""Vectorised work on the characters of many texts at once (numpy over Arrow batches)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19  # characters worked on at a time; a longer text is a chunk of its own
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_U = np.uint64


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n."""
    inverse = _U(pow(int(BASE), -1, 1 << 64))
    up, down = np.empty(n, _U), np.empty(n, _U)
    up[0] = down[0] = 1
    up[1:], down[1:] = BASE, inverse
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(CHUNK.bit_length(), int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (finalizer of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def code_points(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first text, code points, bounds of the texts) for chunks of an Arrow string array.

    Null texts count as empty. ``bounds`` has one entry more than texts.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1
        last = min(n, max(last, first + 1))
        part = raw[offsets[first] : offsets[last]]
        lead = np.zeros(len(part) + 1, np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=lead[1:])
        codes = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        yield first, codes, lead[offsets[first : last + 1] - offsets[first]]
        first = last


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; see ``window_hashes``."""
    up, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, _U)
    np.cumsum(mix(codes.astype(_U) + _U(1)) * up[: len(codes)], out=out[1:])
    return out


def window_hashes(prefix: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows of ``length`` that begin at ``at``; equal windows have equal hashes wherever they lie."""
    _, down = powers(len(prefix))
    return mix((prefix[at + length] - prefix[at]) * down[at])


def sliding_last_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the position of its least one, the last of equals.

    The low 28 bits give way to the position, so windows compare by their upper 36 bits.
    """
    n = len(values)
    bits = _U(28)
    low = _U((1 << 28) - 1)
    keys = (values & ~low) | (low - np.arange(n, dtype=_U))
    size = 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    if size < width:
        keys = np.minimum(keys[: n - width + 1], keys[width - size : width - size + n - width + 1])
    assert n < (1 << int(bits))
    return (low - (keys & low)).astype(np.int64)
