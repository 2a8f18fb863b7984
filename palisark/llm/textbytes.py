"""Vectorised work on the UTF-8 bytes of an Arrow text column.

The helpers take whole columns of many documents at once. ``span_hash`` is a polynomial hash modulo 2**64 over a fixed
random byte table, for short windows that overlap: it has families of colliding strings from 2,048 bytes on, and serves
only for windows that are shorter, or whose bytes are compared afterwards. ``word_hash`` mixes block after block and has
no such families.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.Philox(20240611))
#: A random 64-bit value for each byte, and the base of the polynomial with its inverse modulo 2**64.
BYTE_VALUES = _rng.integers(0, 2**64, 256, dtype=U64)
BASE = int(_rng.integers(0, 2**62)) * 4 + 3
BASE_INVERSE = pow(BASE, -1, 2**64)
#: The ASCII white space of the contracts: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A to Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty. Nothing is copied but the offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        # Arrow leaves the bytes under a null undefined: copy the valid ones together.
        keep = column.is_valid().to_numpy(zero_copy_only=False)
        parts = [body[a:b] for a, b, k in zip(at[:-1], at[1:], keep) if k]
        sizes = np.where(keep, at[1:] - at[:-1], 0)
        body = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        return body, np.concatenate([[0], np.cumsum(sizes)])
    return body[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes; a longer document has a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


_powers = np.ones(1, U64)
_inverse = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << int(n).bit_length()
        for name, base in (("_powers", BASE), ("_inverse", BASE_INVERSE)):
            out = np.ones(size, U64)
            have = 1
            step = base
            while have < size:  # doubling: out[have:2*have] = out[:have] * base**have
                out[have : 2 * have] = out[:have] * U64(step)
                step = step * step % 2**64
                have *= 2
            globals()[name] = out
    return _powers, _inverse


def prefix_hash(body: np.ndarray) -> np.ndarray:
    """P[i] = sum of value(body[j]) * BASE**j for j < i, modulo 2**64."""
    up, _ = powers(len(body) + 1)
    out = np.zeros(len(body) + 1, U64)
    np.cumsum(BYTE_VALUES[body] * up[: len(body)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each span, wherever it stands."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole word (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Bytes up to which ``word_hash`` takes all words at once; longer ones are digested one by one.
LONG_WORD = 64


def word_hash(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span: eight bytes at a time, each step a bijection of what came before. One to one up to 8 bytes."""
    size = end - start
    h = mixed(np.minimum(size, LONG_WORD + 1).astype(U64) + U64(0x632BE59BD9B4E019))
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(body) + 1,), "<u8", buffer=padded, strides=(1,))
    short = np.flatnonzero(size <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        short = short[size[short] > k]
        if not len(short):
            break
        left = np.minimum(size[short] - k, 8).astype(U64)
        h[short] = mixed(h[short] ^ (eight[start[short] + k] << (U64(64) - U64(8) * left)))
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = np.frombuffer(hashlib.blake2b(body[start[i] : end[i]].tobytes(), digest_size=8).digest(), "<u8")[0]
    return h


def word_spans(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of bytes that aren't ASCII white space; runs never cross documents."""
    if not len(body):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~SPACE[body]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(body))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for size[0] items, then the next range."""
    size = size.astype(np.int64)
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = size > 0
    start, size = start[keep].astype(np.int64), size[keep]
    at = np.cumsum(size)[:-1]
    out[0] = start[0]
    out[at] = start[1:] - (start[:-1] + size[:-1] - 1)
    return np.cumsum(out)
