"""Byte-level helpers shared by the Arrow-batched operators.

Everything here works on the raw UTF-8 buffers of an Arrow string column, so a batch of
documents is hashed, split and scanned with numpy and never turned into Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rolling-hash base (odd, hence invertible modulo 2**64) and its inverse.
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)

_POWERS: dict[int, np.ndarray] = {}
#: Powers kept by a worker; more are made anew when asked for, as workers outlive tasks.
KEPT_POWERS = 1 << 19


def _give_back() -> None:
    """Have freed arrays of a megabyte or more returned to the system at once; by default the allocator learns to keep larger and larger ones."""
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


_give_back()


def release() -> None:
    """Give what a task has freed back to the system; workers outlive tasks, and others need the memory."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling; the first KEPT_POWERS are kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = np.empty(size, np.uint64)
        out[0] = 1
        done, step = 1, base & MASK
        while done < size:
            np.multiply(out[:done], np.uint64(step), out=out[done : 2 * done])
            done, step = 2 * done, step * step & MASK
        have = out
        if size <= KEPT_POWERS:
            _POWERS[base] = out
    return have[:n]


def byte_codes(seed: int, fold_case: bool = False) -> np.ndarray:
    """A random odd 64-bit code for each byte value; with fold_case, A-Z get the codes of a-z."""
    codes = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    """Hash of data[start:end] for arrays of bounds: eight bytes at a time go through the finaliser, so it isn't linear in them."""
    size = end - start
    out = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    left, at = np.arange(len(size)), start
    done = 0
    while len(left):
        eight = np.ascontiguousarray(padded[at[:, None] + np.arange(8)]).view("<u8")[:, 0]
        short = np.uint64(8) * (np.uint64(8) - np.minimum(size[left] - done, 8).astype(np.uint64))
        out[left] = mix((out[left] ^ (eight << short)) + np.uint64(0xC2B2AE3D27D4EB4F))
        done += 8
        left = left[size[left] > done]
        at = start[left] + done
    return out


def prefix_hash(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Prefix sums of code(byte) * BASE**position; see span_hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of data[start:end] for arrays of bounds; independent of where the span stands."""
    return (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start]


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about `most` bytes, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b
