"""Vectorised byte and word kernels shared by the operators of this subpackage.

Texts come as Arrow string columns; the kernels work on the columns' own UTF-8 buffers, so no
Python string is made for a word or a text.  Word and k-gram identities are 64-bit polynomial hashes over random
byte codes, taken from prefix sums, so every span of a buffer is hashed in a few array operations.  Such hashes modulo
2^64 are weak for long regular strings (two Thue-Morse words of a kilobyte agree), so spans of LONG units or more,
which are rare among words, are hashed one by one by BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
LONG = 128
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C13 | 3  # odd, and 3 modulo 4: few factors of two in its powers' differences


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads the bits of each 64-bit value."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x = x ^ (x >> U64(27))
    x = x * _M2
    return x ^ (x >> U64(31))


_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
LOWER = _lower

WORD = np.zeros(256, dtype=bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True

TOKEN = np.ones(256, dtype=bool)  # [^\x20\x09-\x0D]
TOKEN[0x20] = False
TOKEN[0x09:0x0E] = False


@lru_cache(maxsize=1)
def _powers_of(size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(size, base & (2**64 - 1), dtype=U64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_BASE), run(pow(_BASE, -1, 2**64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, n + 1 at least."""
    return _powers_of(max(1 << 19, 1 << (n + 1).bit_length()))


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which hash_spans() takes the hash of any span of buf."""
    out = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(_CODES[buf] * powers(len(buf))[0][: len(buf)], out=out[1:])
    return out


def hash_spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, units: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the spans [start, end); equal units give equal hashes wherever they are.  units: what sums was made
    of, if spans may have LONG units or more."""
    out = mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(U64))
    if units is not None:
        for i in np.flatnonzero(end - start >= LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(units[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def hash_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """hash_spans() of spans of any length."""
    return hash_spans(prefix(buf), start, end, buf)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about size bytes each; a longer text is alone in its range."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j
        i = j


def words(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of a kind, none across texts, and each text's first run's number (n + 1 of them)."""
    inside = kind[buf]
    n = len(buf)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def grams(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within a text, and each text's first (n + 1 bounds). A text of fewer words, but not none, has one gram of all."""
    total = len(h)
    count = np.diff(bounds)
    have = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out = np.zeros(len(have) + 1, np.int64)
    np.cumsum(have, out=out[1:])
    if not total:
        return np.zeros(0, U64), out
    odd = np.arange(1, 2 * n, 2, dtype=U64) * U64(0xD6E8FEB86659FD93)
    full = np.zeros(max(0, total - n + 1), U64)
    for i in range(n):
        full += h[i : total - n + 1 + i] * odd[i] if total >= n else U64(0)
    text = np.repeat(np.arange(len(have)), have)
    at = np.arange(out[-1]) - out[text] + bounds[:-1][text]
    g = np.zeros(len(at), U64)
    long = count[text] >= n
    g[long] = full[at[long]]
    for k in np.flatnonzero((count > 0) & (count < n)):  # texts of under n words
        s = h[bounds[k] : bounds[k + 1]]
        g[out[k]] = np.append(s * odd[: len(s)], U64(len(s))).sum()
    return mix(g), out


def narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the least unsigned type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


def pack(x: np.ndarray) -> bytes:
    """An array of unsigned numbers as bytes, behind its item size."""
    x = narrow(x) if x.dtype.kind in "iu" and x.dtype != U64 else x
    return bytes([x.dtype.itemsize]) + x.tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=f"<u{b[0]}", offset=1)
