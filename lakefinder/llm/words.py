"""Words of Arrow text columns as NumPy arrays: positions and 64-bit hashes, whole batches at a time.

Texts are cut into words where a byte is not a word byte.  All the delimiters used here
are ASCII, so bytes of UTF-8 may be looked at singly.  A batch is worked on in pieces of
about ``PIECE`` bytes, which bounds memory; a longer text is cut at delimiters into
pieces whose words are then joined again, so no text is shortened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_U64 = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_table(inside) -> np.ndarray:
    """A table of 256 booleans: which bytes belong to words."""
    return np.fromiter((bool(inside(b)) for b in range(256)), bool, 256)


#: ``[^\x20\x09-\x0D]+``
NON_SPACE = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after lower-casing
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0x80)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = _U64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        np.cumprod(np.full(n - 1, _BASE), out=up[1:])
        np.cumprod(np.full(n - 1, inverse), out=down[1:])
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64; grown to a power of two."""
    return _powers(max(2 * PIECE, 1 << (n + 1).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the public splitmix64 constants)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


@dataclass
class Words:
    """The words of documents ``first`` to ``last`` - 1 of a batch; word i of document d is at offs[d] + i."""

    first: int
    last: int
    buf: np.ndarray  #: bytes of the texts
    start: np.ndarray  #: of each word, in buf
    end: np.ndarray
    hash: np.ndarray  #: uint64, of the word after lower-casing A-Z (unless cased)
    offs: np.ndarray  #: first word of each document, and the total
    bounds: np.ndarray  #: first byte of each document in buf, and the total

    @property
    def doc(self) -> np.ndarray:
        """The document (counted from ``first``) of each word."""
        return np.repeat(np.arange(self.last - self.first), np.diff(self.offs))


def split(buf: np.ndarray, bounds: np.ndarray, inside: np.ndarray, cased: bool = False) -> tuple[np.ndarray, ...]:
    """start, end, hash and first word of each document; bounds: where documents begin in buf, and its length."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), np.zeros(len(bounds), np.int64)
    word = inside[buf]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last[:-1] &= ~word[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    codes = (buf if cased else LOWER[buf]).astype(np.uint64)
    codes += _U64(1)
    codes *= up[:n]
    np.cumsum(codes, out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    h = mix(h ^ ((end - start).astype(np.uint64) * _U64(0xD6E8FEB86659FD93)))
    return start, end, h, np.searchsorted(start, bounds)


def _text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def pieces(col: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, bounds) of successive documents of about ``limit`` bytes together, one at least."""
    data, offs = _text_buffers(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n, i + 4096)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(col: pa.Array, inside: np.ndarray, cased: bool = False, limit: int = PIECE) -> Iterator[Words]:
    """The words of all texts of a column; null has none."""
    for i, j, buf, bounds in pieces(col, limit):
        if len(buf) <= 2 * limit:
            yield Words(i, j, buf, *split(buf, bounds, inside, cased), bounds)
            continue
        found, at = [], 0  # one long text
        while at < len(buf):
            to = min(at + limit, len(buf))
            while to < len(buf) and inside[buf[to]]:  # to the end of the word
                more = np.flatnonzero(~inside[buf[to : to + limit]])
                to = to + int(more[0]) if len(more) else min(to + limit, len(buf))
            s, e, h, _ = split(buf[at:to], np.array([0, to - at]), inside, cased)
            found.append((s + at, e + at, h))
            at = to
        s, e, h = (np.concatenate(x) for x in zip(*found, strict=True))
        yield Words(i, j, buf, s, e, h, np.array([0, len(s)]), bounds)


def sequence_hash(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of ``n`` successive words, from the words' hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, _U64(n * 0xA24BAED4963EE407 & 2**64 - 1))
    for k in range(n):
        out = mix(out + h[k : k + m] * _U64(2 * k + 1)) if n > 1 else mix(out + h)
    return out


def shingle_sets(w: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document; of fewer words the whole sequence; of none, none."""
    runs = sequence_hash(w.hash, size)
    for d in range(w.last - w.first):
        a, b = int(w.offs[d]), int(w.offs[d + 1])
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            yield sequence_hash(w.hash[a:b], b - a)
        else:
            yield runs[:0]
