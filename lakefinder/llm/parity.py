"""Parity sketches of shingle sets and the block keys on which similar sets must meet.

Every shingle toggles one bit of a sketch of many bits, so two sketches differ in at most
as many bits as the sets differ in elements: the Hamming distance bounds the symmetric
difference from below.  Sets with a Jaccard similarity of num/den or more differ in at most
(den - num) * (a + b) / (den + num) elements, d say.  Cut a sketch into d + 1 + e blocks:
then 1 + e blocks at least are equal, and an equal block's content is a join key.

A block is weak for a set if it holds fewer than a few of the set's shingles; weak blocks
would be the keys on which sets meet that have little in common.  A set with e weak blocks
or fewer gives no key for them: one of the 1 + e equal blocks is not weak.  A set with more
gives another hash's keys too, and a pair that has only weak blocks in common consists of
two such sets, so it meets under that hash.  The last hash gives a key to every block, empty
ones too.  So no pair is lost.

Sets that hold a common passage share the keys of blocks that the passage alone fills.  Against
these, sketches are cut into h blocks more, so that 1 + h equal blocks at least are not weak
(under the last hash: 1 + h + e, weak ones counted), and each set may do without the h keys
(under the last hash h + e) that most sets have, in an order of all keys that every set goes
by: the rarest of the keys that two similar sets share has h others behind it in both sets'
order, so neither goes without it.  The low bits of a key, its tag, say which band and hash it is of.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from lakefinder.llm.words import mix

#: Width of a size band, in steps of den / num: a set lies in WIDEN / (WIDEN - 1) bands on average.
WIDEN = 3
SEEDS = 3
#: A block of this many shingles on average may ask for 1, 2 or 3 of them, so as not to be weak.
ENOUGH = (0, 5, 7)
#: Of a sketch's blocks one in so many is there for keys that a set may do without; deviations beyond the expected number of weak blocks.
MORE, SURE = 6, 1.5
#: Bits of a key that name its band and hash.
TAG_BITS = 12
_U = np.uint64
_SEED = [_U(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]


def most_apart(a: int, b: int, num: int, den: int) -> int:
    """The largest symmetric difference of similar sets of a and b elements."""
    return (den - num) * (a + b) // (den + num)


@lru_cache(maxsize=8)
def bands(num: int, den: int, limit: int = 1 << 33) -> tuple[np.ndarray, ...]:
    """Bands of sizes: lowest, highest, blocks, weak blocks allowed, keys a set may do without, shingles asked of a block; similar sets have a band in common."""
    out, low = [], 1
    same = -(-(den + num) // (2 * (den - num))) - 1  # up to this size similar sets are equal
    while low < limit:
        high = max(low, low * den**WIDEN // num**WIDEN, same if low <= same else 0)
        d = most_apart(high, high, num, den)
        more = (d + 1) // MORE
        base, spare, least = d + 1 + more, 0, sum(low / (d + 1 + more) >= x for x in ENOUGH)
        for _ in range(20 if d else 0):  # blocks for weak ones make blocks weaker
            b = base + spare
            mean = low / b
            weak = b * sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(least))
            spare = min(math.ceil(weak + SURE * math.sqrt(weak)), base)
        out.append((low, high, base + spare, spare, more, least))
        low = max(low + 1, -(-num * (high + 1) // den))
    if len(out) * SEEDS >> TAG_BITS:
        raise ValueError("sets so similar need more bands than a key's tag can name")
    return tuple(np.array(x, np.int64) for x in zip(*out, strict=True))


def allowances(num: int, den: int) -> list[int]:
    """For each tag, how many of a set's keys with that tag, those that most sets have, it may do without."""
    _, _, _, spare, more, _ = bands(num, den)
    return [int(more[j] + (spare[j] if seed == SEEDS - 1 else 0)) for j in range(len(more)) for seed in range(SEEDS)]


def keys(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """The join keys of one set, from its distinct shingle hashes.

    Sets so small that only equal ones are similar have no keys.
    """
    n = len(shingles)
    low, high, blocks, spare, _, least = bands(num, den)
    found = [shingles[:0]]
    for j in range(int(np.searchsorted(high, n)), int(np.searchsorted(low, n, "right"))):
        b = int(blocks[j])
        if b == 1:
            continue
        for seed in range(SEEDS):
            last = seed == SEEDS - 1
            tag = _U(j * SEEDS + seed)
            g = mix(shingles ^ _SEED[seed])
            at = ((g >> _U(32)) * _U(b)) >> _U(32)
            order = np.argsort(at.astype(np.uint16 if b < 65536 else np.uint64), kind="stable")
            at = at[order]
            first = np.flatnonzero(np.diff(at, prepend=_U(b)))
            code = mix((g[order] & _U(0xFFFFFFFF)) + _SEED[(seed + 1) % SEEDS])  # stands for the bit toggled, one of 2**32
            of_block, block = np.bitwise_xor.reduceat(code, first), at[first]
            if last:
                none = np.setdiff1d(np.arange(b, dtype=np.uint64), block)
                of_block, block = np.concatenate((of_block, np.zeros(len(none), np.uint64))), np.concatenate((block, none))
            else:
                full = np.diff(first, append=len(at)) >= least[j]
                of_block, block = of_block[full], block[full]
            found.append(mix(of_block ^ mix(block + (tag << _U(40)))) >> _U(TAG_BITS) << _U(TAG_BITS) | tag)
            if len(block) >= b - spare[j]:
                break
    return np.concatenate(found)


def sketch(shingles: np.ndarray, num: int, den: int) -> bytes:
    """A parity sketch of a power of two of bits, about eight for each element in which similar sets may differ."""
    bits = 64
    while bits < 8 * most_apart(len(shingles), len(shingles), num, den):
        bits *= 2
    n = np.bincount((shingles & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(n.astype(np.uint8)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """The distance of two sketches; the longer is folded, which can only lessen the distance."""
    if len(a) < len(b):
        a, b = b, a
    x = np.frombuffer(a, np.uint8).reshape(-1, len(b))
    return int(np.bitwise_count(np.bitwise_xor.reduce(x, axis=0) ^ np.frombuffer(b, np.uint8)).sum())


def about_apart(a: bytes, b: bytes) -> float:
    """The symmetric difference that the distance of two sketches lets one expect."""
    bits = 8 * min(len(a), len(b))
    return -bits / 2 * math.log(max(1 - 2 * hamming(a, b) / bits, 1 / bits))
