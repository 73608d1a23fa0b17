"""Benchmark decontamination by a prefix-filtered set join with exact containment over item-sized windows.

A window is ``window`` consecutive words of a benchmark item (an item of fewer words is one
window).  Containment of a window in a document needs every shingle of the window, so one
shingle is a sufficient prefix: the rarest, by a count over all documents.  Documents are
joined on those prefix shingles alone; a joined pair must pass the length and positional
bounds (the window, put where the shingle stands, lies within the document) and then the
words themselves are compared.

The benchmark is taken in blocks of at most ``BLOCK_BYTES`` of text (one item at least), so
what is broadcast is bounded however large the benchmark is; each block is one more pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lakefinder.llm import words as W
from lakefinder.llm.arrow import tidy
from lakefinder.scratch import materialize

#: Text of the benchmark in one broadcast; as arrays it takes some ten times that.
BLOCK_BYTES = 8 << 20
FILTER_BITS = 22
SPANS = "array<struct<s:int,e:int>>"


@dataclass
class Windows:
    """The distinct windows of a block of items, as places in the items' words."""

    buf: np.ndarray  #: bytes of the items, after lower-casing
    start: np.ndarray  #: of each word, in buf
    end: np.ndarray
    hash: np.ndarray  #: of each word
    first: np.ndarray  #: first word of each window
    length: np.ndarray  #: in words
    ends: np.ndarray  #: items of window b are item[ends[b] : ends[b + 1]]
    item: np.ndarray  #: numbers of items
    ids: list[str]  #: of items, in ascending order
    shingle: int

    def sizes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Shingle length, the windows that use it, and the hashes of shingles that begin at each word."""
        size = np.minimum(self.length, self.shingle)
        for s in np.unique(size).tolist():
            yield s, np.flatnonzero(size == s), W.sequence_hash(self.hash, s)

    def shingles(self) -> dict[int, np.ndarray]:
        """The distinct shingles of all windows, by length, sorted."""
        out = {}
        for s, own, at in self.sizes():
            most = int(self.length[own].max())
            some = [at[self.first[own[self.length[own] >= s + k]] + k] for k in range(most - s + 1)]
            out[s] = np.unique(np.concatenate(some))
        return out


def windows_of(items: list[tuple[str | None, str | None]], window: int, shingle: int) -> Windows:
    """The distinct windows of (id, text) items.

    A null text, or one without words, has no windows; windows of items whose id is null name no
    item; items that repeat an id are one item of several texts; no items give no windows.
    """
    ids = sorted({i for i, _ in items if i is not None})
    number = {x: k for k, x in enumerate(ids)}
    bufs, starts, ends, hashes, sizes, base = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for w in W.words(pa.array([t for _, t in items], pa.string()), W.ALNUM):
        bufs.append(W.LOWER[w.buf])
        starts.append(w.start + base)
        ends.append(w.end + base)
        hashes.append(w.hash)
        sizes.append(np.diff(w.offs))
        base += len(w.buf)
    h, n = np.concatenate(hashes), np.concatenate(sizes)
    item = np.array([-1 if i is None else number[i] for i, _ in items], np.int64)
    head = np.cumsum(n) - n
    length = np.minimum(n, window)
    count = np.where(n > 0, n - length + 1, 0)
    first = np.repeat(head - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    length, item = np.repeat(length, count), np.repeat(item, count)
    code = np.zeros(len(first), np.uint64)
    for size in np.unique(length).tolist():
        own = np.flatnonzero(length == size)
        code[own] = W.mix(W.sequence_hash(h, size)[first[own]] + np.uint64(size))
    _, at, which = np.unique(code, return_index=True, return_inverse=True)
    same = length == length[at[which]]
    for k in range(window):  # windows are the same if their words are, not if one hash is
        inside = np.flatnonzero(same & (k < length))
        same[inside] = h[first[inside] + k] == h[first[at[which[inside]]] + k]
    other = np.flatnonzero(~same)
    which[other] = len(at) + np.arange(len(other))
    at = np.concatenate((at, other))
    named = np.flatnonzero(item >= 0)
    pairs = np.unique(which[named] * max(1, len(ids)) + item[named])
    of = pairs // max(1, len(ids))
    return Windows(
        np.concatenate(bufs), np.concatenate(starts).astype(np.int32), np.concatenate(ends).astype(np.int32), h,
        first[at].astype(np.int32), length[at].astype(np.int32), np.searchsorted(of, np.arange(len(at) + 1)).astype(np.int32), (pairs % max(1, len(ids))).astype(np.int32), ids, shingle,
    )


class Lookup:
    """Finds which of many hashes are in a set: a bit filter first, then binary search."""

    def __init__(self, keys: np.ndarray):
        """keys: distinct and sorted."""
        self.keys = keys
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that hold a key, and the number of that key."""
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[k] == h[at]
        return at[same], k[same]


def runs(w: W.Words, size: int, look: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Word positions where a shingle of ``look`` stands within one document, and its number."""
    at, k = look.find(W.sequence_hash(w.hash, size))
    doc = np.searchsorted(w.offs, at, "right") - 1
    inside = at + size <= w.offs[doc + 1]
    return at[inside], k[inside]


def count_shingles(docs: DataFrame, text_col: str, shingles: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each of the given shingles (by length, sorted) occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(shingles)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks = {size: Lookup(keys) for size, keys in shared.value.items()}
        total = {size: np.zeros(len(look.keys), np.int64) for size, look in looks.items()}
        for batch in batches:
            for w in W.words(batch.column(0), W.ALNUM):
                for size, look in looks.items():
                    np.add.at(total[size], runs(w, size, look)[1], 1)
        for size, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), size, np.int32)), pa.array(looks[size].keys[some].view(np.int64)), pa.array(n[some])], ["size", "shingle", "n"])

    found = docs.select(text_col).mapInArrow(tidy(count), "size int, shingle long, n long").groupBy("size", "shingle").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    size, key, n = (found.column(k).to_numpy() for k in range(3))
    out = {s: np.zeros(len(keys), np.int64) for s, keys in shingles.items()}
    for s, keys in shingles.items():
        own = size == s
        out[s][np.searchsorted(keys, key[own].view(np.uint64))] = n[own]
    return out


def prefixes(win: Windows, shingles: dict[int, np.ndarray], frequency: dict[int, np.ndarray]) -> dict[int, tuple[Lookup, np.ndarray, np.ndarray, np.ndarray]]:
    """For each shingle length: the prefix shingles, and in CSR form the windows they stand for and their offsets."""
    out = {}
    for size, own, at in win.sizes():
        n = np.full(len(own), np.iinfo(np.int64).max)
        best, off = np.zeros(len(own), np.uint64), np.zeros(len(own), np.int64)
        for k in range(int(win.length[own].max()) - size + 1):
            some = np.flatnonzero(win.length[own] >= size + k)
            x = at[win.first[own[some]] + k]
            f = frequency[size][np.searchsorted(shingles[size], x)]
            rarer = (f < n[some]) | ((f == n[some]) & (x < best[some]))
            some, x, f = some[rarer], x[rarer], f[rarer]
            n[some], best[some], off[some] = f, x, k
        seen = np.flatnonzero(n)  # a shingle that no document has rules the window out
        order = seen[np.argsort(best[seen], kind="stable")]
        if len(order):
            keys, first = np.unique(best[order], return_index=True)
            out[size] = (Lookup(keys), np.append(first, len(order)), own[order], off[order])
    return out


def matches(w: W.Words, win: Windows, pre: dict) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which a window begins, and the window's number."""
    starts, which = [], []
    for size, (look, ends, windows, offsets) in pre.items():
        at, k = runs(w, size, look)
        n = ends[k + 1] - ends[k]
        place = np.repeat(at, n)
        csr = np.repeat(ends[k] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        window = windows[csr]
        begin = place - offsets[csr]
        doc = np.searchsorted(w.offs, place, "right") - 1
        fits = (begin >= w.offs[doc]) & (begin + win.length[window] <= w.offs[doc + 1])  # positional and length bounds
        starts.append(begin[fits])
        which.append(window[fits])
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none
    start, window = np.concatenate(starts), np.concatenate(which)
    for k in range(int(win.length.max(initial=0))):
        if not len(start):
            break
        long = win.length[window]
        theirs = win.hash[np.minimum(win.first[window] + k, len(win.hash) - 1)]
        ok = (k >= long) | (w.hash[np.minimum(start + k, len(w.hash) - 1)] == theirs)
        start, window = start[ok], window[ok]
    exact = np.fromiter((same_words(w, a, win, b) for a, b in zip(start.tolist(), window.tolist(), strict=True)), bool, len(start))
    return start[exact], window[exact]


def same_words(w: W.Words, at: int, win: Windows, window: int) -> bool:
    """Whether the words from ``at`` on are those of the window, byte by byte."""
    first = int(win.first[window])
    for k in range(int(win.length[window])):
        if not np.array_equal(W.LOWER[w.buf[w.start[at + k] : w.end[at + k]]], win.buf[win.start[first + k] : win.end[first + k]]):
            return False
    return True


def find_windows(docs: DataFrame, text_col: str, win: Windows, pre: dict, keep_text: bool) -> DataFrame:
    """``docs`` (without its text, unless that is to be kept) with n_words, merged spans of hit words, and the items that occur."""
    added = T.StructType.fromDDL(f"__n_words long, __spans {SPANS}, __items array<string>")
    kept = [c for c in docs.columns if keep_text or c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in kept), *added])
    shared = docs.sparkSession.sparkContext.broadcast((win, pre))
    span_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win, pre = shared.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for w in W.words(batch.column(batch.schema.get_field_index(text_col)), W.ALNUM):
                start, window = matches(w, win, pre)
                n = w.last - w.first
                own_spans: list[list[dict]] = [[] for _ in range(n)]
                own_items: list[set[str]] = [set() for _ in range(n)]
                order = np.argsort(start, kind="stable")
                docs_of = (np.searchsorted(w.offs, start[order], "right") - 1).tolist()
                for d, a, b in zip(docs_of, start[order].tolist(), window[order].tolist(), strict=True):
                    a -= int(w.offs[d])
                    e = a + int(win.length[b])
                    if own_spans[d] and a <= own_spans[d][-1]["e"]:
                        own_spans[d][-1]["e"] = max(e, own_spans[d][-1]["e"])
                    else:
                        own_spans[d].append({"s": a, "e": e})
                    own_items[d].update(win.item[win.ends[b] : win.ends[b + 1]].tolist())
                n_words.append(np.diff(w.offs))
                spans += own_spans
                items += [[win.ids[k] for k in sorted(own)] for own in own_items]
            n_all = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(n_all, pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))], schema.names)

    return docs.mapInArrow(tidy(find), schema)


def _marked(rows: DataFrame, benchmark: DataFrame, window: int, shingle: int, text_col: str, item_col: str, item_text_col: str, keep_text: bool) -> DataFrame:
    """``rows`` with __n_words, __spans and __items, over all blocks of the benchmark."""
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("body"))
    size = bench.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / BLOCK_BYTES))
    if n_blocks > 1:  # rows are numbered once and for all, as every block reads them anew
        rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = []
    for b in range(n_blocks):
        block = bench if n_blocks == 1 else bench.where(F.pmod(F.xxhash64("item", "body"), F.lit(n_blocks)) == b)
        win = windows_of([(r.item, r.body) for r in block.toLocalIterator()], window, shingle)
        shingles = win.shingles()
        frequency = count_shingles(rows, text_col, shingles) if shingles else {}
        found.append(find_windows(rows, text_col, win, prefixes(win, shingles, frequency), keep_text))
    if n_blocks == 1:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    own = [c for c in every.columns if c not in ("__row", "__spans", "__items")]
    return every.groupBy("__row").agg(
        *(F.first(c).alias(c) for c in own),
        F.array_sort(F.flatten(F.collect_list("__spans"))).alias("__spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"),
    ).drop("__row")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Find in every document the windows of benchmark items.

    Words are runs of letters a-z, digits and characters beyond ASCII, after lower-casing
    A-Z.  Returns one row per document: doc_id, n_words, spans (ranges [s, e) of the words
    that lie in an occurrence of a window; sorted) and items (ids, as strings, of the items of
    which a window occurs; sorted).

    A null text has no words, and an item without words has no windows.  Windows of items
    whose id is null count as hits but name no item; rows that repeat an item_id are one
    item of several texts.  Rows that repeat a doc_id are looked at singly.  An empty
    benchmark hits nothing; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))
    found = _marked(rows, benchmark, window, shingle, "body", item_col, item_text_col, keep_text=False)
    return found.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__spans").alias("spans"), F.col("__items").alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which a window of a benchmark item occurs; all columns stay as they are."""
    found = _marked(docs, benchmark, window, shingle, text_col, item_col, item_text_col, keep_text=True)
    return found.where(F.size("__spans") == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def n_hit(spans: str = "spans"):
    """How many words the spans (sorted, perhaps overlapping) cover."""
    return F.expr(
        f"aggregate({spans}, struct(0L as n, 0 as till), "
        "(a, x) -> struct(a.n + greatest(0, x.e - greatest(x.s, a.till)) as n, greatest(a.till, x.e) as till), a -> a.n)"
    )
