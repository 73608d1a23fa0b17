"""Hashed n-gram features of texts as sparse rows, and what quality and toxicity models share.

A feature is an indicator: whether an n-gram occurs in the text, hashed to one of
2**BITS columns.  Rows are NumPy arrays of distinct columns; pieces of a batch are worked
on at a time, so memory is bounded by the piece and not by the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakefinder.llm.arrow import give_back, tidy
from lakefinder.llm import words as W
from lakefinder.scratch import discard, materialize

_U = np.uint64
#: Rows of the fitting sample that must have a column for it to be learnt.
LEAST_ROWS = 2

#: Reads the columns of all features, with repeats, of the words of a piece: (document, column) arrays.
Features = Callable[[W.Words, int], tuple[np.ndarray, np.ndarray]]


def columns(h: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Hashes of n-grams of one kind to columns."""
    return (W.mix(h ^ _U(kind * 0x9E3779B97F4A7C15 & 2**64 - 1)) >> _U(64 - bits)).astype(np.int64)


def adjacent(w: W.Words, h: np.ndarray, gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Documents and hashes of pairs of words that stand ``gap`` apart in one document."""
    doc = w.doc
    if len(h) <= gap:
        return doc[:0], h[:0]
    same = doc[gap:] == doc[:-gap]
    return doc[:-gap][same], W.mix(h[:-gap][same] * _U(3) + h[gap:][same])


def rows(col: pa.Array, features: Features, bits: int, cased: bool, used: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of documents, offsets, distinct sorted columns) of successive pieces of a text column.

    used: which columns matter, where others may be left out (those without weight).
    """
    for w in W.words(col, W.NON_SPACE, cased=cased):
        doc, at = features(w, bits)
        if used is not None:
            some = used[at]
            doc, at = doc[some], at[some]
        both = np.unique((doc << bits) | at)
        n = w.last - w.first
        yield n, np.searchsorted(both, np.arange(n + 1, dtype=np.int64) << bits), both & ((1 << bits) - 1)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is held out, as nothing may be learnt from it."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int, folds: int = 5, fold: int = 0) -> DataFrame:
    """(text, y, place) of labelled documents outside the held-out fold; at most about ``limit`` of each class.

    Rows are taken by a hash of doc_id and text, the same share of all parts of the table;
    ``limit`` is the documented bound of the fitting sample.  Rows whose label is neither 0 nor 1, and labels that
    repeat a doc_id with different values, teach nothing.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("__y2")).where("y = __y2").select("doc_id", F.col("y").cast("int").alias("y"))
    marks = marks.where(~held_out(F.col("doc_id"), folds, fold))
    size = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.lit(0)
    for y, n in size.items():
        share = F.when(F.col("y") == y, F.lit(min(1 << 30, int((1 << 30) * limit / n)))).otherwise(share)
    chosen = marks.withColumn("place", place).where(F.col("place") < share)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "y", "place", "doc_id")


def sample_matrix(sample: DataFrame, features: Features, bits: int, cased: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bounded sample as a sparse matrix on the driver: offsets, columns, labels; in a fixed order.

    Only columns that ``LEAST_ROWS`` rows or more of the sample have are kept: what one text alone
    has teaches nothing of others, and is most of what there is.  They are counted where the rows
    are, so the driver gets 2**bits numbers at most, and then rows without the rare columns.
    """
    sample = materialize(sample, "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for _, _, cols in rows(batch.column(0), features, bits, cased):
                n += np.bincount(cols, minlength=1 << bits).astype(np.int32)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int32())], ["col", "n"])

    frequent = sample.mapInArrow(tidy(count), "col int, n int").groupBy("col").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_ROWS).select("col")
    used = np.zeros(1 << bits, bool)
    used[frequent.toArrow().column(0).to_numpy()] = True
    shared = sample.sparkSession.sparkContext.broadcast(np.packbits(used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            done = 0
            for n, offs, cols in rows(batch.column(0), features, bits, cased, used):
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(cols.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists, *(batch.column(k).slice(done, n) for k in (1, 2, 3))], ["cols", "y", "place", "doc_id"])
                done += n

    found = sample.mapInArrow(tidy(run), T.StructType([*T.StructType.fromDDL("cols array<int>, y int, place long"), sample.schema["doc_id"]])).toArrow().sort_by([("place", "ascending"), ("doc_id", "ascending")])
    shared.destroy()
    discard(sample)
    lists = found.column(0).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    offs = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)))) if len(lists) else np.zeros(1, np.int64)
    got = offs, lists.flatten().to_numpy(zero_copy_only=False).copy(), found.column(1).to_numpy().astype(np.int64)
    del found, lists
    give_back()
    return got


def packed(values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """A mostly empty array as its length, the places that are not 0, and what stands there."""
    at = np.flatnonzero(values).astype(np.int32)
    return len(values), at, values[at]


def unpacked(size: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(size, values.dtype)
    out[at] = values
    return out


def some_rows(offs: np.ndarray, cols: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen rows of a sparse matrix."""
    lists = [cols[offs[i] : offs[i + 1]] for i in which]
    return np.concatenate(([0], np.cumsum(list(map(len, lists))))).astype(np.int64), np.concatenate([cols[:0], *lists])


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))), fitted by Newton's method to smoothed targets."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack((margin, np.ones(len(margin))))
    scale = max(float(np.abs(margin).max()), 1e-9)
    x[:, 0] /= scale
    ab = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        gradient = x.T @ (p - target)
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        ab -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return float(ab[0] / scale), float(ab[1])


def score(docs: DataFrame, features: Features, bits: int, cased: bool, model, text_col: str = "text", out: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` (without its text, unless that is to be kept) with ``out``: ``model.scores(offsets, columns)`` of whole texts.

    The model is broadcast: those of its 2**bits numbers that are not 0.
    """
    kept = [f for f in docs.schema if f.name != out and (keep_text or f.name != text_col)]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        used = model.used()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            found = [model.scores(offs, cols) for _, offs, cols in rows(texts, features, bits, cased, used)]
            got = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), pa.array(got, pa.float64())], schema.names)

    return docs.drop(out).mapInArrow(tidy(run), schema)
