"""Search by vectors: exact nearest neighbours, and an index of centroids for large lakes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lakefinder.functions import similarity as S
from lakefinder.operators.overlap import top_k

#: Query vectors in one broadcast block; more queries are taken in blocks.
BLOCK = 4096
#: Vectors that are compared with a block at once: a matrix of BLOCK * CANDIDATES scores.
CANDIDATES = 1024
#: Queries that are compared with those at once where a score takes several steps; hits that wait for the next cut to the best k.
TILE, PENDING = 256, 1 << 20
#: Scores in one matrix of rows times centroids.
CELLS = 1 << 22


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, threshold: float | None = None, metric: str = "cosine", where: Column | str | None = None, include_self: bool = False, apart: str | None = None) -> DataFrame:
    """The k nearest vectors of each query: exact.

    queries, vectors: (id, embedding), vectors with whatever columns ``where`` tests; the
    filter applies before the ranking, so k rows come where k rows there are.  metric:
    ``cosine`` (a zero vector is like nothing: 0) or ``euclidean`` (score 1 / (1 +
    distance)).  Queries are taken in blocks of ``BLOCK``; every task keeps the best k of its
    vectors for each query, and the best k of those are returned, so no pairs are
    shuffled but these.  Ties go to the smaller id.  A null or differently long vector has no neighbours.
    ``apart``: a column of both sides; vectors with the query's value in it are left out before the ranking.
    """
    if where is not None:
        vectors = vectors.where(where)
    kind = vectors.schema["id"].dataType.simpleString()
    group = (F.lit(None).cast("string") if apart is None else F.col(apart).cast("string")).alias("apart")
    own = queries.select("id", "embedding", group).where("embedding is not null")
    # queries are numbered by hash into blocks, so that a block is what one broadcast holds
    n_blocks = max(1, -(-own.count() // BLOCK))
    found = None
    for b in range(n_blocks):
        block = own if n_blocks == 1 else own.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b)
        part = _block_nearest(block, vectors.select("id", "embedding", group).where("embedding is not null"), k, threshold, metric, kind, include_self)
        found = part if found is None else found.unionByName(part)
    return top_k(found, k, ["query_id"], ["score"], ["id"])


def _block_nearest(block: DataFrame, vectors: DataFrame, k: int, threshold: float | None, metric: str, kind: str, include_self: bool) -> DataFrame:
    got = block.toArrow()
    ids = got.column("id").to_pylist()
    rows = [np.array(v, np.float64) for v in got.column("embedding").to_pylist()]
    dim = max((len(v) for v in rows), default=0)
    use = [i for i, v in enumerate(rows) if len(v) == dim]
    matrix = np.vstack([rows[i] for i in use]) if use else np.zeros((0, dim))
    groups = got.column("apart").to_pylist()
    number = {g: i for i, g in enumerate(dict.fromkeys(g for g in groups if g is not None))}
    group = np.array([number.get(groups[i], -1) for i in use], np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast(([ids[i] for i in use], matrix, number, group))
    query_kind = block.schema["id"].dataType.simpleString()

    def unit(m: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, number, group = shared.value
        qs = unit(q) if metric == "cosine" else q
        names = np.array(names)
        by_name = np.argsort(names, kind="stable")
        best = _Best(len(qs), k)
        for batch in batches:
            lists = batch.column(1)
            fits = np.flatnonzero(lists.value_lengths().to_numpy(zero_copy_only=False) == q.shape[1]) if len(qs) else np.zeros(0, np.int64)
            for at in range(0, len(fits), CANDIDATES):
                part = fits[at : at + CANDIDATES]
                some = batch.take(pa.array(part))
                cand = np.array(some.column(0).to_pylist())
                m = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
                own = np.array([number.get(g, -2) for g in some.column(2).to_pylist()], np.int64)
                few = _few_copies(m, own, cand, k)
                cand, m, own = cand[few], m[few], own[few]
                if metric == "cosine":
                    score = qs @ unit(m).T
                else:
                    square = (qs**2).sum(1)[:, None] + (m**2).sum(1)[None] - 2 * qs @ m.T
                    score = 1 / (1 + np.sqrt(np.maximum(square, 0)))
                if number:
                    score[group[:, None] == own[None]] = -np.inf
                if not include_self:
                    # of each candidate the queries of its id
                    begin, end = (np.searchsorted(names, cand, side, sorter=by_name) for side in ("left", "right"))
                    met = np.repeat(np.arange(len(cand)), end - begin)
                    at_query = np.arange(len(met)) - np.repeat(np.cumsum(end - begin) - end, end - begin)
                    score[by_name[at_query], met] = -np.inf
                # scores are rounded to nine places: what may round to the least of the best k so far is looked at
                least = -best.most
                open_ = np.flatnonzero(np.isneginf(least))
                if len(open_) and score.shape[1] > k:
                    part_scores = score[open_]
                    part_scores[np.isnan(part_scores)] = -np.inf
                    least[open_] = np.partition(part_scores, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                which, place = np.nonzero(score >= least[:, None] - 2e-9)
                rounded = np.round(score[which, place], 9)
                keep = (rounded > -np.inf) & (rounded >= (threshold if threshold is not None else -np.inf)) & (-rounded <= best.most[which])
                best.add(which[keep], -rounded[keep], cand[place[keep]])
                if best.n_waiting >= len(qs) * k:
                    best.cut()
        best.cut()
        query, order, found = best.got or (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, names.dtype))
        yield pa.RecordBatch.from_pydict({
            "query_id": pa.array(names[query].tolist(), schema.field("query_id").type),
            "id": pa.array(found.tolist(), schema.field("id").type),
            "score": pa.array(-order, pa.float64()),
        })

    schema = pa.schema([("query_id", got.schema.field("id").type), ("id", vectors.limit(0).toArrow().schema.field("id").type), ("score", pa.float64())])
    return vectors.mapInArrow(run, f"query_id {query_kind}, id {kind}, score double")


def nearest_by_expression(queries: DataFrame, vectors: DataFrame, k: int | None, score: Column, include_self: bool = False) -> DataFrame:
    """As ``nearest`` for few queries and any score: an expression over q_ and plain columns of both sides."""
    q = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns))
    both = vectors.join(F.broadcast(q), F.lit(True) if include_self else F.col("q_id") != F.col("id"))
    return top_k(both.select(F.col("q_id").alias("query_id"), "id", F.round(score, 9).alias("score")), k, ["query_id"], ["score"], ["id"])


class _Best:
    """The best k of each of n queries so far, of hits (query, order, id): smaller orders first, ties by id."""

    def __init__(self, n: int, k: int):
        self.k, self.waiting, self.n_waiting, self.got = k, [], 0, None
        self.most = np.full(n, np.inf)  # a query's hits of a larger order are not among its best

    def add(self, query: np.ndarray, order: np.ndarray, names: np.ndarray) -> None:
        if len(query):
            self.waiting.append((query, order, names))
            self.n_waiting += len(query)
            if self.n_waiting >= PENDING:
                self.cut()

    def cut(self) -> None:
        if not self.waiting:
            return
        query, order, names = (np.concatenate(x) for x in zip(*([self.got] if self.got else []), *self.waiting, strict=True))
        by = np.lexsort((names, order, query))
        own = query[by]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        last = by[place == self.k - 1]
        self.most[query[last]] = order[last]
        by = by[place < self.k]
        self.got, self.waiting, self.n_waiting = (query[by], order[by], names[by]), [], 0


def _few_copies(rows: np.ndarray, group: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among k neighbours: of equal rows of a group those of the k + 1 smallest ids (one may be the query)."""
    if not len(rows):
        return np.zeros(0, np.int64)
    whole = np.ascontiguousarray(np.column_stack((rows, group.astype(np.float64))))
    equal = np.unique(whole.view(np.dtype((np.void, whole.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
    by = np.lexsort((names, equal))
    own, named = equal[by], names[by]
    first = np.searchsorted(own, own)
    other = np.cumsum(np.concatenate(([0], (own[1:] != own[:-1]) | (named[1:] != named[:-1]))))
    return np.sort(by[other - other[first] <= k])


def nearest_hybrid(queries: DataFrame, vectors: DataFrame, k: int = 10, same: str = "label") -> DataFrame:
    """The k nearest vectors of each query by ``similarity.hybrid_vector``, names never the same: exact.

    queries, vectors: (id, embedding, ``same``); two rows are of the same type where ``same`` is equal.
    As ``nearest``, with queries in blocks, and the best k of every task.  Scores by matrix products rule
    out pairs that cannot be among the best k, errors of rounding allowed for; those left are scored by
    their differences.  Ties go to the smaller id.  A pair has no score where an embedding or a ``same`` is null, an
    embedding holds a null or the lengths differ: such pairs come last, as nulls in an ORDER BY.  Rows
    without an id have no neighbours and are none; nor is a row of the query's id.
    """
    kind, query_kind = (d.schema["id"].dataType.simpleString() for d in (vectors, queries))
    columns = ["id", F.col("embedding").cast("array<double>").alias("embedding"), F.col(same).cast("string").alias("same")]
    own, vectors = queries.select(*columns).where("id is not null"), vectors.select(*columns).where("id is not null")
    n_blocks = max(1, -(-own.count() // BLOCK))
    found = None
    for b in range(n_blocks):
        block = own if n_blocks == 1 else own.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b)
        part = _block_hybrid(block, vectors, k, kind, query_kind)
        found = part if found is None else found.unionByName(part)
    return top_k(found, k, ["query_id"], ["score"], ["id"])


def _lengths(column: pa.Array) -> np.ndarray:
    """Lengths of lists of numbers; -1 of a null list or one with a null in it."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).copy()
    if column.flatten().null_count:
        lengths[[i for i, v in enumerate(column.to_pylist()) if v is not None and None in v]] = -1
    return lengths


def _matrix(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    """Those rows of a column of lists of ``dim`` numbers each."""
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)


def _lengths_and_units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.linalg.norm(m, axis=1)
    return n, m / np.where(n == 0, 1, n)[:, None]


def _block_hybrid(block: DataFrame, vectors: DataFrame, k: int, kind: str, query_kind: str) -> DataFrame:
    got = block.toArrow().combine_chunks()
    column = got.column("embedding").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    label = got.column("same").to_pylist()
    number = {g: i for i, g in enumerate(dict.fromkeys(g for g in label if g is not None))}
    label = np.array([number.get(g, -1) for g in label], np.int64)
    lengths = np.where(label < 0, -1, _lengths(column))
    parts = {int(d): np.flatnonzero(lengths == d) for d in np.unique(lengths) if d >= 0}
    shared = vectors.sparkSession.sparkContext.broadcast((got.column("id").to_pylist(), number, label, lengths, {d: (rows, _matrix(column, rows, d)) for d, rows in parts.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, number, label, lengths, parts = shared.value
        ids = np.array(ids)
        best = _Best(len(ids), k)
        empty = np.zeros(0, ids.dtype)
        unscored: list = []  # ids of this task, for pairs without a score: the smallest, so many as a query may need
        parts = {d: (rows, q, *_lengths_and_units(q)) for d, (rows, q) in parts.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.array(batch.column(0).to_pylist())
            own = np.array([-1 if g is None else number.get(g, -2) for g in batch.column(2).to_pylist()], np.int64)
            sizes = np.where(own == -1, -1, _lengths(batch.column(1)))
            unscored.append((names, sizes))
            if sum(len(x) for x, _ in unscored) > PENDING:
                unscored = [_smallest(unscored, k)]
            for d, (rows, q, n_q, unit_q) in parts.items():
                fits = np.flatnonzero(sizes == d)
                for at in range(0, len(fits), CANDIDATES):
                    some = fits[at : at + CANDIDATES]
                    m = _matrix(batch.column(1), some, d)
                    few = _few_copies(m, own[some], names[some], k)
                    some, m = some[few], m[few]
                    n_m, unit_m = _lengths_and_units(m)
                    # the product errs in squared distances by some eps of the squared lengths, so the distance by the root of that
                    eps = 4 * (d + 4) * np.finfo(np.float64).eps
                    slack_m, slack_q = (0.2 * np.fmin(1, np.sqrt(eps) * n) + 1e-9 for n in (n_m, n_q))
                    for begin in range(0, len(rows), TILE):
                        tile = slice(begin, begin + TILE)
                        mine = rows[tile]
                        with np.errstate(all="ignore"):
                            about = q[tile] @ m.T
                            about *= -2
                            about += (n_q[tile] ** 2)[:, None]
                            about += (n_m**2)[None]
                            np.maximum(about, 0, out=about)
                            np.sqrt(about, out=about)
                            about += 1
                            np.divide(0.2, about, out=about)
                            about += (0.4 * unit_q[tile]) @ unit_m.T
                        about += 0.2 * 0.6 * (label[mine][:, None] == own[some][None])
                        about += slack_m[None]
                        about[np.isnan(about)] = np.inf  # scored below
                        least = -best.most[mine]
                        if len(some) > k and np.isneginf(least).any():
                            sure = about - 2 * slack_m[None]
                            sure[np.isinf(about) | (ids[mine][:, None] == names[some][None])] = -np.inf
                            least = np.maximum(least, np.partition(sure, len(some) - k, axis=1)[:, len(some) - k] - slack_q[tile])
                        least = least - slack_q[tile]
                        least[np.isnan(least)] = -np.inf
                        which, place = np.nonzero(about >= least[:, None])
                        differ = ids[mine[which]] != names[some[place]]
                        which, place = which[differ], place[differ]
                        for part in range(0, len(which), 1 << 16):
                            w, p = which[part : part + (1 << 16)], place[part : part + (1 << 16)]
                            with np.errstate(all="ignore"):
                                apart = np.sqrt(((q[tile][w] - m[p]) ** 2).sum(axis=1))
                                score = 0.4 * (unit_q[tile][w] * unit_m[p]).sum(axis=1) + 0.2 * (1 / (1 + apart)) + 0.2 * 0.6 * (label[mine[w]] == own[some[p]])
                            order = -np.round(score, 9)
                            order[np.isnan(order)] = -np.inf  # first, as NaN in an ORDER BY ... DESC
                            keep = order <= best.most[mine[w]]
                            best.add(mine[w][keep], order[keep], names[some[p]][keep])
                best.cut()
        best.cut()
        if unscored:
            # pairs without a score, of queries that may need them
            names, sizes = _smallest(unscored, k)
            for i in np.flatnonzero(np.isposinf(best.most)):
                rest = np.flatnonzero(((sizes != lengths[i]) | (sizes < 0)) & (names != ids[i]))[:k]
                best.add(np.full(len(rest), i), np.full(len(rest), np.inf), names[rest])
            best.cut()
        query, order, names = best.got or (np.zeros(0, np.int64), np.zeros(0), empty)
        score = np.where(np.isneginf(order), np.nan, -order)
        yield pa.RecordBatch.from_arrays([
            pa.array(ids[query].tolist(), schema.field("query_id").type),
            pa.array(names.tolist(), schema.field("id").type),
            pa.array(score, pa.float64(), mask=np.isposinf(order), from_pandas=False),
        ], schema.names)

    schema = pa.schema([("query_id", got.schema.field("id").type), ("id", vectors.limit(0).toArrow().schema.field("id").type), ("score", pa.float64())])
    return vectors.mapInArrow(run, f"query_id {query_kind}, id {kind}, score double")


def _smallest(seen: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (ids, sizes), in order of ids: those of the k + 1 smallest ids of every size, one of them maybe the query's."""
    names, sizes = (np.concatenate(x) for x in zip(*seen, strict=True))
    by = np.lexsort((names, sizes))
    own, named = sizes[by], names[by]
    other = np.cumsum(np.concatenate(([0], (own[1:] != own[:-1]) | (named[1:] != named[:-1])))) if len(by) else by
    by = by[other - other[np.searchsorted(own, own)] <= k] if len(by) else by
    by = by[np.argsort(names[by], kind="stable")]
    return names[by], sizes[by]


def nearest_among(queries: DataFrame, vectors: DataFrame, candidates: DataFrame, k: int | None, least: float | None = None) -> DataFrame:
    """The k nearest by cosine among each query's candidates (query_id, id), which alone are scored.

    Work grows with the candidates, not with queries times vectors; a repeated candidate counts
    once, one without a vector has no score.  Ties go to the smaller id.
    """
    few = candidates.select("query_id", "id").distinct().join(vectors.select("id", "embedding"), "id")
    both = few.join(queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("q_embedding")), "query_id")
    scored = both.select("query_id", "id", F.round(S.cosine(F.col("q_embedding"), F.col("embedding")), 9).alias("score"))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return top_k(scored, k, ["query_id"], ["score"], ["id"])


def within(found: DataFrame, candidates: DataFrame, k: int | None) -> DataFrame:
    """Hits restricted to candidate (query_id, id) pairs, before the ranking."""
    return top_k(found.drop("rank").join(candidates, ["query_id", "id"], "left_semi"), k, ["query_id"], ["score"], ["id"])


def fuse_queries(found: DataFrame, n_queries: int, k: int | None = None) -> DataFrame:
    """0.6 mean score + 0.4 share of the queries that hit, for each id."""
    out = found.groupBy("id").agg(F.round(0.6 * F.avg("score") + 0.4 * F.count("*") / F.lit(n_queries), 9).alias("score"))
    return top_k(out, k, [], ["score"], ["id"])


def centroids(vectors: DataFrame, n: int, sample: int = 50_000, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """n unit centroids, by spherical k-means on a sample of ``sample`` vectors at most (the index's documented bound)."""
    total = vectors.count()
    some = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(total, 1))))
    rows = np.array(some.select("embedding").toArrow().column(0).to_pylist(), np.float64)
    if not len(rows):
        return np.zeros((0, 0))
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = rows / np.where(norm == 0, 1, norm)
    pick = np.random.default_rng(seed)
    n = min(n, len(rows))
    centre = rows[pick.choice(len(rows), n, replace=False)]
    for _ in range(rounds):
        own = _cells(rows, centre, 1)[:, 0]
        by = np.argsort(own, kind="stable")
        ends = np.searchsorted(own[by], np.arange(n + 1))
        for c in range(n):
            mine = rows[by[ends[c] : ends[c + 1]]]
            centre[c] = mine.sum(axis=0) if len(mine) else rows[pick.integers(len(rows))]
        norm = np.linalg.norm(centre, axis=1, keepdims=True)
        centre = centre / np.where(norm == 0, 1, norm)
    return centre


def _cells(rows: np.ndarray, centre: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the n nearest centroids of each row, the nearest first; ties go to the smaller number."""
    if not len(rows) or not centre.size:
        return np.zeros((len(rows), 1), np.int64)
    found, step = [], max(1, CELLS // len(centre))
    for at in range(0, len(rows), step):
        score = rows[at : at + step] @ centre.T
        found.append(score.argmax(axis=1)[:, None] if n == 1 else np.argsort(-score, axis=1, kind="stable")[:, :n])
    return np.concatenate(found)


def assign(vectors: DataFrame, centre: np.ndarray, n: int = 1) -> DataFrame:
    """``vectors`` with the numbers of their n nearest centroids, ``cell``, a row for each; every row is indexed."""
    shared = vectors.sparkSession.sparkContext.broadcast(centre)
    names = vectors.columns
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            rows = batch.column(names.index("embedding")).to_pylist()
            cells = _cells(np.array(rows, np.float64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0)), c, n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.tolist(), pa.list_(pa.int32()))], [*names, "cells"])

    found = vectors.where("embedding is not null").mapInArrow(run, T.StructType([*vectors.schema, T.StructField("cells", T.ArrayType(T.IntegerType()))]))
    return found.withColumn("cell", F.explode("cells")).drop("cells")


def index_search(queries: DataFrame, indexed: DataFrame, centre: np.ndarray, probes: int, k: int = 10, include_self: bool = False) -> DataFrame:
    """Approximate neighbours: each query looks at the vectors of its ``probes`` nearest cells, at all of them.

    Queries are taken in blocks, as by ``nearest``, each with the list of queries that probe a cell; a task
    scores its rows of a cell with these alone, by one matrix product, and keeps the best k of each query.
    No pairs are shuffled but those.  Ties go to the smaller id.  A row without an id, and a null or
    differently long vector, has no neighbours and is none.
    """
    kind, query_kind = (d.schema["id"].dataType.simpleString() for d in (indexed, queries))
    own = queries.select("id", "embedding").where("id is not null and embedding is not null")
    rows = indexed.select("id", "cell", "embedding").where("id is not null and embedding is not null")
    n_blocks = max(1, -(-own.count() // BLOCK))
    found = None
    for b in range(n_blocks):
        block = own if n_blocks == 1 else own.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b)
        part = _block_search(block, rows, centre, probes, k, include_self, kind, query_kind)
        found = part if found is None else found.unionByName(part)
    return top_k(found, k, ["query_id"], ["score"], ["id"])


def _block_search(block: DataFrame, rows: DataFrame, centre: np.ndarray, probes: int, k: int, include_self: bool, kind: str, query_kind: str) -> DataFrame:
    got = block.toArrow()
    ids, lists = got.column("id").to_pylist(), got.column("embedding").to_pylist()
    dim = centre.shape[1] if centre.size else max(map(len, lists), default=0)
    use = [i for i, v in enumerate(lists) if len(v) == dim]
    matrix = np.array([lists[i] for i in use], np.float64).reshape(len(use), dim)
    cells = _cells(matrix, centre, probes)
    by = np.argsort(cells, axis=None, kind="stable")
    probing = (by // cells.shape[1]).astype(np.int32)  # queries, by the cells they probe
    ends = np.searchsorted(cells.ravel()[by], np.arange(max(1, len(centre)) + 1))
    shared = rows.sparkSession.sparkContext.broadcast(([ids[i] for i in use], matrix, probing, ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, probing, ends = shared.value
        ids, q = np.array(ids), _lengths_and_units(matrix)[1]
        best = _Best(len(ids), k)
        for batch in batches:
            fits = np.flatnonzero(batch.column(2).value_lengths().to_numpy(zero_copy_only=False) == q.shape[1]) if len(q) else np.zeros(0, np.int64)
            names, cell = np.array(batch.column(0).take(pa.array(fits)).to_pylist()), batch.column(1).take(pa.array(fits)).to_numpy(zero_copy_only=False).astype(np.int64)
            m = _matrix(batch.column(2), fits, q.shape[1])
            few = _few_copies(m, cell, names, k)
            few = few[np.argsort(cell[few], kind="stable")]
            names, cell, m = names[few], cell[few], _lengths_and_units(m[few])[1]
            at = 0
            while at < len(few):
                end = min(int(np.searchsorted(cell, cell[at], "right")), at + CANDIDATES)
                here = probing[ends[cell[at]] : ends[cell[at] + 1]]
                score = q[here] @ m[at:end].T
                score[np.isnan(score)] = -np.inf
                least = -best.most[here]
                first = end - at > k and np.isneginf(least).any()
                if first and not include_self:
                    score[ids[here][:, None] == names[at:end][None]] = -np.inf
                if first:
                    least = np.maximum(least, np.partition(score, end - at - k, axis=1)[:, end - at - k])
                # scores are rounded to nine places
                which, place = np.nonzero((score >= least[:, None] - 1e-9) & (score > -np.inf))
                if not include_self:
                    differ = ids[here[which]] != names[at + place]
                    which, place = which[differ], place[differ]
                best.add(here[which], -np.round(score[which, place], 9), names[at + place])
                at = end
            best.cut()
        query, order, names = best.got or (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, ids.dtype))
        yield pa.RecordBatch.from_arrays([
            pa.array(ids[query].tolist(), schema.field("query_id").type),
            pa.array(names.tolist(), schema.field("id").type),
            pa.array(-order, pa.float64()),
        ], schema.names)

    schema = pa.schema([("query_id", got.schema.field("id").type), ("id", rows.limit(0).toArrow().schema.field("id").type), ("score", pa.float64())])
    return rows.mapInArrow(run, f"query_id {query_kind}, id {kind}, score double")


def save_index(indexed: DataFrame, centre: np.ndarray, path: str) -> None:
    """Write an index: its rows, a folder for each cell, and its centroids."""
    spark = indexed.sparkSession
    indexed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centre)]  # 65,536 at most (see advice)
    spark.createDataFrame(rows, "cell int, embedding array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """The rows and centroids of a written index, for ``index_search``; more rows are added by ``add_to_index``."""
    centre = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow().column("embedding").to_pylist()
    return spark.read.parquet(f"{path}/rows"), np.array(centre, np.float64).reshape(len(centre), -1)


def add_to_index(vectors: DataFrame, centre: np.ndarray, path: str) -> None:
    """Append vectors to a written index, by its centroids."""
    assign(vectors, centre).write.mode("append").partitionBy("cell").parquet(f"{path}/rows")


def index_sizes(indexed: DataFrame) -> DataFrame:
    """(n_rows, n_cells, largest_cell) of an index."""
    cells = indexed.groupBy("cell").agg(F.count("*").alias("n"))
    return cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_cells"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_cell"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found."""
    n = exact.count()
    return exact.join(found, ["query_id", "id"], "left_semi").count() / n if n else 1.0


def advice(n_rows: int) -> dict[str, int]:
    """Centroids and probes for a number of vectors."""
    cells = max(1, min(65_536, int(4 * n_rows**0.5)))
    return {"cells": cells, "probes": max(1, min(cells, cells // 16 + 4))}


def two_level(found: DataFrame, k: int, per_table: int = 20) -> DataFrame:
    """Column hits (query_id, table_name, id, score): ``per_table`` of each table at most, then the best k."""
    few = top_k(found, per_table, ["query_id", "table_name"], ["score"], ["id"]).drop("rank")
    return top_k(few, k, ["query_id"], ["score"], ["id"])


def hybrid(by_vector: DataFrame, by_text: DataFrame, k: int) -> DataFrame:
    """Vector and text hits (id, score) together, each id once with its better score."""
    both = by_vector.select("id", "score").unionByName(by_text.select("id", "score"))
    return top_k(both.groupBy("id").agg(F.max("score").alias("score")), k, [], ["score"], ["id"])

