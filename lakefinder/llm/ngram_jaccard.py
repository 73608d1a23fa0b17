"""N-gram Jaccard join by parity sketches: which texts are similar, without comparing all pairs.

1. Every text becomes the set of its shingle hashes.  Equal sets are one class, found by a
   128-bit digest; from here on only classes count, by a number of their own.
2. Each class gives the block keys of its parity sketch (``parity``); similar classes share
   a key.  Of its keys that more than ``SMALL`` classes have, a class leaves out those few that most
   classes have, as similar classes share more keys than that: these are mostly the keys of
   passages that many texts hold.  Classes with a key in common form a group.
3. In groups of ``SMALL`` classes or fewer all are compared, first by sketches, whose Hamming
   distance rules out most pairs, then by the sets themselves.
4. In a larger group each class x is compared with one hub h only: by its difference
   D(x) = x ^ h, it is near (similar to the hub) or stray.  Two near classes are linked by
   the hub.  A class x and a stray y that are similar have more than
   (|D(x)| - c (|x| - |h|)) / 2 differences in common, c being (den - num) / (den + num), and
   at least |D(y)| - c (|x| + |y|).  So, by the prefix filter, with differences in order of
   rarity, they share one of the rarest half or so of D(x) and one of the c (|x| + |y|) + 1
   rarest of D(y).  Those are the next groups' keys, of members that no link joins yet.
   What near copies have in common is not among the differences, and their own edits are
   rare: a group of thousands falls apart.  Of the first groups only classes that are nearly
   similar to the hub, by the sketches, go this way.  A class that is farther from a hub of its
   own (families of near classes share one hub) is compared as if its hub were the empty set, all its shingles being differences: with
   every class of a large group that has one of its rarest shingles.
5. Where such groups are still large, and have more pairs in all than a few for each class, it is tried whether the class nearest to the hub makes
   a better hub for it (it does for copies of an edited copy); if so, the group goes on with
   that hub from step 4.  If not, its members are spread by their second common difference,
   the third and so on: with k common differences guaranteed, the first k of them stand
   among the rarest (as many as above, plus k - 1) of both.

No step puts the pairs of a large group together; rows grow with the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from lakefinder.llm.arrow import tidy
from lakefinder.llm import parity, words as W
from lakefinder.llm.components import components, if_few
from lakefinder.scratch import discard, free_shuffles, materialize

#: All pairs of a group of up to so many classes are compared at once.
SMALL = 16
#: Common differences with which classes far from their hubs are spread, at most; then they are compared.
SPREAD = 12
#: As SMALL, for groups that share k differences from a hub: k times so many.
SMALL_SHARED = 64
#: Larger groups are compared at once too where all of them together have no more pairs than so many for each class of the table.
CROSS = 20
#: Keys of more classes than SLICED are counted and joined in SLICES parts, one after the other: only one part's shuffles are on disk at a time.
SLICED, SLICES = 10_000, 4


def _digests(s: np.ndarray) -> tuple[int, int]:
    return (int(W.mix(s ^ np.uint64(0x3C6EF372FE94F82B)).sum().view(np.int64)), int(W.mix(s ^ np.uint64(0xA54FF53A5F1D36F1)).sum().view(np.int64)))


def _profiles(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, th, text) rows to doc_id, th, number of shingles, digest, sketch and keys; of equal sets in a batch the first alone has the last two."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("th long, n long, d1 long, d2 long, sketch binary, keys array<long>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: set[tuple[int, int, int]] = set()
            for w in W.words(batch.column(2), W.NON_SPACE):
                n, d1, d2, sk, keys, ends, none = [], [], [], [], [], [0], []
                for s in W.shingle_sets(w, size):
                    x, y = _digests(s)
                    n.append(len(s))
                    d1.append(x)
                    d2.append(y)
                    known = (len(s), x, y) in done or not len(s)
                    done.add((len(s), x, y))
                    sk.append(None if known else parity.sketch(s, num, den))
                    keys.append(s[:0] if known else parity.keys(s, num, den))
                    ends.append(ends[-1] + len(keys[-1]))
                    none.append(known)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)), mask=pa.array(none))
                own = (batch.column(k).slice(w.first, w.last - w.first) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sk, pa.binary()), lists], schema.names)

    return docs.mapInArrow(tidy(run), schema)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(th, text) rows to the digests and elements of their sets, each set once for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: set[tuple[int, int]] = set()
            for w in W.words(batch.column(1), W.NON_SPACE):
                sets, ids = [], []
                for s in W.shingle_sets(w, size):
                    both = _digests(s)
                    if len(s) and both not in done:
                        done.add(both)
                        sets.append(s)
                        ids.append(both)
                if sets:
                    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in ids], pa.int64()), pa.array([y for _, y in ids], pa.int64()), lists], ["d1", "d2", "elems"])

    return docs.mapInArrow(tidy(run), "d1 long, d2 long, elems array<long>")


def _near_by_sketch(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b, na, nb, ska, skb) whose sketches are near enough; sizes too far apart are out at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ska, skb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            near = [parity.hamming(x, y) <= parity.most_apart(p, q, num, den) for x, y, p, q in zip(ska, skb, na, nb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    fits = pairs.where(f"least(na, nb) * {den} >= greatest(na, nb) * {num}")
    return fits.select("a", "b", "na", "nb", "ska", "skb").mapInArrow(tidy(run), "a long, b long")


def _with(pairs: DataFrame, col: str, other: DataFrame, key: str, **names: str) -> DataFrame:
    return pairs.join(other.select(F.col(key).alias(col), *(F.col(c).alias(n) for c, n in names.items())), col)


def _shared_keys(seen: DataFrame, reps: DataFrame, parts: int, num: int, den: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(key, rep) rows of the keys that two classes or more share: of keys of ``SMALL`` classes at most, and of the others; and the tables behind them.

    The keys are read from the rows of ``seen`` whose numbers the classes have, and ``seen`` is removed.
    A key is in one of ``parts`` parts, by its hash, with all its classes.
    Sizes come from sums that every task begins, and a join that adaptive execution can split, so
    a key that very many classes have is no task of its own.  Of keys that more than SMALL
    classes have, a class leaves out as many of each tag, the commonest, as ``parity`` allows.
    """
    keyed = seen.where("keys is not null").select(F.col("at").alias("rep"), "keys")
    # other batches' rows of a class, and classes left out; marked by an outer join, as Spark would move whole arrays of keys for an anti join
    others = materialize(keyed.select("rep").join(reps.select("rep"), "rep", "left_anti").withColumn("other", F.lit(True)), "others")
    marks, tables = if_few(others), []
    for part in range(parts):
        rows = keyed.select("rep", F.explode("keys").alias("key"))
        if parts > 1:
            rows = rows.where(F.pmod(F.shiftrightunsigned("key", parity.TAG_BITS), F.lit(parts)) == part)
        rows = rows.join(marks, "rep", "left").where("other is null").select("rep", "key")
        # one shuffle of a part's keys in a job; the first is offered for removal before the second
        sizes = materialize(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        free_shuffles(reps.sparkSession)
        tables.append(materialize(rows.join(sizes, "key").select("key", "rep", "size"), "shared"))
        discard(sizes)
        free_shuffles(reps.sparkSession)
    for done in (seen, others):
        discard(done)
    shared = reduce(DataFrame.unionByName, tables)
    allowed = _allowed(reps.sparkSession, parity.allowances(num, den))
    hot = shared.where(F.col("size") > SMALL).withColumn("tag", F.col("key").bitwiseAND((1 << parity.TAG_BITS) - 1).cast("int"))
    order = Window.partitionBy("rep", "tag").orderBy(F.desc("size"), F.desc("key"))
    kept = hot.withColumn("at", F.row_number().over(order)).join(F.broadcast(allowed), "tag").where("at > allowed").select("key", "rep")
    kept = materialize(kept, "kept")
    sized = kept.join(kept.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key")
    small = shared.where(F.col("size") <= SMALL).select("key", "rep").unionByName(sized.where(F.col("size") <= SMALL).select("key", "rep"))
    return small, sized.where(F.col("size") > SMALL).select("key", "rep"), [*tables, kept]


def _allowed(spark: SparkSession, allowed: list[int]) -> DataFrame:
    """(tag, allowed): one row for each band and hash."""
    listed = F.posexplode(F.array(*map(F.lit, allowed))).alias("tag", "allowed")
    return spark.range(1).select(listed)


def _first_groups(small: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (key, rep) rows: the pairs (a, b) of small groups, and (hub, rep) of large ones.

    The hub of a large group is the class that is in most large groups: near copies of a text
    get the same hub in most of their groups, and one that is near to most of them.
    """
    groups = small.groupBy("key").agg(F.sort_array(F.collect_list("rep")).alias("m"))  # of SMALL classes at most
    each = "flatten(transform(sequence(1, size(m) - 1), i -> transform(slice(m, i + 1, size(m)), y -> struct(m[i - 1] as a, y as b))))"
    pairs = groups.where("size(m) > 1").select(F.explode(F.expr(each)).alias("p")).select("p.a", "p.b").distinct()
    known = large.join(large.groupBy("rep").agg(F.count("*").alias("groups")), "rep")
    hub = known.groupBy("key").agg(F.max(F.struct("groups", (-F.col("rep")).alias("neg"))).alias("best")).select("key", (-F.col("best.neg")).alias("hub"))
    return pairs, large.join(hub, "key").where("rep != hub").select("hub", "rep").distinct()


def _near(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) that sketches do not rule out."""
    both = _with(_with(pairs, "a", reps, "rep", n="na", sketch="ska"), "b", reps, "rep", n="nb", sketch="skb")
    return materialize(_near_by_sketch(both, num, den), "near")


def _similar(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v): those pairs (a, b) whose sets are similar."""
    both = _with(_with(pairs, "a", sets, "rep", elems="ea"), "b", sets, "rep", elems="eb").withColumn("same", F.size(F.array_intersect("ea", "eb")))
    return materialize(both.where(f"same * {den} >= (size(ea) + size(eb) - same) * {num}").select(F.col("a").alias("u"), F.col("b").alias("v")), "links")


def _apart(hubs: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(hub, rep, near, far, index_length, probe_length, reach, most) and (hub, rep, token): each class's differences from its hub.

    reach: by how much the sizes of two differences may differ; most: how many common ones are guaranteed.
    """
    both = _with(_with(hubs, "rep", sets, "rep", elems="er"), "hub", sets, "rep", elems="eh")
    both = both.withColumn("diff", F.concat(F.array_except("er", "eh"), F.array_except("eh", "er"))).withColumn("far", F.size("diff"))
    c = f"cast({den - num} as long)"
    both = both.select(
        "hub", "rep", "far", "diff",
        F.expr(f"far * cast({den + num} as long) <= {c} * (size(er) + size(eh))").alias("near"),
        F.expr(f"far - (far - ceil({c} * greatest(0, size(er) - size(eh)) / {den + num})) div 2").alias("index_length"),
        # a partner's size is den / num times its own at most
        F.expr(f"{c} * (size(er) + size(er) * cast({den} as long) div {num}) div {den + num} + 1").alias("probe_length"),
    )
    both = materialize(both.withColumn("reach", F.col("probe_length") - 1).withColumn("most", F.expr("far - index_length + 1")), "apart")
    return both.drop("diff"), both.select("hub", "rep", F.explode("diff").alias("token"))


def _ranked(heads: DataFrame, tokens: DataFrame, label: DataFrame) -> DataFrame:
    """The differences that two classes or more of a hub share, ranked by rarity, with the classes' components.

    Only of hubs whose classes are of more than one component.  Those that one class has
    alone come first in rank, so the others begin after them.
    """
    heads = heads.join(label.select(F.col("u").alias("rep"), "v"), "rep", "left").withColumn("label", F.coalesce("v", "rep")).drop("v")
    mixed = heads.groupBy("hub").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most").select("hub")
    tokens = tokens.join(mixed, "hub", "left_semi")
    shared = tokens.join(tokens.groupBy("hub", "token").agg(F.count("*").alias("n")).where("n > 1"), ["hub", "token"])
    own = Window.partitionBy("hub", "rep")
    shared = shared.withColumn("at", F.row_number().over(own.orderBy("n", "token"))).withColumn("n_shared", F.count("*").over(own))
    return shared.join(heads, ["hub", "rep"]).withColumn("rank", F.col("far") - F.col("n_shared") + F.col("at")).drop("n", "at", "n_shared")


def _own(classes: DataFrame, far: DataFrame, sets: DataFrame, label: DataFrame, num: int, den: int) -> DataFrame:
    """As ``_ranked`` with the empty set as hub: the rarest shingles of ``classes``; those in ``far`` are stray, the others near.

    Similar sets share num / den of the larger one's shingles, so one of the rarest
    n - ceil(num / den n) + 1 of both.  Shingles that one class has alone go no farther than their count.
    """
    some = sets.join(classes, "rep")
    tokens = some.select("rep", F.explode("elems").alias("token"))
    shared = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "token").join(some.select("rep", F.size("elems").alias("far")), "rep")
    own = Window.partitionBy("rep")
    shared = shared.withColumn("at", F.row_number().over(own.orderBy("n", "token"))).withColumn("rank", F.col("far") - F.count("*").over(own) + F.col("at"))
    shared = shared.withColumn("index_length", F.expr(f"far - (far * cast({num} as long) + {den - 1}) div {den} + 1")).where(F.col("rank") < F.col("index_length") + SPREAD)
    marked = shared.join(far.withColumn("is_far", F.lit(True)), "rep", "left").join(label.select(F.col("u").alias("rep"), "v"), "rep", "left")
    return marked.select(
        F.lit(-(1 << 63)).cast("long").alias("hub"),
        "rep",
        "token",
        F.col("is_far").isNull().alias("near"),
        "far",
        "index_length",
        F.col("index_length").alias("probe_length"),
        F.expr(f"far * cast({den - num} as long) div {num}").alias("reach"),
        F.least(F.col("far") - F.col("index_length") + 1, F.lit(SPREAD)).alias("most"),
        F.coalesce("v", "rep").alias("label"),
        "rank",
    )


def _not_far(hubs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Those (hub, rep) of large groups whose sketches leave room for twice the dissimilarity of links.

    It does not matter for the result where the line is drawn: a class beyond it is compared in
    another way.
    """
    pairs = hubs.select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    return _near(pairs, reps, 2 * num - den, den).select(F.col("a").alias("hub"), F.col("b").alias("rep"))


def _mixed_groups(rows: DataFrame) -> DataFrame:
    """Rows of those keys that a probe and an index row of two components share, with the group's ``size`` and ``pairs``."""
    count = {c: F.sum(F.col(c).cast("double")).alias(f"{c}s") for c in ("probe", "index")}
    groups = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("least"), F.max("label").alias("most"), *count.values())
    groups = groups.where("least != most and probes > 0 and indexs > 0").select("key", "size", F.expr("probes * indexs").alias("pairs"))
    return materialize(rows.join(groups, "key"), "rows")


def _crossed(rows: DataFrame, partners: DataFrame) -> DataFrame:
    """Pairs (a, b) of a probe and an index row (of ``partners``) of one key and two components.

    The sizes of two differences differ by the probe's reach at most, or the sets are not similar.
    """
    probe = rows.where("probe").select("key", F.col("rep").alias("x"), F.col("label").alias("lx"), F.col("far").alias("fx"), "reach")
    index = partners.where("index").select("key", F.col("rep").alias("y"), F.col("label").alias("ly"), F.col("far").alias("fy"))
    return probe.join(index, "key").where("lx != ly and abs(fx - fy) <= reach").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _better_hubs(large: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, hub, rep) of the groups that lose a quarter of their differences with the class nearest to their hub as hub.

    Sketches tell the differences well enough, as the choice makes no difference to the result.
    """
    nearest = large.groupBy("key").agg(F.min(F.struct("far", "rep")).alias("best")).select("key", F.col("best.rep").alias("other"))
    tried = materialize(large.select("key", "rep", "far").join(nearest, "key").where("rep != other"), "tried")
    both = _with(_with(tried.select("other", "rep").distinct(), "rep", reps, "rep", sketch="ska"), "other", reps, "rep", sketch="skb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now = [parity.about_apart(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(now, pa.float64())], ["other", "rep", "now"])

    now = both.select("other", "rep", "ska", "skb").mapInArrow(tidy(run), "other long, rep long, now double")
    tried = tried.join(now, ["other", "rep"])
    better = tried.groupBy("key").agg(F.sum("far").alias("was"), F.sum("now").alias("now")).where("now * 4 <= was * 3").select("key")
    return tried.join(better, "key").select("key", F.col("other").alias("hub"), "rep")


def _candidates(ranked: DataFrame, reps: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) to compare that the hubs leave over, and (hub, rep) for another round; most: of pairs of large groups compared at once."""
    first = ranked.withColumns({"probe": F.expr("not near and rank <= probe_length"), "index": F.expr("rank <= index_length"), "key": F.xxhash64("hub", "token")})
    columns = ["key", "hub", "rep", "label", "far", "rank", "probe", "index", "index_length", "probe_length", "reach", "most"]
    rows = _mixed_groups(first.where("probe or index").select(columns))
    spread = ranked.select("hub", "rep", F.col("token").alias("more"), F.col("rank").alias("place"))
    pairs, k, hubs = None, 1, None
    while True:
        bound = SMALL_SHARED * k
        small, large = rows.where(F.col("size") <= bound), rows.where(F.col("size") > bound)
        # rows of a group share its pairs alike
        left = large.agg(F.sum(F.expr("pairs / size"))).first()[0]
        if left is None or left <= most:
            found = _crossed(rows, rows)
            pairs = found if pairs is None else pairs.union(found)
            return pairs.distinct(), ranked.select("hub", "rep").limit(0) if hubs is None else hubs
        found = _crossed(small, small)
        # index rows that cannot promise one more common difference are compared now
        found = found.union(_crossed(large, large.where(f"most <= {k}")))
        pairs = found if pairs is None else pairs.union(found)
        if hubs is None:
            better = materialize(_better_hubs(large, reps), "better")
            hubs = better.select("hub", "rep").distinct()
            large = large.join(better.select("key").distinct(), "key", "left_anti")
        more = large.drop("size", "pairs").join(spread, ["hub", "rep"]).where("place > rank")
        more = more.withColumns({
            "probe": F.expr(f"probe and place <= probe_length + {k}"),
            "index": F.expr(f"index and place <= index_length + {k} and most > {k}"),
            "key": F.xxhash64("key", "more"),
            "rank": F.col("place"),
        }).where("probe or index")
        rows = _mixed_groups(more.select(columns))
        free_shuffles(rows.sparkSession)
        k += 1


def _families(hubs: DataFrame) -> DataFrame:
    """(hub, rep) with one hub for all that hubs connect, that of most classes: each class then goes on once."""
    edges = hubs.select(F.col("rep").alias("u"), F.col("hub").alias("v"))
    family = materialize(components(edges), "families")
    members = family.select("u", "v").union(family.select(F.col("v").alias("u"), "v").distinct())
    degree = hubs.groupBy(F.col("hub").alias("u")).agg(F.count("*").alias("n"))
    chosen = members.join(degree, "u").groupBy("v").agg(F.max(F.struct("n", (-F.col("u")).alias("neg"))).alias("best"))
    return members.join(chosen.select("v", (-F.col("best.neg")).alias("hub")), "v").where("u != hub").select("hub", F.col("u").alias("rep"))


def links(docs: DataFrame, seen: DataFrame, reps: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(u, v): the smallest class v of the component of each class u; docs: (th, text), seen: number and keys of rows, reps: rep, th, d1, d2, n and sketch of each class."""
    spark, n = docs.sparkSession, reps.count()
    most = CROSS * n
    small, large, behind = _shared_keys(seen, reps, SLICES if n > SLICED else 1, num, den)
    free_shuffles(spark)
    pairs, hubs = _first_groups(small, large)
    near, hubs = _near(pairs, reps, num, den), materialize(hubs, "hubs")
    for done in behind:
        discard(done)
    free_shuffles(spark)
    # later rounds have no other classes than these
    wanted = near.select("a").union(near.select("b")).union(hubs.select("rep")).union(hubs.select("hub")).distinct().withColumnRenamed("a", "rep")
    wanted = materialize(wanted.join(reps.select("rep", "th", "d1", "d2"), "rep"), "wanted")
    texts = docs.join(if_few(wanted.select("th").distinct()), "th", "left_semi").select("th", "text")
    of_wanted = _sets(texts, size).join(if_few(wanted.select("rep", "d1", "d2")), ["d1", "d2"]).groupBy("rep").agg(F.first("elems").alias("elems"))
    sets = materialize(of_wanted, "sets")
    found = _similar(near, sets, num, den)
    free_shuffles(spark)
    if hubs.isEmpty():
        return components(found)
    first = _not_far(hubs, reps, num, den)
    everyone = materialize(hubs.select("rep").union(hubs.select("hub")).distinct(), "everyone")
    strays = materialize(hubs.join(first, ["hub", "rep"], "left_anti").select("rep").distinct(), "strays")
    strays = None if strays.isEmpty() else strays
    hubs = materialize(_families(first), "hubs")
    while True:  # there are hubs, strays or both
        heads, tokens = _apart(hubs, sets, num, den)
        found = components(found.union(heads.where("near").select(F.col("rep").alias("u"), F.col("hub").alias("v"))))
        ranked = _ranked(heads, tokens, found)
        if strays is not None:
            ranked = ranked.unionByName(_own(everyone, strays, sets, found, num, den))
            strays = None
        ranked = materialize(ranked, "ranked")
        free_shuffles(spark)
        pairs, hubs = _candidates(ranked, reps, most)
        found = found.union(_similar(_near(pairs, reps, num, den), sets, num, den))
        hubs = materialize(hubs, "hubs")
        discard(ranked)
        if hubs.isEmpty():
            break
        hubs = materialize(_families(hubs), "hubs")
        free_shuffles(spark)
    found = components(found)
    for done in (sets, wanted, near):
        discard(done)
    return found


def text_hash(text: Column) -> Column:
    """With a doc_id it names a row's text: the same in every evaluation, whatever the order of rows."""
    return F.xxhash64(text)


def _linked(rows: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (doc_id, th, text): members (doc_id, th, n, rep), classes (rep, name: its smallest doc_id), and the components (u, v) of classes."""
    seen = materialize(_profiles(rows, size, num, den).withColumn("at", F.monotonically_increasing_id()), "classes")
    # one row for each class, by the number of a row that has its keys, which stay there; equal digests of a hot text meet as one row of each task
    number = F.min(F.when(F.col("sketch").isNotNull(), F.col("at"))).alias("rep")
    reps = seen.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("name"), F.min("th").alias("th"), F.first("sketch", True).alias("sketch"), number)
    reps = materialize(reps, "reps")
    free_shuffles(rows.sparkSession)
    members = seen.select("doc_id", "th", "n", "d1", "d2").join(reps.select("d1", "d2", "n", "rep", "name"), ["d1", "d2", "n"], "left")
    members = materialize(members.select("doc_id", "th", "n", "rep", "name"), "members")
    free_shuffles(rows.sparkSession)
    found = links(rows.select("th", "text"), seen, reps.where("name is not null"), size, num, den)
    return members, reps.select("rep", "name"), found


def similar_documents(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Join documents whose shingle sets have a Jaccard similarity of num/den or more; name the components.

    Words are runs of characters that are not white space, after lower-casing A-Z; a set
    holds the distinct shingles of ``size`` words, of a text of fewer words the whole
    sequence.  Ids may be of any type that has an order.  Returns one row per input row:
    doc_id, n_shingles, class_id (smallest doc_id of the same set) and component_id (smallest
    doc_id reachable by links, itself included).

    Null and empty texts have no shingles and are linked with nothing.  A row whose doc_id is
    null is named by its class where another row of it has an id; it links nothing itself.
    Rows that repeat a doc_id are one document: a link of one is a link of all.  An empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    members, classes, found = _linked(rows, size, num, den)
    by_doc = members.where("n > 0 and doc_id is not null").select("doc_id", "rep")
    twice = by_doc.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("u")).where("u != v")
    if not twice.isEmpty():  # rows of one doc_id in several classes
        again = by_doc.join(twice, "doc_id").select(F.col("rep").alias("u"), "v")
        found = components(found.union(again))
    nodes = found.select(F.col("u").alias("rep"), "v").union(found.select("v", F.col("v").alias("v2")).distinct())
    named = nodes.join(classes, "rep").groupBy("v").agg(F.min("name").alias("component"))
    names = materialize(nodes.join(named, "v").select("rep", "component"), "names")
    return members.join(names, "rep", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("n") > 0, F.coalesce("component", "name")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component of similar texts, that of the smallest doc_id; rows without a doc_id stay.

    Rows count one by one: where rows repeat a doc_id with texts of their own, each belongs to
    its own text's component.  Of rows of one component that share the smallest doc_id, the text
    with the smallest hash stays, and of rows equal in both any single one.  Rows are told by
    doc_id and a hash of the text, so the result is right for any input, however it is read.
    """
    own = docs.withColumn("__th", text_hash(F.col("text")))
    rows = own.select("doc_id", F.col("__th").alias("th"), "text")
    members, _, found = _linked(rows, size, num, den)
    named = members.where("n > 0 and doc_id is not null").join(found.withColumnRenamed("u", "rep"), "rep", "left").select("doc_id", "th", F.coalesce("v", "rep").alias("component"))
    best = named.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("best"), F.count("*").alias("n")).where("n > 1").select("component", "best")
    marked = named.join(best, "component").withColumn("stays", (F.col("doc_id") == F.col("best.doc_id")) & (F.col("th") == F.col("best.th")))
    marked = materialize(marked.groupBy("doc_id", "th").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "marked")
    gone, again = marked.where("not stays").select("doc_id", F.col("th").alias("__th")), marked.where("stays").select("doc_id", F.col("th").alias("__th"))
    left = own.join(if_few(gone), ["doc_id", "__th"], "left_anti")
    if not again.isEmpty():
        few = if_few(again)
        left = left.join(few, ["doc_id", "__th"], "left_anti").unionByName(left.join(few, ["doc_id", "__th"], "left_semi").dropDuplicates(["doc_id", "__th"]))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
