"""The registered queries: each operator applied to the lake of the given tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakefinder.functions import embedding as E, features as X, normalize as N, similarity as S
from lakefinder.operators import assignment, evaluate, fusion, lsh, metadata, overlap, vectors
from lakefinder.plans import columns as P, discover, routing
from lakefinder.scratch import materialize, stamp
from lakefinder.sources import catalog, store
from lakefinder.streaming import incremental

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: The catalogs made so far: a lake is profiled once for all its queries, as an index is built once for all searches, and anew when its files change.
_made: dict[tuple[str, str, str], catalog.Lake] = {}


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def lake(spark: SparkSession, sf_dir: str) -> catalog.Lake:
    key = (spark.sparkContext.applicationId, sf_dir, stamp(spark, *(f"{sf_dir}/{t}.parquet" for t in TABLES)))
    if key not in _made:
        own = catalog.lake_of(frames(spark, sf_dir))
        _made[key] = catalog.Lake(materialize(own.tables, "lake_tables"), own.columns, materialize(own.values, "lake_values"))
    return _made[key]


def q_value_overlap(spark, sf_dir):
    """Columns that share values with each column of orders."""
    found = lake(spark, sf_dir)
    query = found.values.where("table_name = 'orders'").select(F.col("table_name").alias("query_table"), F.col("column_name").alias("query_column"), "value")
    out = overlap.value_overlap(query, found.values, 0.35)
    return out.select(*overlap.KEYS, "n_hit", *(F.round(c, 9).alias(c) for c in ("overlap", "target", "score")))


def q_joinable(spark, sf_dir):
    """The flagship: the ten columns that best join orders.o_custkey, from the two sides' values alone."""
    own = frames(spark, sf_dir)
    query = catalog.values_of(own, {("orders", "o_custkey")}).select(F.col("table_name").alias("query_table"), F.col("column_name").alias("query_column"), "value")
    sizes = lambda some: catalog.values_of(own, some).groupBy("table_name", "column_name").agg(F.count("*").alias("n_target"))
    found = overlap.value_overlap_unindexed(query, catalog.rows_of_values(own), sizes, 0.35, 10)
    return found.select("table_name", "column_name", "n_hit", *(F.round(c, 9).alias(c) for c in ("overlap", "target", "score")), "rank")


def q_pattern_search(spark, sf_dir):
    out = overlap.pattern_search(lake(spark, sf_dir).values, "(promo|steel|ship)", 10)
    return out.withColumn("score", F.round("score", 9)).withColumn("matched_values", F.array_join("matched_values", "|"))


def q_index_statistics(spark, sf_dir):
    return overlap.index_statistics(lake(spark, sf_dir).values).withColumn("values_per_column", F.round("values_per_column", 6))


def q_posting_histogram(spark, sf_dir):
    return overlap.posting_histogram(lake(spark, sf_dir).values, 10)


def q_catalog(spark, sf_dir):
    return lake(spark, sf_dir).columns.withColumn("sample_values", F.array_join("sample_values", "|")).withColumn("unique_count", F.coalesce("unique_count", F.lit(-1)))


def q_index_check(spark, sf_dir):
    return store.verify(lake(spark, sf_dir))


def q_table_features(spark, sf_dir):
    out = metadata.table_features(lake(spark, sf_dir).tables)
    joined = {c: F.array_join(F.col(c).cast("array<string>"), "|") for c in ("type_counts", "key_columns", "matcher_keys", "identifier_columns", "domain_keywords")}
    return out.drop("signature_types").withColumns(joined).withColumn("foreign_key_ratio", F.round("foreign_key_ratio", 9))


def q_schema_summary(spark, sf_dir):
    return metadata.schema_summary(lake(spark, sf_dir).tables).withColumn("columns", F.array_join("columns", "|"))


def q_column_features(spark, sf_dir):
    t, s, n = F.col("data_type"), F.col("sample_values"), F.col("column_name")
    inferred = X.inferred_type(n, s)
    return lake(spark, sf_dir).columns.select(
        "table_name", "column_name",
        N.metadata_type(t).alias("metadata_type"), N.matcher_type(t).alias("matcher_type"), N.signature_type(t).alias("signature_type"), N.query_type(t, inferred).alias("query_type"), N.type_group(t).alias("type_group"),
        X.is_numeric(t, s).alias("is_numeric"), inferred.alias("inferred_type"), X.semantic_group(n).alias("semantic_group"),
        F.array_join(N.categories(s), "|").alias("categories"), F.size(N.numbers(s)).cast("long").alias("n_numbers"),
        X.column_text(F.col("table_name"), n, t, s, 3).alias("text"),
    )


def q_table_texts(spark, sf_dir):
    return lake(spark, sf_dir).tables.select("table_name", X.table_text(F.col("table_name"), F.col("columns"), n_columns=20).alias("text"), X.name_text(F.col("table_name"), F.col("columns")).alias("names"))


def q_metadata_search(spark, sf_dir):
    f = metadata.table_features(lake(spark, sf_dir).tables)
    return metadata.metadata_search(f, f, 5)


def q_signature_search(spark, sf_dir):
    f = metadata.table_features(lake(spark, sf_dir).tables)
    return metadata.signature_search(f, f, None).withColumn("score", F.round("score", 6))


def q_prefilter(spark, sf_dir):
    f = metadata.table_features(lake(spark, sf_dir).tables)
    return metadata.prefilter(f, ["custkey", "orderkey"], "medium", None, 20)


def q_shared_letters(spark, sf_dir):
    f = lake(spark, sf_dir).tables
    return metadata.shared_letters(f, f)


def q_relaxed_filter(spark, sf_dir):
    f = metadata.table_features(lake(spark, sf_dir).tables)
    return metadata.relaxed(metadata.metadata_search(f, f, None, include_self=False), 6, 0.6, pad_to=9)


def q_best_of_queries(spark, sf_dir):
    f = metadata.table_features(lake(spark, sf_dir).tables)
    asked = f.where("table_name in ('orders', 'customer')")
    return metadata.best_of_queries(metadata.threshold(metadata.metadata_search(asked, f, None), 0.5, 10))


def _names(spark, sf_dir):
    c = lake(spark, sf_dir).columns.select("column_name").distinct()
    return c.select(F.col("column_name").alias("a")).join(c.select(F.col("column_name").alias("b")), F.col("a") < F.col("b"))


def q_name_similarity(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _names(spark, sf_dir).select("a", "b", F.round(S.levenshtein(a, b), 9).alias("levenshtein"), F.round(S.token_jaccard(a, b), 9).alias("tokens"), F.round(S.character_jaccard(a, b), 9).alias("characters"), (S.stripped(a) == S.stripped(b)).alias("alike"))


def q_sequence_similarity(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _names(spark, sf_dir).select("a", "b", F.round(S.sequence_ratio(a, b), 9).alias("ratio"), F.round(S.name(a, b), 9).alias("name"))


def _table_pairs(spark, sf_dir):
    t = lake(spark, sf_dir).tables.select("table_name", "columns")
    return t.select(F.col("table_name").alias("query_table"), F.col("columns").alias("a")).join(t.select("table_name", F.col("columns").alias("b")), F.col("query_table") != F.col("table_name"))


def q_table_rules(spark, sf_dir):
    a, b, q, t = F.col("a"), F.col("b"), F.col("query_table"), F.col("table_name")
    return _table_pairs(spark, sf_dir).select(
        "query_table", "table_name", F.round(S.table_name(q, t), 9).alias("name"), F.round(S.column_overlap(a, b), 9).alias("overlap"),
        S.identical_structure(a, b).alias("identical"), F.round(S.key_match(a, b), 9).alias("keys"), S.special_pattern(q, t, a, b).alias("pattern"),
    )


def _pairs(spark, sf_dir):
    return P.column_pairs(lake(spark, sf_dir).columns)


def q_pair_similarity(spark, sf_dir):
    """Type, value, statistics, structure and category similarity of every pair of columns of two tables."""
    p = _pairs(spark, sf_dir).where("query_table < table_name")
    q, c = N.categories(F.col("q_sample_values")), N.categories(F.col("sample_values"))
    return p.select(
        "query_table", "query_column", "table_name", "column_name",
        F.round(S.type_match(F.col("q_data_type"), F.col("data_type")), 9).alias("type_sim"),
        F.round(S.values(F.col("q_sample_values"), F.col("sample_values")), 9).alias("value_sim"),
        F.round(S.stats(F.col("q_unique_count"), F.col("unique_count"), F.col("q_null_count"), F.col("null_count")), 9).alias("stats_sim"),
        F.round(S.structural(F.col("q_data_type"), F.col("data_type"), F.col("q_null_count"), F.col("null_count")), 9).alias("structure_sim"),
        F.round(S.jaccard(F.array_distinct(q), F.array_distinct(c), 0.0), 9).alias("category_jaccard"),
        F.round(S.frequency_cosine(q, c), 6).alias("category_cosine"),
    )


def q_fast_pairs(spark, sf_dir):
    return P.fast(_pairs(spark, sf_dir))


def q_name_pairs(spark, sf_dir):
    return P.by_names(_pairs(spark, sf_dir), 0.5)


def q_numeric_similarity(spark, sf_dir):
    return P.numeric_similarity(P.numeric_profiles(frames(spark, sf_dir))).where("score > 0.2")


def q_traditional_pairs(spark, sf_dir):
    return P.traditional(_pairs(spark, sf_dir)).where("score > 0.3")


def q_hybrid_pairs(spark, sf_dir):
    return P.hybrid(_pairs(spark, sf_dir).where("query_table < table_name"))


def _vectors(spark, sf_dir):
    return frames(spark, sf_dir)["embeddings"].select(F.col("vec_id").alias("id"), "embedding", "label")


def _asked(v):
    return v.where("id % 20 = 0")


def q_nearest(spark, sf_dir):
    """Ten nearest vectors by cosine of every vector whose id is divisible by 20, against all."""
    v = _vectors(spark, sf_dir)
    return vectors.nearest(_asked(v), v, 10).withColumn("score", F.round("score", 6)).drop("rank", "id").groupBy("query_id", "score").agg(F.count("*").alias("n"))


def q_nearest_ids(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return vectors.nearest(_asked(v), v, 10).select("query_id", "id", "rank")


def q_nearest_euclidean(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return vectors.nearest(_asked(v), v, 5, metric="euclidean").select("query_id", "id", "rank")


def q_nearest_filtered(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return vectors.nearest(_asked(v), v, 5, 0.1, where="label in (1, 3, 5)").select("query_id", "id", "rank")


def q_nearest_hybrid(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return vectors.nearest_hybrid(_asked(v), v, 5).select("query_id", "id", "rank")


def q_fused_queries(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    n = _asked(v).count()
    return vectors.fuse_queries(vectors.nearest(_asked(v), v, 10).drop("rank"), n, 10).withColumn("score", F.round("score", 6))


def q_nearest_among(spark, sf_dir):
    """The five nearest vectors among the fifty of the query's own stretch of ids."""
    v = _vectors(spark, sf_dir)
    stretch = F.floor(F.col("id") / 50).alias("stretch")
    candidates = _asked(v).select(F.col("id").alias("query_id"), stretch).join(v.select("id", stretch), "stretch").where("query_id != id")
    return vectors.nearest_among(_asked(v), v, candidates, 5).select("query_id", "id", "rank")


def q_relaxed_vectors(spark, sf_dir):
    """The vector layer's relaxed filter: above 0.25, then above half of it at 0.9, padded to ten at 0.7."""
    v = _vectors(spark, sf_dir)
    found = vectors.nearest(_asked(v), v, 12).select(F.col("query_id").alias("query_table"), F.col("id").alias("table_name"), "score")
    return metadata.relaxed(found, 6, 0.25, 0.9, 10, 0.7).select("query_table", "table_name", F.round("score", 6).alias("score"), "kind")


def q_index_search(spark, sf_dir):
    """Neighbours through an index of centroids; every vector is indexed.

    The vectors have no clusters to speak of, so a query probes three cells of four (recall on 500 vectors: 0.94, with half of them 0.81).
    """
    v = _vectors(spark, sf_dir)
    n = v.count()
    how = vectors.advice(n)
    centre = vectors.centroids(v, min(how["cells"], max(1, n // 25)))
    return vectors.index_search(_asked(v), vectors.assign(v, centre), centre, max(how["probes"], -(-3 * len(centre) // 4)), 10)


def _named(v):
    """The queries and all vectors, with ids as texts: ties go by these, as in the SQL."""
    name = F.col("id").cast("string")
    return _asked(v).withColumn("id", name), v.withColumn("id", name)


def _found(v, k: int):
    """The k nearest vectors of each query, as predictions."""
    return vectors.nearest(*_named(v), k).select(F.col("query_id").alias("query_table"), F.col("id").alias("table_name"), "score")


def _labels(v):
    """The vectors of a query's label are its truth; the pairs, too many to list, are counted."""
    name = F.col("id").cast("string")
    return evaluate.Labels(_asked(v).select(name.alias("query_table"), "label"), v.select(name.alias("table_name"), "label"))


def q_vector_metrics(spark, sf_dir):
    """Retrieval metrics of the nearest vectors, those of the same label being the truth."""
    v = _vectors(spark, sf_dir)
    return evaluate.macro(evaluate.query_metrics(_found(v, 10), _labels(v))).select("n_queries", *(F.round(m, 6).alias(m) for m in evaluate.METRICS))


def q_metric_spread(spark, sf_dir):
    """Mean, deviation, least and most of each retrieval metric over the queries."""
    v = _vectors(spark, sf_dir)
    return evaluate.spread(evaluate.query_metrics(_found(v, 10), _labels(v))).select("metric", *(F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")))


def _label_truth(v):
    q = _asked(v).select(F.col("id").cast("string").alias("query_table"), "label")
    return q.join(v.select(F.col("id").cast("string").alias("candidate_table"), "label"), "label").where("query_table != candidate_table").select("query_table", "candidate_table")


def _layers(v, ks: dict[str, int]):
    """Metrics of layers that let k vectors through, with a ``layer`` column; the vectors are searched once for all of them."""
    got = vectors.nearest(*_named(v), max(ks.values()))
    got = (materialize(got, "layers") if len(ks) > 1 else got).withColumnsRenamed({"query_id": "query_table", "id": "table_name"})
    inputs = _asked(v).select(F.col("id").cast("string").alias("query_table"), F.lit(v.count()).alias("n_in"))
    each = [evaluate.layer_metrics(inputs, got.where(F.col("rank") <= k), _labels(v)).withColumn("layer", F.lit(layer)) for layer, k in ks.items()]
    return functools.reduce(DataFrame.unionByName, each)


def q_layer_means(spark, sf_dir):
    """Means for each cut of two layers, one that lets 20 vectors through and one that lets 5."""
    both = _layers(_vectors(spark, sf_dir), {"wide": 20, "narrow": 5})
    return evaluate.layer_means(both).select("layer", "k", "n_queries", *(F.round(c, 6).alias(c) for c in ("filter_ratio", "retention", "precision", "recall", "hit")))


def q_layer_metrics(spark, sf_dir):
    return _layers(_vectors(spark, sf_dir), {"wide": 20}).select("query_table", "k", *(F.round(c, 6).alias(c) for c in ("filter_ratio", "retention", "precision", "recall")), "hit")


def q_truth_frequency(spark, sf_dir):
    return evaluate.truth_frequency(_label_truth(_vectors(spark, sf_dir)), 10)


def q_two_level(spark, sf_dir):
    """Three hits of each label at most, then the best five of each query."""
    v = _vectors(spark, sf_dir)
    hits = vectors.nearest(_asked(v), v, 30).drop("rank").join(v.select("id", F.col("label").alias("table_name")), "id")
    return vectors.two_level(hits, 5, 3).select("query_id", "id", "rank")


def q_early_stop(spark, sf_dir):
    f = metadata.table_features(lake(spark, sf_dir).tables)
    return fusion.early_stop(metadata.metadata_search(f, f, None, include_self=False), 0.7, 0.6)


def q_digest_vectors(spark, sf_dir):
    t = lake(spark, sf_dir).tables
    return t.select("table_name", F.posexplode(E.digest_vector(F.col("table_name"))).alias("dim", "x")).withColumn("x", F.round("x", 9))


def _lsh_items(spark, sf_dir):
    c = lake(spark, sf_dir).columns
    feats = c.select(F.concat_ws(".", "table_name", "column_name").alias("id"), X.lsh_column_features(F.col("column_name"), F.col("data_type"), F.col("sample_values")).alias("features"))
    return feats.withColumn("signature", lsh.signature(F.col("features")))


def q_minhash(spark, sf_dir):
    return _lsh_items(spark, sf_dir).select("id", F.posexplode("signature").alias("place", "x"))


def q_lsh_similar(spark, sf_dir):
    items = materialize(_lsh_items(spark, sf_dir), "lsh")
    return lsh.similar(items, items, 0.3, None)


def q_lsh_statistics(spark, sf_dir):
    """Buckets of all 32 bands of the columns' signatures."""
    return lsh.statistics(lsh.banded(_lsh_items(spark, sf_dir), 32)).withColumn("items_per_bucket", F.round("items_per_bucket", 6))


def q_minhash_estimate(spark, sf_dir):
    """Estimated similarity of columns that share one of 32 bands."""
    items = materialize(_lsh_items(spark, sf_dir), "lsh")
    both = lsh.candidates(items, items, 32).where("query_id < id")
    both = both.join(items.select(F.col("id").alias("query_id"), F.col("signature").alias("q_signature")), "query_id").join(items.select("id", "signature"), "id")
    return both.select("query_id", "id", F.round(lsh.estimate(F.col("q_signature"), F.col("signature")), 9).alias("estimate"))


def q_lsh_table_features(spark, sf_dir):
    t = lake(spark, sf_dir).tables
    return t.select("table_name", F.explode(X.lsh_table_features(F.col("table_name"), F.col("columns"))).alias("feature"))


def q_text_search(spark, sf_dir):
    return overlap.text_search(overlap.text_postings(lake(spark, sf_dir).columns), ["orders", "custkey", "string", "doc"], 10).withColumn("weight", F.round("weight", 6)).withColumn("score", F.round("score", 9))


def _semantic(spark, sf_dir):
    return P.by_names(_pairs(spark, sf_dir), 0.65)


def _by_value(spark, sf_dir):
    v = lake(spark, sf_dir).values
    query = v.select(F.col("table_name").alias("query_table"), F.col("column_name").alias("query_column"), "value")
    return overlap.value_overlap(query, v, 0.35)


def q_merged_hits(spark, sf_dir):
    return fusion.merge_hits(_semantic(spark, sf_dir), _by_value(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


def q_match_types(spark, sf_dir):
    """How many columns each kind of match ties together, for every two tables."""
    return fusion.type_histogram(fusion.merge_hits(_semantic(spark, sf_dir), _by_value(spark, sf_dir)))


def _table_scores(spark, sf_dir):
    hits = fusion.merge_hits(_semantic(spark, sf_dir), _by_value(spark, sf_dir))
    n = lake(spark, sf_dir).tables.select(F.col("table_name").alias("query_table"), F.col("column_count").alias("n_query"))
    return fusion.score_tables(hits, n)


def q_score_statistics(spark, sf_dir):
    return fusion.table_statistics(_table_scores(spark, sf_dir)).select("n_tables", *(F.round(c, 3).alias(c) for c in ("avg_score", "max_score", "min_score", "avg_matches")))


def q_table_scores(spark, sf_dir):
    out = _table_scores(spark, sf_dir)
    return out.select("query_table", "table_name", "n_matches", *(F.round(c, 3).alias(c) for c in ("avg_confidence", "coverage", "key_bonus", "score")))


def q_normalised_sums(spark, sf_dir):
    return fusion.normalised_sums(_semantic(spark, sf_dir), None).withColumn("score", F.round("score", 6))


def q_pair_scores(spark, sf_dir):
    return fusion.pair_score(P.by_names(_pairs(spark, sf_dir), 0.3), lake(spark, sf_dir).tables).withColumn("score", F.round("score", 3))


def q_best_pairs(spark, sf_dir):
    return fusion.best_pairs_score(P.by_names(_pairs(spark, sf_dir), 0.3), lake(spark, sf_dir).tables, 0.5).select("query_table", "table_name", "n_matches", *(F.round(c, 5).alias(c) for c in ("score", "similarity", "match_ratio")))


def q_greedy_matching(spark, sf_dir):
    return assignment.greedy(P.by_names(_pairs(spark, sf_dir), 0.5))


def q_explanation(spark, sf_dir):
    """The three best matched columns of every two tables, in words."""
    return assignment.explanation(assignment.greedy(P.by_names(_pairs(spark, sf_dir), 0.5)))


def q_assignment(spark, sf_dir):
    """Maximum-weight assignment of the columns of every two tables, and the scores from it."""
    found = materialize(assignment.matched_columns(P.by_names(_pairs(spark, sf_dir), 0.3), 0.6), "assigned")
    return assignment.enhanced(assignment.table_scores(found, lake(spark, sf_dir).tables))


def q_verdicts(spark, sf_dir):
    found = lake(spark, sf_dir)
    f = metadata.table_features(found.tables)
    return fusion.verdicts(metadata.metadata_search(f, f, None, include_self=False), found.tables, 5)


def q_top_down(spark, sf_dir):
    found = lake(spark, sf_dir)
    return discover.discover(found, query_tables=found.tables.select("table_name"), task="union").tables


def q_early_top_down(spark, sf_dir):
    """As ``top_down``, but queries with a vector score above ``Config.early_stop`` end at the vector layer."""
    found = lake(spark, sf_dir)
    return discover.top_down(found, found.tables.select("table_name"), early=True).tables


def q_keyword_search(spark, sf_dir):
    """The ten tables whose descriptions are nearest to some words."""
    return discover.by_keywords(lake(spark, sf_dir), "orders of a customer", threshold=0.0).tables


def q_assigned_tables(spark, sf_dir):
    """Tables like orders by an assignment of columns, among those that the metadata layer finds."""
    found = lake(spark, sf_dir)
    return discover.by_assignment(found, found.tables.where("table_name = 'orders'").select("table_name")).tables


def q_bottom_up(spark, sf_dir):
    found = lake(spark, sf_dir)
    asked = found.columns.where("table_name = 'orders'").select("table_name", "column_name")
    return discover.discover(found, query_columns=asked, task="join").tables


def q_pseudo_table(spark, sf_dir):
    """The key columns of the lake as one table."""
    found = lake(spark, sf_dir)
    out = discover.pseudo_table(found.columns.where("column_name like '%key'"), found)
    return out.select("table_name", "row_count", "column_count", F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["column_name"], c["data_type"])), "|").alias("columns"))


QUESTIONS = [
    (1, "find tables that join customer orders by id", 0, 0),
    (2, "combine similar tables with the same schema", 2, 14),
    (3, "analyze price trend and revenue of product by date", 1, 9),
    (4, "city and country of each customer email contact", 3, 40),
    (5, "", 0, 0),
    (6, "number of payment transactions per account and month with product inventory", 5, 30),
]


def q_query_analysis(spark, sf_dir):
    asked = spark.createDataFrame(QUESTIONS, "query_id int, text string, n_tables int, n_columns int")
    out = routing.analyse(asked)
    return out.select("query_id", *(F.array_join(c, "|").alias(c) for c in ("words", "domains", "types", "suggestions")), "intent", "complexity", "hierarchical", "max_candidates", "threshold", "top_tables", "top_columns")


def q_latencies(spark, sf_dir):
    return evaluate.latencies(frames(spark, sf_dir)["events"].select("event_type", F.col("value").alias("seconds")), "event_type")


def q_slow_queries(spark, sf_dir):
    """Latencies with the slow ones counted, and the share of users' actions that did not fail."""
    log = frames(spark, sf_dir)["events"].select((F.col("user_id") % 10).alias("part"), F.col("value").alias("seconds"), (F.col("event_type") == "error").alias("failed"))
    out = evaluate.latencies(log, "part", slow=100.0, failed="failed")
    return out.select("part", "n", "n_slow", "p50", "p90", "p99", *(F.round(c, 6).alias(c) for c in ("mean", "success_rate", "qps")))


def q_alerts(spark, sf_dir):
    """What is wrong with the log of events, views being taken for hits of a cache."""
    kind = lambda k: F.avg((F.col("event_type") == k).cast("double"))
    summary = frames(spark, sf_dir)["events"].agg((1 - kind("error")).alias("success_rate"), F.avg("value").alias("mean_seconds"), kind("view").alias("cache_hit_rate"))
    return evaluate.alerts(summary)


def q_windowed_counts(spark, sf_dir):
    out = incremental.windowed_counts(frames(spark, sf_dir)["events"], "ts", "event_type", "1 day")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def q_upsert(spark, sf_dir):
    """Open orders replaced by closed ones of a higher price."""
    o = frames(spark, sf_dir)["orders"].select("o_orderkey", "o_orderstatus", "o_custkey")
    new = o.where("o_orderstatus = 'O'").select("o_orderkey", F.lit("F").alias("o_orderstatus"), "o_custkey")
    return store.upsert(o, new, ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}
