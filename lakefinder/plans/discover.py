"""Whole searches: from columns (which tables join) and from tables (which tables join or unite)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from lakefinder.config import PRESETS, Config
from lakefinder.functions import features as X, similarity as S
from lakefinder.functions.embedding import EmbeddingProvider, embed
from lakefinder.operators import assignment, fusion, metadata, overlap, vectors
from lakefinder.plans import columns as P, routing, verify
from lakefinder.scratch import materialize
from lakefinder.sources.catalog import Lake


@dataclass
class Found:
    """Results of a search: ranked tables, the column matches behind them, and the strategy."""

    strategy: str
    tables: DataFrame
    matches: DataFrame | None = None
    errors: list[str] = field(default_factory=list)


def column_vectors(columns: DataFrame, provider: EmbeddingProvider | None = None) -> DataFrame:
    """(id, table_name, column_name, data_type, embedding); the id is the position among names, not a joined name."""
    text = X.column_text(F.col("table_name"), F.col("column_name"), F.col("data_type"), F.col("sample_values"))
    rows = columns.select(F.to_json(F.array("table_name", "column_name")).alias("id"), "table_name", "column_name", "data_type", text.alias("text"))
    return embed(rows, "text", provider).drop("text")


def table_vectors(tables: DataFrame, provider: EmbeddingProvider | None = None) -> DataFrame:
    """(id, column_count, embedding) of tables; the same text serves the index and the queries."""
    rows = tables.select(F.col("table_name").alias("id"), "column_count", X.table_text(F.col("table_name"), F.col("columns")).alias("text"))
    return embed(rows, "text", provider).drop("text")


def bottom_up(lake: Lake, query_columns: DataFrame, config: Config = Config(), provider: EmbeddingProvider | None = None, verifier: verify.Verifier | None = None) -> Found:
    """Tables to join, from query columns (table_name, column_name): meaning and values, fused, filtered and summed up by table."""
    asked = lake.columns.join(query_columns.select("table_name", "column_name").distinct(), ["table_name", "column_name"], "left_semi")
    index = materialize(column_vectors(lake.columns, provider), "column_vectors")
    q = index.join(query_columns.select("table_name", "column_name").distinct(), ["table_name", "column_name"], "left_semi")
    hits = vectors.nearest(q, index, config.max_candidates, config.semantic_threshold, apart=None if config.include_self else "table_name")
    name = index.select("id", "table_name", "column_name")
    semantic = hits.join(name.select(F.col("id").alias("query_id"), F.col("table_name").alias("query_table"), F.col("column_name").alias("query_column")), "query_id").join(name, "id")
    semantic = semantic.select("query_table", "query_column", "table_name", "column_name", "score")
    own = lake.values.join(query_columns, ["table_name", "column_name"], "left_semi").select(F.col("table_name").alias("query_table"), F.col("column_name").alias("query_column"), "value")
    by_value = overlap.value_overlap(own, lake.values, config.overlap_threshold, config.max_candidates, config.include_self)
    merged = materialize(fusion.merge_hits(semantic, by_value), "merged")
    pairs = P.column_pairs(lake.columns, merged.select("query_table", "table_name"), per_table=1 << 30)
    pairs = pairs.join(merged.select(*fusion.COLUMNS), fusion.COLUMNS, "left_semi")
    similar = P.hybrid(pairs).withColumnRenamed("score", "similarity")
    enhanced = verify.judged_columns(fusion.enhance(merged, similar), lake.columns, verifier)
    matches = materialize(fusion.keep_best(enhanced, config.confidence_threshold, config.top_k), "matches")
    n_query = asked.groupBy(F.col("table_name").alias("query_table")).agg(F.count("*").alias("n_query"))
    scores = verify.judged_tables(fusion.score_tables(matches, n_query, config), lake.tables, verifier)
    tables = overlap.top_k(scores, config.top_k, ["query_table"], ["score"], ["table_name"])
    return Found("bottom_up", tables, matches)


def top_down(lake: Lake, query_tables: DataFrame, config: Config = Config(), provider: EmbeddingProvider | None = None, verifier: verify.Verifier | None = None, early: bool = False) -> Found:
    """Tables like the query tables (table_name), by the funnel: metadata, then vectors among those, then rules and verdicts.

    early: queries whose best vector score is above ``config.early_stop`` end there, with up to ten
    tables above 0.5; they go through no rules and to no verifier.
    """
    layers = funnel(lake, query_tables, config, provider)
    if early:
        stops = materialize(fusion.early_stop(layers["vectors"], config.early_stop).where("stop").select("query_table"), "stops")
        done = metadata.threshold(layers["vectors"].drop("rank").join(stops, "query_table", "left_semi"), 0.5, 10)
        going = lake_queries(query_tables).join(stops, "query_table", "left_anti").select(F.col("query_table").alias("table_name"))
        rest = _ruled(lake, {n: x.join(stops, "query_table", "left_anti") for n, x in layers.items()}, config, verifier) if not going.isEmpty() else None
        out = done.select("query_table", "table_name", F.round(100 * F.col("score"), 6).alias("score"), F.lit("early").alias("method"), "rank")
        return Found("top_down", out if rest is None else out.unionByName(rest))
    return Found("top_down", _ruled(lake, layers, config, verifier))


def lake_queries(query_tables: DataFrame) -> DataFrame:
    return query_tables.select(F.col("table_name").alias("query_table")).distinct()


def _ruled(lake: Lake, layers: dict[str, DataFrame], config: Config, verifier: verify.Verifier | None) -> DataFrame:
    """Rules and verdicts on the vector layer's output."""
    ruled = fusion.verdicts(layers["vectors"], lake.tables, config.l3_top)
    uncertain = ruled.where("method = 'uncertain'")
    if verifier is not None:
        answers = verify.ask(verify.prompts(uncertain, lake.tables), verifier)
        rest = fusion.judged(uncertain, answers)
    else:
        rest = uncertain
    best = fusion.merge_verdicts(ruled.where("method = 'rule'"), rest, config.top_k)
    return best.select(F.col("query_table"), "table_name", F.round(100 * F.col("score"), 6).alias("score"), "method", "rank")


def funnel(lake: Lake, query_tables: DataFrame, config: Config = Config(), provider: EmbeddingProvider | None = None) -> dict[str, DataFrame]:
    """The layers' outputs: ``metadata`` and, restricted to its best names, ``vectors``; each (query_table, table_name, score)."""
    features = materialize(metadata.table_features(lake.tables), "features")
    asked = features.join(query_tables.select("table_name").distinct(), "table_name", "left_semi")
    first = metadata.metadata_search(asked, features, config.l1_top, config.include_self)
    first = materialize(first, "layer1")
    few = overlap.top_k(first.drop("rank"), config.l2_names, ["query_table"], ["score"], ["table_name"])
    index = materialize(table_vectors(lake.tables, provider), "table_vectors")
    q = index.join(query_tables.select(F.col("table_name").alias("id")).distinct(), "id", "left_semi")
    # score the candidates alone: the restriction comes before the ranking
    candidates = few.select(F.col("query_table").alias("query_id"), F.col("table_name").alias("id"))
    scored = vectors.nearest_among(q, index, candidates, None, config.l2_threshold).select(F.col("query_id").alias("query_table"), F.col("id").alias("table_name"), "score")
    second = overlap.top_k(scored, config.l2_top, ["query_table"], ["score"], ["table_name"])
    return {"metadata": first, "vectors": materialize(second, "layer2")}


def by_keywords(lake: Lake, text: str, config: Config = Config(), provider: EmbeddingProvider | None = None, threshold: float = 0.5, k: int = 10) -> Found:
    """Tables whose description is near to some words, by their vectors; a text without words finds nothing."""
    spark = lake.tables.sparkSession
    asked = spark.createDataFrame([("query", text)], "id string, text string")
    hits = vectors.nearest(embed(asked, "text", provider).drop("text"), table_vectors(lake.tables, provider), k, threshold, include_self=True)
    return Found("keywords", hits.select(F.lit(text).alias("query_table"), F.col("id").alias("table_name"), F.round(100 * F.col("score"), 6).alias("score"), "rank"))


def asked_in_words(lake: Lake, text: str, query_tables: DataFrame | None = None, query_columns: DataFrame | None = None, provider: EmbeddingProvider | None = None, verifier: verify.Verifier | None = None) -> Found:
    """A search steered by the words of its request: their intent chooses the preset, their complexity the candidates and thresholds."""
    spark = lake.tables.sparkSession
    n_tables = query_tables.count() if query_tables is not None else 0
    n_columns = query_columns.count() if query_columns is not None else 0
    how = routing.analyse(spark.createDataFrame([(1, text, n_tables, n_columns)], "query_id int, text string, n_tables int, n_columns int")).first()
    base = PRESETS.get(how.intent, Config())
    config = replace(base, max_candidates=how.max_candidates, top_k=base.top_k)
    if query_tables is None and query_columns is None:
        return by_keywords(lake, text, config, provider, min(how.threshold, 0.5), min(how.top_tables, config.top_k))
    if query_tables is not None:
        return top_down(lake, query_tables, config, provider, verifier)
    return bottom_up(lake, query_columns, config, provider, verifier)


def by_assignment(lake: Lake, query_tables: DataFrame, config: Config = Config()) -> Found:
    """Tables by a maximum-weight assignment of their columns to the query table's.

    Compared are the tables that the metadata layer finds, of ``config.max_table_columns`` columns
    at most and one at least.
    """
    fits = lake.tables.where(F.col("column_count").between(1, config.max_table_columns))
    features = materialize(metadata.table_features(fits), "features")
    asked = features.join(query_tables.select("table_name").distinct(), "table_name", "left_semi")
    few = metadata.metadata_search(asked, features, config.l1_top, config.include_self)
    pairs = P.by_names(P.column_pairs(lake.columns, few), 0.3)
    matches = materialize(assignment.matched_columns(pairs, config.match_threshold), "assigned")
    scores = assignment.enhanced(assignment.table_scores(matches, lake.tables), config.assignment_weights)
    tables = overlap.top_k(scores.select("query_table", "table_name", "n_matched", "score"), config.top_k, ["query_table"], ["score"], ["table_name"])
    return Found("assignment", tables, matches.withColumnRenamed("score", "confidence").withColumn("match_type", F.lit("assignment")))


def pseudo_table(query_columns: DataFrame, lake: Lake, name: str = "query") -> DataFrame:
    """One table made of loose columns (table_name, column_name), in the form of ``Lake.tables``."""
    own = lake.columns.join(query_columns.select("table_name", "column_name").distinct(), ["table_name", "column_name"], "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("table_name", "ordinal", "column_name", "data_type", "sample_values", "null_count", "unique_count")))
    bare = F.transform(parts, lambda c: F.struct(*(c[x].alias(x) for x in ("ordinal", "column_name", "data_type", "sample_values", "null_count", "unique_count"))))
    return own.groupBy(F.lit(name).alias("table_name")).agg(F.max("row_count").alias("row_count"), bare.alias("columns")).withColumn("column_count", F.size("columns"))


def attempt(search, *args, **kwargs) -> Found:
    """A search whose failure is a result: no tables, and what went wrong."""
    lake = args[0]
    try:
        return search(*args, **kwargs)
    except Exception as e:  # noqa: BLE001  told to whoever asked, in the result
        none = lake.tables.sparkSession.createDataFrame([], "query_table string, table_name string, score double, rank int")
        return Found("failed", none, errors=[f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"])


def discover(lake: Lake, query_tables: DataFrame | None = None, query_columns: DataFrame | None = None, task: str | None = None, provider: EmbeddingProvider | None = None, verifier: verify.Verifier | None = None) -> Found:
    """Search with what is given: tables (and then columns do not matter) or columns."""
    config = PRESETS[task] if task in PRESETS else Config()
    how = routing.strategy(query_tables is not None, query_columns is not None)
    if how == "top_down":
        return top_down(lake, query_tables, config, provider, verifier)
    return bottom_up(lake, query_columns, config, provider, verifier)
