"""What a request asks for: its strategy, and the analysis of its words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakefinder.functions import normalize as N

#: Words that tell a domain, an intent, and types.
DOMAINS = {
    "customer": ("customer", "client", "user", "account", "buyer", "consumer"),
    "order": ("order", "purchase", "transaction", "sale", "invoice", "receipt"),
    "product": ("product", "item", "goods", "merchandise", "inventory", "catalog"),
    "employee": ("employee", "staff", "worker", "personnel", "team", "member"),
    "financial": ("payment", "price", "cost", "revenue", "profit", "expense", "budget"),
    "temporal": ("date", "time", "timestamp", "created", "updated", "modified"),
    "location": ("address", "city", "country", "region", "location", "place"),
    "contact": ("email", "phone", "contact", "communication", "message"),
}
INTENTS = {
    "join": ("join", "joinable", "link", "connect", "relate", "match", "merge"),
    "union": ("union", "combine", "similar", "same", "equivalent", "identical"),
    "analysis": ("analyze", "analysis", "insight", "pattern", "trend", "statistics"),
    "search": ("find", "search", "discover", "locate", "identify", "look"),
}
TYPES = {
    "numeric": ("number", "numeric", "integer", "decimal", "float", "count", "amount"),
    "text": ("text", "string", "name", "title", "description", "label"),
    "temporal": ("date", "time", "timestamp", "datetime", "year", "month"),
    "identifier": ("id", "key", "identifier", "reference", "code", "index"),
}


def strategy(has_tables: bool, has_columns: bool) -> str:
    """bottom_up from columns alone; top_down from tables, also where both are given."""
    if not has_tables and not has_columns:
        raise ValueError("a query needs a table or a column")
    return "top_down" if has_tables else "bottom_up"


def _words(found: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, found))


def _hits(words: Column, classes: dict[str, tuple[str, ...]]) -> Column:
    some = F.array(*(F.when(F.arrays_overlap(words, _words(w)), F.lit(n)) for n, w in classes.items()))
    return F.filter(some, lambda x: x.isNotNull())


def analyse(queries: DataFrame) -> DataFrame:
    """Queries (query_id, text, n_tables, n_columns) with their words, domains, intent, types, complexity and search parameters.

    The intent with most words wins, the first of equal ones; a query without such words is a search.
    """
    words = N.query_words(F.coalesce("text", F.lit("")))
    out = queries.withColumn("words", F.array_sort(words)).withColumn("domains", _hits(F.col("words"), DOMAINS)).withColumn("types", _hits(F.col("words"), TYPES))
    scores = F.array(*(F.struct(F.size(F.array_intersect("words", _words(w))).alias("n"), F.lit(-i).alias("order"), F.lit(n).alias("intent")) for i, (n, w) in enumerate(INTENTS.items())))
    best = F.array_max(scores)
    out = out.withColumn("intent", F.when(best["n"] > 0, best["intent"]).otherwise("search"))
    tables = F.when(F.col("n_tables") > 0, F.least(F.col("n_tables") * 0.1, F.lit(0.4)) + F.least(F.col("n_columns") * 0.01, F.lit(0.3))).otherwise(0.0)
    c = F.round(F.least(F.least(F.size("words") * 0.05, F.lit(0.3)) + F.size("domains") * 0.1 + tables, F.lit(1.0)), 9)
    out = out.withColumn("complexity", c)
    complexity, n_domains, intent = F.col("complexity"), F.size("domains"), F.col("intent")
    return out.withColumns({
        "hierarchical": complexity > 0.5,
        "max_candidates": F.when(complexity < 0.3, 200).when(complexity < 0.6, 500).otherwise(1000),
        "threshold": F.round(F.greatest(0.7 - F.when(complexity > 0.7, 0.1).otherwise(0.0) - F.when(n_domains > 2, 0.05).otherwise(0.0), F.lit(0.5)), 9),
        "top_tables": F.when(complexity > 0.7, 100).when(complexity < 0.3, 20).otherwise(50),
        "top_columns": F.when(intent == "join", 30).when(intent == "analysis", 100).otherwise(50),
        "suggestions": F.filter(
            F.array(
                F.when(complexity > 0.7, "use_prefiltering"),
                F.when(intent == "join", "focus_on_identifier_columns").when(intent == "union", "focus_on_schema_similarity"),
                F.when(n_domains > 1, "multi_domain_query"),
            ),
            lambda x: x.isNotNull(),
        ),
    })


def components(n_candidates: int) -> dict[str, bool]:
    """Which parts a search of so many candidates uses; for explanations, as Spark plans the rest."""
    return {"fast_path": n_candidates < 50, "lsh": n_candidates >= 200, "vector": n_candidates >= 100, "cache": n_candidates >= 10, "parallel": n_candidates >= 20}
