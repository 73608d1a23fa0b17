"""Features of tables and columns that rules derive from names, types and samples, and their text forms.

Columns of a table are passed as an array of structs (column_name, data_type, sample_values, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lakefinder.functions import normalize as N

#: Words of each domain, in the order in which they are tested.
DOMAINS = {
    "user": ("user", "customer", "member", "account"),
    "order": ("order", "purchase", "transaction", "payment"),
    "product": ("product", "item", "goods", "sku"),
    "log": ("log", "event", "history", "audit"),
    "config": ("config", "setting", "param", "option"),
    "dim": ("dim_", "dimension_", "d_"),
    "fact": ("fact_", "f_", "agg_"),
    "tmp": ("tmp_", "temp_", "staging_"),
}
KEYS = "id|key|code|no|num"
MATCHER_KEYS = "id|key|code|_no|_num"
IDENTIFIERS = "id|key|ref"
DIMENSION, FACT = "dim_|dimension_|d_", "fact_|f_|agg_"
TYPE_ORDER = ("numeric", "string", "datetime", "boolean", "other")
#: Semantic groups of columns, the first that fits.
SEMANTIC_GROUPS = {
    "naming": ("name", "title", "label"),
    "temporal": ("date", "time", "created", "updated"),
    "contact": ("email", "phone", "address", "contact"),
    "financial": ("price", "cost", "amount", "value"),
    "identifier": ("id", "key"),
}
#: Parts of schema patterns.
SCHEMA_PARTS = {
    "ID": ("id",),
    "NAME": ("name", "title", "label"),
    "TIME": ("date", "time", "created", "updated"),
    "CONTACT": ("email", "phone", "address"),
    "MONEY": ("price", "cost", "amount", "value"),
}
#: Types that a column's name tells.
NAMED_TYPES = {
    "identifier": ("id",),
    "temporal": ("date", "time", "created", "updated"),
    "text": ("name", "title", "description", "text"),
    "numeric": ("price", "cost", "amount", "count", "number"),
}


def domain(table: Column) -> Column:
    return N.classify(F.lower(table), DOMAINS, "general")


def steps(x: Column, bounds: tuple[int, ...], names: tuple) -> Column:
    """The name of the first bound that x does not exceed, or the last name."""
    out = F.lit(names[-1])
    for b, n in zip(reversed(bounds), reversed(names[:-1]), strict=True):
        out = F.when(x <= b, F.lit(n)).otherwise(out)
    return out


def size_category(n_columns: Column) -> Column:
    return steps(n_columns, (5, 20), (0, 1, 2))


def column_bucket(n_columns: Column) -> Column:
    return steps(n_columns, (5, 10, 20, 50), (5, 10, 20, 50, 100))


def column_range(n_columns: Column) -> Column:
    return steps(n_columns, (5, 15, 30), ("small", "medium", "large", "xlarge"))


def row_range(n_rows: Column) -> Column:
    return steps(n_rows, (1_000, 10_000, 100_000, 1_000_000), ("tiny", "small", "medium", "large", "huge"))


def naming_pattern(table: Column) -> Column:
    """first_*_last of names with underscores; camel-case names with * for each capital; else simple."""
    parts = F.split(table, "_")
    return (
        F.when(F.contains(table, F.lit("_")), F.concat(F.element_at(parts, 1), F.lit("_*_"), F.element_at(parts, -1)))
        .when(F.substring(table, 2, 1 << 20).rlike("[A-Z]"), F.regexp_replace(table, "[A-Z]", "*"))
        .otherwise("simple")
    )


def count_type(columns: Column, name: str) -> Column:
    return F.size(F.filter(columns, lambda c: N.metadata_type(c["data_type"]) == name)).cast("int")


def type_signature(columns: Column) -> Column:
    """numeric:3|string:2 ... in a fixed order, without classes of no columns."""
    parts = [F.when(count_type(columns, t) > 0, F.concat(F.lit(f"{t}:"), count_type(columns, t).cast("string"))) for t in TYPE_ORDER]
    return F.concat_ws("|", *parts)


def names_like(columns: Column, pattern: str) -> Column:
    """Names of the columns whose lower-cased name has the pattern, in order of the columns."""
    return F.transform(F.filter(columns, lambda c: F.lower(c["column_name"]).rlike(pattern)), lambda c: c["column_name"])


def key_columns(columns: Column) -> Column:
    return names_like(columns, KEYS)


def matcher_keys(columns: Column) -> Column:
    return names_like(columns, MATCHER_KEYS)


def identifier_columns(columns: Column) -> Column:
    return names_like(columns, IDENTIFIERS)


def is_dimension(table: Column) -> Column:
    return F.lower(table).rlike(DIMENSION)


def is_fact(table: Column) -> Column:
    return F.lower(table).rlike(FACT)


def foreign_key_ratio(columns: Column) -> Column:
    hits = F.size(F.filter(columns, lambda c: F.lower(c["column_name"]).rlike("(_id|_key)$")))
    return F.when(F.size(columns) > 0, hits / F.size(columns)).otherwise(F.lit(0.0))


def schema_pattern(columns: Column) -> Column:
    names = F.array_sort(F.transform(columns, lambda c: F.lower(c["column_name"])))
    return F.array_join(F.transform(names, lambda n: N.classify(n, SCHEMA_PARTS, "OTHER")), "|")


def domain_keywords(table: Column, columns: Column) -> Column:
    parts = F.transform(columns, lambda c: N.keywords(c["column_name"]))
    return F.array_sort(F.array_distinct(F.concat(N.keywords(table), F.flatten(parts))))


def semantic_group(column: Column) -> Column:
    return N.classify(F.lower(column), SEMANTIC_GROUPS, "general")


def mostly_numeric(samples: Column) -> Column:
    """Whether the numbers among the first five samples are 80 % of all samples."""
    hits = F.size(F.filter(F.slice(samples, 1, 5), lambda x: N.number(x).isNotNull()))
    return (F.size(samples) > 0) & (hits >= 0.8 * F.size(samples))


def inferred_type(column: Column, samples: Column) -> Column:
    """A type from the name, else from the samples, else text."""
    by_name = N.classify(F.lower(column), NAMED_TYPES, None)
    return F.coalesce(by_name, F.when(mostly_numeric(samples), "numeric"), F.lit("text"))


def is_numeric(data_type: Column, samples: Column) -> Column:
    words = ("int", "integer", "float", "double", "decimal", "number", "numeric")
    return F.coalesce(N.has(N.outer_type(data_type), words), F.lit(False)) | F.coalesce(mostly_numeric(samples), F.lit(False))


def table_signature(columns: Column) -> Column:
    """cols:N|types:a,b|ids:K, the types sorted."""
    types = F.array_sort(F.array_distinct(F.transform(columns, lambda c: N.query_type(c["data_type"], inferred_type(c["column_name"], c["sample_values"])))))
    return F.concat(
        F.lit("cols:"), F.size(columns).cast("string"), F.lit("|types:"), F.array_join(types, ","), F.lit("|ids:"), F.size(identifier_columns(columns)).cast("string")
    )


def lsh_column_features(name: Column, data_type: Column, samples: Column) -> Column:
    """name:, word:, type:, value: and value_type: features of a column, without repeats."""
    values = F.transform(F.filter(F.slice(samples, 1, 10), lambda v: v.isNotNull()), lambda v: F.lower(v.cast("string")))
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("name:"), F.lower(name))),
            _words(name, "word:"),
            F.when(F.length(data_type) > 0, F.array(F.concat(F.lit("type:"), F.lower(data_type)))).otherwise(F.array().cast("array<string>")),
            F.transform(values, lambda v: F.concat(F.lit("value:"), v)),
            F.transform(values, lambda v: F.when(N.number(v).isNotNull(), "value_type:numeric").otherwise("value_type:text")),
        )
    )


def _words(name: Column, prefix: str) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(name), "_", " "), " +"), lambda x: x != "")
    return F.transform(words, lambda x: F.concat(F.lit(prefix), x))


def lsh_table_features(table: Column, columns: Column) -> Column:
    """table:, table_word:, has_column:, has_type:, column_count: and table_size: features of a table."""
    n = F.size(columns)
    typed = F.filter(columns, lambda c: F.length(c["data_type"]) > 0)
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("table:"), F.lower(table))),
            _words(table, "table_word:"),
            F.transform(columns, lambda c: F.concat(F.lit("has_column:"), F.lower(c["column_name"]))),
            F.transform(typed, lambda c: F.concat(F.lit("has_type:"), F.lower(c["data_type"]))),
            F.array(F.concat(F.lit("column_count:"), n.cast("string")), F.concat(F.lit("table_size:"), steps(n, (5, 15), ("small", "medium", "large")))),
        )
    )


def column_text(table: Column, column: Column, data_type: Column, samples: Column, n_samples: int = 5) -> Column:
    """The text of a column for embedding; the variants differ in how many samples they show (5, 3 or 0)."""
    shown = F.array_join(F.transform(F.slice(samples, 1, n_samples), lambda v: v.cast("string")), ", ") if n_samples else F.lit("")
    return F.concat_ws(" | ", F.concat(F.lit("Table: "), table), F.concat(F.lit("Column: "), column), F.concat(F.lit("Type: "), F.coalesce(data_type, F.lit("unknown"))), F.when(shown != "", F.concat(F.lit("Samples: "), shown)))


def table_text(table: Column, columns: Column, description: Column | None = None, n_columns: int | None = None) -> Column:
    """The text of a table for embedding; one serialiser serves the index and the queries."""
    own = F.slice(columns, 1, n_columns) if n_columns else columns
    listed = F.array_join(F.transform(own, lambda c: F.concat(c["column_name"], F.lit(" ("), F.coalesce(c["data_type"], F.lit("unknown")), F.lit(")"))), ", ")
    parts = [F.concat(F.lit("Table: "), table), F.concat(F.lit("Columns: "), listed)]
    return F.concat_ws(" | ", *parts, *([F.concat(F.lit("Description: "), description)] if description is not None else []))


def name_text(table: Column, columns: Column) -> Column:
    """Names only: the table and its columns."""
    return F.concat_ws(" ", table, F.array_join(F.transform(columns, lambda c: c["column_name"]), " "))
