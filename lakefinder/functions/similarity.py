"""Similarities of names, values, statistics, tables and vectors, as Column expressions.

All are symmetric unless said otherwise and lie between 0 and 1.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from lakefinder.functions import features as X, normalize as N


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(empty))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Of two sets given as arrays without repeats; one empty set gives 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


# Names

def levenshtein(a: Column, b: Column) -> Column:
    """1 - distance / longer length, lower case; 0 if either is empty."""
    a, b = F.lower(a), F.lower(b)
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b)))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of lower-cased names; apply it to distinct pairs only."""
    made: dict[tuple[str, str], float] = {}
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        key = (x.lower(), y.lower())
        if key not in made:
            made[key] = difflib.SequenceMatcher(None, *key).ratio()
        out.append(made[key])
    return pd.Series(out, dtype="float64")


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(N.tokens(a), N.tokens(b))


def name(a: Column, b: Column) -> Column:
    """0.4 Levenshtein + 0.3 sequence ratio + 0.3 token Jaccard."""
    return 0.4 * levenshtein(a, b) + 0.3 * sequence_ratio(a, b) + 0.3 * token_jaccard(a, b)


def character_jaccard(a: Column, b: Column) -> Column:
    """Of the sets of characters, lower case; equal names 1, an empty one 0."""
    chars = lambda s: F.array_distinct(F.filter(F.split(F.lower(s), ""), lambda c: c != ""))
    return F.when(F.lower(a) == F.lower(b), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(jaccard(chars(a), chars(b)))


def table_name(a: Column, b: Column) -> Column:
    """Equal 1; one within the other 0.8; else half the share of a common beginning; without one 0.1."""
    a, b = F.lower(a), F.lower(b)
    longer = F.greatest(F.char_length(a), F.char_length(b))
    shorter = F.least(F.char_length(a), F.char_length(b))
    prefix = F.size(F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda k: (k <= shorter) & (F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))))
    return F.when(a == b, F.lit(1.0)).when(F.contains(a, b) | F.contains(b, a), F.lit(0.8)).when(prefix > 0, 0.5 * prefix / longer).otherwise(F.lit(0.1))


def stripped(column: Column) -> Column:
    """A column's name without what marks keys."""
    out = F.lower(column)
    for part in ("^fk_", "^pk_", "^idx_", "_id$", "_key$", "_code$", "_no$"):
        out = F.regexp_replace(out, part, "")
    return out


# Statistics: columns of each side are passed as m (mean), s (population deviation), q (quartiles), r (range), n

def difference(a: Column, b: Column, *scale: Column) -> Column:
    return 1 - F.least(F.abs(a - b) / F.greatest(*scale, F.lit(1.0)), F.lit(1.0))


def numeric(m1, m2, s1, s2, s_all, q1, q2, r1, r2, n1, n2) -> Column:
    """0.4 of means + 0.3 of deviations + 0.3 of quartiles; 0 if a side has no numbers."""
    means = difference(m1, m2, s_all, F.abs(m1), F.abs(m2))
    deviations = difference(s1, s2, s1, s2)
    quartiles = sum(difference(q1[k], q2[k], r1, r2, F.abs(q1[k]), F.abs(q2[k])) for k in range(3)) / 3
    return F.when((n1 == 0) | (n2 == 0), F.lit(0.0)).otherwise(0.4 * means + 0.3 * deviations + 0.3 * quartiles)


def frequency_cosine(a: Column, b: Column) -> Column:
    """Cosine of the counts of the values of two arrays."""
    count = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    dot = F.aggregate(F.array_union(a, b), F.lit(0.0), lambda s, v: s + count(a, v) * count(b, v))
    norm = lambda xs: F.sqrt(F.aggregate(F.array_distinct(xs), F.lit(0.0), lambda s, v: s + F.pow(count(xs, v), F.lit(2))))
    return ratio(dot, norm(a) * norm(b))


def categorical(a: Column, b: Column) -> Column:
    """0.6 Jaccard + 0.4 cosine of frequencies, of arrays of categories with repeats."""
    return 0.6 * jaccard(F.array_distinct(a), F.array_distinct(b), 0.0) + 0.4 * frequency_cosine(a, b)


def structural(t1: Column, t2: Column, null1: Column, null2: Column) -> Column:
    """Mean of the types' and the null counts' similarity, of what is known; else 0."""
    a, b = F.lower(t1), F.lower(t2)
    alike = F.lit(False)
    for words in (("int", "float", "number"), ("str", "text", "char")):
        for w in words:
            alike = alike | (F.contains(a, F.lit(w)) & F.contains(b, F.lit(w)))
    types = F.when(t1.isNotNull() & t2.isNotNull(), F.when(a == b, 1.0).when(alike, 0.8).otherwise(0.0))
    nulls = F.when(null1.isNotNull() & null2.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(null1 - null2) / 100))
    known = types.isNotNull().cast("int") + nulls.isNotNull().cast("int")
    return F.when(known > 0, (F.coalesce(types, F.lit(0.0)) + F.coalesce(nulls, F.lit(0.0))) / known).otherwise(F.lit(0.0))


def column(name_sim: Column, structure: Column | None = None, semantics: Column | None = None) -> Column:
    """By name alone, or 0.4 name + 0.2 structure + 0.4 values where there are samples."""
    return name_sim if structure is None else 0.4 * name_sim + 0.2 * structure + 0.4 * semantics


def type_match(t1: Column, t2: Column) -> Column:
    """Equal 1, same group 0.8, integer and float 0.6, other groups 0.2, without group 0.1, null 0."""
    a, b = F.lower(F.trim(t1)), F.lower(F.trim(t2))
    g1, g2 = N.type_group(t1), N.type_group(t2)
    numbers = g1.isin("integer", "float") & g2.isin("integer", "float")
    return (
        F.when(t1.isNull() | t2.isNull(), F.lit(0.0))
        .when(a == b, 1.0)
        .when(g1.isNull() | g2.isNull(), 0.1)
        .when(g1 == g2, 0.8)
        .when(numbers, 0.6)
        .otherwise(0.2)
    )


def values(a: Column, b: Column) -> Column:
    """0.8 Jaccard of categories + 0.2 ratio of the numbers of samples; 0 without samples."""
    x, y = F.array_distinct(N.categories(a)), F.array_distinct(N.categories(b))
    sizes = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b), F.lit(1))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(0.8 * jaccard(x, y) + 0.2 * sizes)


def stats(unique1: Column, unique2: Column, null1: Column, null2: Column) -> Column:
    """Mean of the ratio of distinct counts and the nearness of null counts, of what is known; else 0."""
    unique = F.when(F.greatest(unique1, unique2) > 0, F.least(unique1, unique2) / F.greatest(unique1, unique2))
    unique = F.when(unique1.isNotNull() & unique2.isNotNull(), unique)
    nulls = F.when(null1.isNotNull() & null2.isNotNull(), 1 - F.abs(null1 - null2) / F.greatest(null1 + null2, F.lit(1)))
    known = unique.isNotNull().cast("int") + nulls.isNotNull().cast("int")
    return F.when(known > 0, (F.coalesce(unique, F.lit(0.0)) + F.coalesce(nulls, F.lit(0.0))) / known).otherwise(F.lit(0.0))


def match_type(name_sim: Column, value_sim: Column) -> Column:
    return F.when((name_sim > 0.8) & (value_sim > 0.5), "semantic+value").when(name_sim > 0.7, "semantic").when(value_sim > 0.6, "value_overlap").otherwise("comprehensive")


def match_reason(name_sim: Column, type_sim: Column, value_sim: Column, stats_sim: Column) -> Column:
    """What speaks for a match, in words."""
    said = F.concat_ws(
        ", ",
        F.when(name_sim > 0.8, "names very similar").when(name_sim > 0.6, "names similar"),
        F.when(type_sim > 0.8, "types match").when(type_sim > 0.5, "types compatible"),
        F.when(value_sim > 0.6, "values distributed alike").when(value_sim > 0.3, "some values shared"),
        F.when(stats_sim > 0.7, "statistics similar"),
    )
    return F.when(said == "", "weak similarity").otherwise(said)


# Tables: arrays of column structs, or names and maps of counts

def metadata(domain1, domain2, size1, size2, n1, n2, types1, types2, keys1, keys2) -> Column:
    """0.3 domain + 0.2 size + 0.2 number of columns + 0.2 cosine of type counts + 0.1 Jaccard of key columns.

    types1, types2: arrays of counts in the order of ``features.TYPE_ORDER``.
    """
    dot = F.aggregate(F.zip_with(types1, types2, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = lambda xs: F.sqrt(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x * x))
    keys = F.when((F.size(keys1) > 0) & (F.size(keys2) > 0), jaccard(F.array_distinct(keys1), F.array_distinct(keys2))).otherwise(F.lit(0.0))
    return (
        0.3 * (domain1 == domain2).cast("double")
        + 0.2 * (1 - F.abs(size1 - size2) / 3)
        + 0.2 * (1 - F.abs(n1 - n2) / F.greatest(n1, n2, F.lit(1)))
        + 0.2 * ratio(dot, norm(types1) * norm(types2))
        + 0.1 * keys
    )


def signature(n1, n2, types1, types2, pattern1, pattern2, words1, words2) -> Column:
    """0.2 number of columns + 0.3 type counts + 0.3 schema patterns + 0.2 keywords; types: maps of counts."""
    count = lambda m, t: F.coalesce(F.element_at(m, t), F.lit(0))
    names = F.array_union(F.map_keys(types1), F.map_keys(types2))
    each = F.transform(names, lambda t: 1 - F.abs(count(types1, t) - count(types2, t)) / F.greatest(count(types1, t) + count(types2, t), F.lit(1)))
    types = F.when(F.size(names) == 0, F.lit(1.0)).otherwise(F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(names))
    parts = lambda p: F.array_distinct(F.split(p, r"\|"))
    patterns = F.when((pattern1 == "") & (pattern2 == ""), F.lit(1.0)).when((pattern1 == "") | (pattern2 == ""), F.lit(0.0)).otherwise(jaccard(parts(pattern1), parts(pattern2)))
    return 0.2 * (1 - F.abs(n1 - n2) / F.greatest(n1, n2)) + 0.3 * types + 0.3 * patterns + 0.2 * jaccard(words1, words2)


def lower_names(columns: Column) -> Column:
    return F.array_distinct(F.transform(columns, lambda c: F.lower(c["column_name"])))


def column_overlap(a: Column, b: Column) -> Column:
    return jaccard(lower_names(a), lower_names(b), 0.0)


def identical_structure(a: Column, b: Column) -> Column:
    """Whether the sorted (name, matcher type) lists are equal."""
    shape = lambda xs: F.array_sort(F.transform(xs, lambda c: F.struct(F.lower(c["column_name"]).alias("n"), N.matcher_type(c["data_type"]).alias("t"))))
    return (F.size(a) == F.size(b)) & (shape(a) == shape(b))


def key_match(a: Column, b: Column) -> Column:
    """Key columns of a that have one of b of like name, over the larger number of key columns; 0 without any."""
    k1, k2 = X.matcher_keys(a), X.matcher_keys(b)
    hits = F.size(F.filter(k1, lambda x: F.exists(k2, lambda y: (F.lower(x) == F.lower(y)) | (stripped(x) == stripped(y)))))
    return F.when((F.size(k1) == 0) | (F.size(k2) == 0), F.lit(0.0)).otherwise(hits / F.greatest(F.size(k1), F.size(k2)))


def special_pattern(table1: Column, table2: Column, a: Column, b: Column) -> Column:
    """Both dimension tables with an overlap above 0.6, or both fact tables with like shares of foreign keys."""
    dims = X.is_dimension(table1) & X.is_dimension(table2)
    facts = X.is_fact(table1) & X.is_fact(table2)
    return F.when(dims, column_overlap(a, b) > 0.6).when(facts, F.abs(X.foreign_key_ratio(a) - X.foreign_key_ratio(b)) < 0.2).otherwise(F.lit(False))


# Vectors: arrays of doubles

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    v = F.transform(v, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length == 0, v).otherwise(F.transform(v, lambda x: x / length))


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x))


def by_distance(a: Column, b: Column) -> Column:
    return 1 / (1 + distance(a, b))


def hybrid_vector(a: Column, b: Column, same_type: Column, same_name: Column) -> Column:
    """0.4 cosine + 0.2 by distance + 0.2 (0.6 same type + 0.4 same name)."""
    return 0.4 * cosine(a, b) + 0.2 * by_distance(a, b) + 0.2 * (0.6 * same_type.cast("double") + 0.4 * same_name.cast("double"))
