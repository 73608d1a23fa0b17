"""Normalisers of values, names and type names, as Column expressions.

The type normalisers disagree with each other on purpose: each score is defined with its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

SPACE = r"[ \t\n\x0B\f\r]+"
#: Splits identifiers at changes of case and at digits; fixed value.
TOKEN = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\b)|[0-9]+"
#: Fixed lists of words that say nothing.
KEYWORD_STOP = ("id", "name", "type", "data", "info", "table", "column")
QUERY_STOP = ("the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "a", "an")


def value(v: Column) -> Column:
    """A value for the overlap index: trimmed, lower case, single blanks; null if shorter than two characters.

    Most values need no pattern: only those with blanks in a row, or other white space, are rewritten.
    """
    out = F.lower(F.btrim(v.cast("string"), F.lit(" \t\n\x0b\f\r")))
    out = F.when(out.rlike(r"[\t\n\x0B\f\r]|  "), F.regexp_replace(out, SPACE, " ")).otherwise(out)
    return F.when(F.char_length(out) >= 2, out)


def plain_value(v: Column) -> Column:
    """As ``value``, of a number: its text has neither white space nor, but for an exponent, letters."""
    out = F.lower(v.cast("string"))
    return F.when(F.char_length(out) >= 2, out)


def number(v: Column) -> Column:
    """A finite number, or null."""
    out = F.regexp_replace(v.cast("string"), rf"^{SPACE}|{SPACE}$", "").try_cast("double")
    return F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out)


def numbers(xs: Column) -> Column:
    return F.filter(F.transform(xs, number), lambda x: x.isNotNull())


def category(v: Column) -> Column:
    """Trimmed and lower case; null if blank."""
    out = F.lower(F.regexp_replace(v.cast("string"), rf"^{SPACE}|{SPACE}$", ""))
    return F.when(out != "", out)


def categories(xs: Column) -> Column:
    return F.filter(F.transform(xs, category), lambda x: x.isNotNull())


def tokens(name: Column) -> Column:
    """The set of an identifier's parts of two characters or more, lower case."""
    parts = F.regexp_extract_all(name, F.lit(TOKEN), F.lit(0))
    return F.array_distinct(F.transform(F.filter(parts, lambda t: F.char_length(t) > 1), F.lower))


def keywords(name: Column) -> Column:
    parts = F.regexp_extract_all(name, F.lit(TOKEN), F.lit(0))
    long = F.transform(F.filter(parts, lambda t: F.char_length(t) > 2), F.lower)
    return F.array_except(F.array_distinct(long), F.array(*map(F.lit, KEYWORD_STOP)))


def query_words(text: Column) -> Column:
    """The words of a free-text query, of three letters or more, without stop words."""
    parts = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    long = F.filter(parts, lambda t: F.char_length(t) > 2)
    return F.array_except(F.array_distinct(long), F.array(*map(F.lit, QUERY_STOP)))


def has(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is part of the text."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def classify(text: Column, classes: dict[str, tuple[str, ...]], default: str) -> Column:
    """The first class one of whose words is part of the text."""
    out = F.lit(default)
    for name, words in reversed(classes.items()):
        out = F.when(has(text, words), F.lit(name)).otherwise(out)
    return out


#: Words of each type class, in the order in which they are tested.
METADATA_TYPES = {
    "numeric": ("int", "number", "numeric", "decimal", "float", "double"),
    "string": ("string", "text", "varchar", "char"),
    "datetime": ("date", "time", "timestamp"),
    "boolean": ("bool",),
}
MATCHER_TYPES = {"numeric": ("int", "number", "numeric"), "string": ("string", "text", "varchar"), "datetime": ("date", "time")}
SIGNATURE_TYPES = {
    "integer": ("int", "bigint", "smallint"),
    "numeric": ("float", "double", "decimal", "numeric"),
    "text": ("varchar", "char", "text", "string"),
    "temporal": ("date", "timestamp", "datetime"),
    "boolean": ("bool", "boolean"),
}
QUERY_TYPES = {
    "integer": ("int", "bigint", "smallint", "serial"),
    "numeric": ("float", "double", "decimal", "numeric", "real"),
    "text": ("varchar", "char", "text", "string"),
    "temporal": ("date", "timestamp", "datetime", "time"),
    "boolean": ("bool", "boolean"),
}
GROUP_TYPES = {
    "integer": ("int", "integer", "bigint", "smallint", "tinyint"),
    "float": ("float", "double", "decimal", "numeric", "real"),
    "string": ("varchar", "char", "text", "string", "nvarchar"),
    "datetime": ("datetime", "timestamp", "date", "time"),
    "boolean": ("bool", "boolean", "bit"),
}


def outer_type(data_type: Column) -> Column:
    """The type's name without its parameters: ``array<int>`` is an array, not an int."""
    return F.regexp_extract(F.lower(data_type), r"^[^<(]*", 0)


def metadata_type(data_type: Column) -> Column:
    """numeric, string, datetime, boolean or other; null counts as other."""
    return F.coalesce(classify(outer_type(data_type), METADATA_TYPES, "other"), F.lit("other"))


def matcher_type(data_type: Column) -> Column:
    """numeric, string, datetime, other, or unknown for null; double and float are other."""
    return F.when(data_type.isNull(), "unknown").otherwise(classify(outer_type(data_type), MATCHER_TYPES, "other"))


def signature_type(data_type: Column) -> Column:
    """integer, numeric, text, temporal, boolean or other; null stays null."""
    return F.when(data_type.isNotNull(), classify(outer_type(data_type), SIGNATURE_TYPES, "other"))


def query_type(data_type: Column, inferred: Column) -> Column:
    """As ``signature_type`` with more words; for null what was inferred."""
    return F.when(data_type.isNull(), inferred).otherwise(classify(outer_type(data_type), QUERY_TYPES, "other"))


def type_group(data_type: Column) -> Column:
    """The group of a type; of several that fit the last one; null if none fits."""
    return classify(outer_type(data_type), dict(reversed(GROUP_TYPES.items())), None)


def table_name(name: Column) -> Column:
    return F.trim(name)


def with_csv(name: Column) -> Column:
    """The trimmed name with the ending .csv."""
    return F.when(F.trim(name).endswith(".csv"), F.trim(name)).otherwise(F.concat(F.trim(name), F.lit(".csv")))


def bare_name(name: Column) -> Column:
    """The trimmed name without .csv, by which names are compared."""
    return F.regexp_replace(F.trim(name), r"\.csv$", "")


def same_name(a: Column, b: Column) -> Column:
    return bare_name(a) == bare_name(b)
