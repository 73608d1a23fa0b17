"""DuckDB SQL of the registered queries, put together from the catalog's parts."""

from __future__ import annotations

from lakefinder.functions import features as X, normalize as N
from lakefinder.operators import lsh
from lakefinder.plans import routing
from lakefinder.plans.queries import QUESTIONS

#: The tables' columns with their catalog types.
SCHEMA = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey int, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey int, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey int, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey int, o_custkey int, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id int, ts timestamp, user_id int, event_type string, value double, props string",
    "documents": "doc_id int, text string, lang string, source string, n_chars int",
    "embeddings": "vec_id int, embedding array, label int",
    "pages": "page_id int, url string, html string",
    "benchmark": "item_id int, text string",
    "labels": "doc_id int, quality int, toxic int",
    "conversations": "conv_id int, turn int, role string, text string",
}
COLUMNS = [(t, i, *c.split()) for t, cs in SCHEMA.items() for i, c in enumerate(cs.split(", "))]
INDEXED = [(t, c) for t, _, c, k in COLUMNS if k in ("int", "string")]
SPACE = r"[ \t\n\x0B\f\r]+"


def norm(x: str) -> str:
    trimmed = f"regexp_replace(CAST({x} AS VARCHAR), '^{SPACE}|{SPACE}$', '', 'g')"
    return f"regexp_replace(lower({trimmed}), '{SPACE}', ' ', 'g')"


def _column(t: str, i: int, c: str, k: str) -> str:
    own = k in ("int", "string")
    unique = f"count(DISTINCT {c})" if own else "CAST(NULL AS BIGINT)"
    samples = f"coalesce(list_slice(list_sort(list(DISTINCT CAST({c} AS VARCHAR)) FILTER ({c} IS NOT NULL)), 1, 5), [])" if own else "CAST([] AS VARCHAR[])"
    return f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS ordinal, '{k}' AS data_type, count(*) - count({c}) AS null_count, count(*) AS row_count, {unique} AS unique_count, {samples} AS sample_values FROM {t}"


LAKE = "lc AS MATERIALIZED (" + " UNION ALL ".join(_column(*c) for c in COLUMNS) + ")"
VALUES = "lv AS MATERIALIZED (SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {norm(c)} AS value FROM {t}" for t, c in INDEXED) + ") WHERE length(value) >= 2)"
TABLES = "lt AS MATERIALIZED (SELECT table_name, max(row_count) AS row_count, count(*) AS column_count, list(column_name ORDER BY ordinal) AS names, list(data_type ORDER BY ordinal) AS types FROM lc GROUP BY 1)"


def has(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def classify(x: str, classes: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(x, ws)} THEN '{n}'" for n, ws in classes.items()) + f" ELSE {default} END"


def steps(x: str, bounds, names) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {b} THEN {n!r}" for b, n in zip(bounds, names[:-1], strict=True)) + f" ELSE {names[-1]!r} END"


def jac(a: str, b: str, empty: str = "1.0") -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN {union} = 0 THEN {empty} ELSE len(list_intersect({a}, {b}))::DOUBLE / {union} END)"


def tokens(x: str, least: int) -> str:
    """Parts of a lower-case name: there the splitting pattern is that of letters or digits."""
    return f"list_distinct(list_filter(regexp_extract_all({x}, '[a-z]+|[0-9]+'), lambda t: length(t) > {least}))"


STOP = "[" + ", ".join(f"'{w}'" for w in N.KEYWORD_STOP) + "]"


def keywords(x: str) -> str:
    return f"list_filter({tokens(x, 2)}, lambda k: NOT list_contains({STOP}, k))"


def names_like(pattern: str) -> str:
    return f"list_filter(names, lambda c: regexp_matches(lower(c), '{pattern}'))"


def ktype(t: str) -> str:
    return f"len(list_filter(types, lambda k: {classify('k', N.METADATA_TYPES, chr(39) + 'other' + chr(39))} = '{t}'))"


def qtype(x: str) -> str:
    return classify(x, N.QUERY_TYPES, "'other'")


FEATURES = f"""lf AS MATERIALIZED (SELECT table_name, row_count, column_count, names, types,
    {classify('lower(table_name)', X.DOMAINS, "'general'")} AS domain,
    {steps('column_count', (5, 20), (0, 1, 2))} AS size_category,
    {steps('column_count', (5, 10, 20, 50), (5, 10, 20, 50, 100))} AS column_bucket,
    {steps('column_count', (5, 15, 30), ('small', 'medium', 'large', 'xlarge'))} AS column_range,
    {steps('row_count', (1000, 10000, 100000, 1000000), ('tiny', 'small', 'medium', 'large', 'huge'))} AS row_range,
    CASE WHEN contains(table_name, '_') THEN split_part(table_name, '_', 1) || '_*_' || list_extract(string_split(table_name, '_'), -1)
         WHEN regexp_matches(substr(table_name, 2), '[A-Z]') THEN regexp_replace(table_name, '[A-Z]', '*', 'g') ELSE 'simple' END AS naming_pattern,
    [{', '.join(ktype(t) for t in X.TYPE_ORDER)}] AS type_counts,
    {names_like(X.KEYS)} AS key_columns, {names_like(X.MATCHER_KEYS)} AS matcher_keys, {names_like(X.IDENTIFIERS)} AS identifier_columns,
    regexp_matches(lower(table_name), '{X.DIMENSION}') AS is_dimension, regexp_matches(lower(table_name), '{X.FACT}') AS is_fact,
    len({names_like('(_id|_key)$')})::DOUBLE / column_count AS foreign_key_ratio,
    array_to_string(list_transform(list_sort(list_transform(names, lambda c: lower(c))), lambda c: {classify('c', X.SCHEMA_PARTS, "'OTHER'")}), '|') AS schema_pattern,
    list_sort(list_distinct(list_concat({keywords('table_name')}, flatten(list_transform(names, lambda c: {keywords('c')}))))) AS domain_keywords,
    list_transform(types, lambda k: {classify('k', N.SIGNATURE_TYPES, "'other'")}) AS sig_types,
    'cols:' || column_count || '|types:' || array_to_string(list_sort(list_distinct(list_transform(types, lambda k: {qtype('k')}))), ',') || '|ids:' || len({names_like(X.IDENTIFIERS)}) AS table_signature
    FROM lt)"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


CAT = (LAKE, TABLES, FEATURES)

#: Metadata similarity of every two tables; 1 with itself.
META = """ms AS MATERIALIZED (SELECT q.table_name AS query_table, t.table_name,
    CASE WHEN q.table_name = t.table_name THEN 1.0 ELSE
      0.3 * (q.domain = t.domain)::INT + 0.2 * (1 - abs(q.size_category - t.size_category) / 3.0)
      + 0.2 * (1 - abs(q.column_count - t.column_count)::DOUBLE / greatest(q.column_count, t.column_count))
      + 0.2 * list_dot_product(q.type_counts::DOUBLE[], t.type_counts::DOUBLE[]) / (sqrt(list_dot_product(q.type_counts::DOUBLE[], q.type_counts::DOUBLE[])) * sqrt(list_dot_product(t.type_counts::DOUBLE[], t.type_counts::DOUBLE[])))
      + 0.1 * CASE WHEN len(q.key_columns) > 0 AND len(t.key_columns) > 0 THEN """ + jac("q.key_columns", "t.key_columns") + """ ELSE 0.0 END END AS raw,
    round(raw, 9) AS score FROM lf q, lf t)"""


def chars(x: str) -> str:
    return f"list_distinct(list_filter(string_split(lower({x}), ''), lambda z: z <> ''))"


def char_jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN lower({a}) = lower({b}) THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE {jac(chars(a), chars(b))} END)"


def stripped(x: str) -> str:
    out = f"lower({x})"
    for p in ("^fk_", "^pk_", "^idx_", "_id$", "_key$", "_code$", "_no$"):
        out = f"regexp_replace({out}, '{p}', '')"
    return out


NAMES = "nm AS (SELECT DISTINCT column_name FROM lc), np AS (SELECT x.column_name AS a, y.column_name AS b FROM nm x, nm y WHERE x.column_name < y.column_name)"
PAIRS = """cp AS MATERIALIZED (SELECT q.table_name AS query_table, q.column_name AS query_column, q.data_type AS qt, q.sample_values AS qs, q.null_count AS qn, q.unique_count AS qu,
    t.table_name, t.column_name, t.data_type AS tt, t.sample_values AS ts, t.null_count AS tn, t.unique_count AS tu
    FROM lc q, lc t WHERE q.table_name <> t.table_name AND q.ordinal < 20 AND t.ordinal < 20)"""
BY_NAMES = f"bn AS MATERIALIZED (SELECT query_table, query_column, table_name, column_name, round(0.7 * {char_jaccard('query_column', 'column_name')} + 0.3 * CASE WHEN qt = tt THEN 1.0 ELSE 0.3 END, 9) AS score FROM cp)"
GROUP = classify("k", dict(reversed(N.GROUP_TYPES.items())), "NULL")


def group(x: str) -> str:
    return GROUP.replace("contains(k,", f"contains({x},")


OVERLAP = """qv AS (SELECT table_name AS query_table, column_name AS query_column, value FROM lv),
    nq AS MATERIALIZED (SELECT query_table, query_column, count(*) AS n FROM qv GROUP BY ALL), nt AS MATERIALIZED (SELECT table_name, column_name, count(*) AS n FROM lv GROUP BY ALL),
    ov AS MATERIALIZED (SELECT h.*, h.n_hit::DOUBLE / nq.n AS overlap, h.n_hit::DOUBLE / nt.n AS target, 0.7 * (h.n_hit::DOUBLE / nq.n) + 0.3 * (h.n_hit::DOUBLE / nt.n) AS score
      FROM (SELECT query_table, query_column, table_name, column_name, count(*) AS n_hit FROM qv JOIN lv USING (value) WHERE query_table <> table_name GROUP BY ALL) h
      JOIN nq USING (query_table, query_column) JOIN nt USING (table_name, column_name) WHERE h.n_hit::DOUBLE / nq.n >= 0.35)"""
MERGED = """mg AS MATERIALIZED (SELECT query_table, query_column, table_name, column_name,
    CASE WHEN s.score IS NOT NULL AND v.score IS NOT NULL THEN least(0.6 * s.score + 0.4 * v.score, 1.0) ELSE coalesce(s.score, v.score) END AS confidence,
    CASE WHEN v.score IS NULL THEN 'semantic' WHEN s.score IS NULL THEN 'value_overlap' ELSE 'semantic+value' END AS match_type
    FROM (SELECT * FROM bn WHERE score > 0.65) s FULL JOIN ov v USING (query_table, query_column, table_name, column_name))"""

VEC = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), "
COS = VEC + "p AS (SELECT q.id AS query_id, t.id, round(list_cosine_similarity(q.v, t.v), 9) AS score, q.label = t.label AS same, t.label FROM e q, e t WHERE q.id % 20 = 0 AND q.id <> t.id), "


def top(rows: str, k: int) -> str:
    return f"r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {rows} QUALIFY rank <= {k})"


WORDS = "[" + ", ".join(f"'{w}'" for w in N.QUERY_STOP) + "]"


def _questions() -> str:
    return ", ".join("({}, '{}', {}, {})".format(*q) for q in QUESTIONS)


def _hits(classes: dict) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN list_has_any(w, {list(ws)!r}) THEN '{n}' END" for n, ws in classes.items()) + "], lambda x: x IS NOT NULL)"


_INTENTS = {n: f"len(list_intersect(w, {list(ws)!r}))" for n, ws in routing.INTENTS.items()}
_BEST = "greatest(" + ", ".join(_INTENTS.values()) + ")"
_INTENT = f"CASE WHEN {_BEST} = 0 THEN 'search' " + " ".join(f"WHEN {e} = {_BEST} THEN '{n}'" for n, e in _INTENTS.items()) + " END"

_COEF = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(lsh.coefficients(64)))
_WORD = "list_transform(list_filter(string_split(replace(lower(column_name), '_', ' '), ' '), lambda x: x <> ''), lambda x: 'word:' || x)"
_NUMBER = f"regexp_replace(v, '^{SPACE}|{SPACE}$', '', 'g')"
FEATS = f"""ft AS MATERIALIZED (SELECT table_name || '.' || column_name AS id, list_distinct(list_concat(['name:' || lower(column_name)], {_WORD}, ['type:' || lower(data_type)],
    list_transform(sample_values, lambda v: 'value:' || lower(v)), list_transform(sample_values, lambda v: CASE WHEN try_cast({_NUMBER} AS DOUBLE) IS NOT NULL THEN 'value_type:numeric' ELSE 'value_type:text' END))) AS features FROM lc),
    hs AS MATERIALIZED (SELECT id, x, (8 * ('0x' || substr(md5(x), 1, 8))::BIGINT + 4 * ('0x' || substr(md5(x), 9, 8))::BIGINT + 2 * ('0x' || substr(md5(x), 17, 8))::BIGINT + ('0x' || substr(md5(x), 25, 8))::BIGINT) % {lsh.PRIME} AS h FROM (SELECT id, unnest(features) AS x FROM ft)),
    sg AS MATERIALIZED (SELECT id, place, min((a * h + b) % {lsh.PRIME}) AS x FROM hs, (VALUES {_COEF}) c(place, a, b) GROUP BY ALL)"""

_NUMERIC = [(t, c) for t, _, c, k in COLUMNS if k in ("int", "double")]
PROFILES = "nx AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c}::DOUBLE AS x FROM {t} WHERE {c} IS NOT NULL" for t, c in _NUMERIC) + """),
    pf AS MATERIALIZED (SELECT table_name, column_name, count(*) AS n, avg(x) AS m, sum(x) AS s1, sum(x * x) AS s2, stddev_pop(x) AS sd, quantile_cont(x, [0.25, 0.5, 0.75]) AS q, max(x) - min(x) AS r FROM nx GROUP BY ALL)"""


def diff(a: str, b: str, *scale: str) -> str:
    return f"(1 - least(abs({a} - {b}) / greatest({', '.join(scale)}, 1.0), 1.0))"


_SALL = "sqrt(greatest((p.s2 + t.s2) / (p.n + t.n) - ((p.s1 + t.s1) / (p.n + t.n)) * ((p.s1 + t.s1) / (p.n + t.n)), 0))"
_QUART = " + ".join(diff(f"p.q[{k}]", f"t.q[{k}]", "p.r", "t.r", f"abs(p.q[{k}])", f"abs(t.q[{k}])") for k in (1, 2, 3))
_CATEGORY = f"list_filter(list_transform({{0}}, lambda v: lower(regexp_replace(v, '^{SPACE}|{SPACE}$', '', 'g'))), lambda v: v <> '')"
_QC, _TC = _CATEGORY.format("qs"), _CATEGORY.format("ts")


def count_of(xs: str) -> str:
    return f"len(list_filter({xs}, lambda z: z = u))"


SQL = {
    "value_overlap": with_(VALUES, OVERLAP) + "SELECT query_table, query_column, table_name, column_name, n_hit, round(overlap, 9) AS overlap, round(target, 9) AS target, round(score, 9) AS score FROM ov WHERE query_table = 'orders'",
    "joinable": with_(VALUES, OVERLAP) + "SELECT table_name, column_name, n_hit, round(overlap, 9) AS overlap, round(target, 9) AS target, round(score, 9) AS score, row_number() OVER (ORDER BY ov.score DESC, table_name, column_name) AS rank FROM ov WHERE query_table = 'orders' AND query_column = 'o_custkey' QUALIFY rank <= 10",
    "pattern_search": with_(VALUES)
    + """, h AS (SELECT table_name, column_name, count(*) AS n_values, count(*) FILTER (regexp_matches(value, '(?i)(promo|steel|ship)')) AS n_hit, list_slice(list_sort(list(value) FILTER (regexp_matches(value, '(?i)(promo|steel|ship)'))), 1, 10) AS m FROM lv GROUP BY ALL)
    SELECT table_name, column_name, n_values, n_hit, round(n_hit / n_values, 9) AS score, array_to_string(m, '|') AS matched_values FROM h WHERE n_hit > 0 ORDER BY n_hit / n_values DESC, table_name, column_name LIMIT 10""",
    "index_statistics": with_(VALUES) + "SELECT (SELECT count(*) FROM (SELECT DISTINCT table_name, column_name FROM lv)) AS n_columns, (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM lv GROUP BY table_name, column_name)) AS values_per_column, (SELECT count(DISTINCT value) FROM lv) AS n_values",
    "posting_histogram": with_(VALUES) + "SELECT n_columns, count(*) AS n_values FROM (SELECT value, count(*) AS n_columns FROM lv GROUP BY 1) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "catalog": with_(LAKE) + "SELECT * REPLACE (array_to_string(sample_values, '|') AS sample_values, coalesce(unique_count, -1) AS unique_count) FROM lc",
    "index_check": with_(LAKE, VALUES) + "SELECT (SELECT count(DISTINCT table_name) FROM lc) AS n_tables, (SELECT count(*) FROM lc) AS n_listed, (SELECT count(*) FROM lc) AS n_columns, (SELECT count(*) FROM lv) AS n_values, (SELECT count(*) FROM (SELECT DISTINCT table_name, column_name FROM lv)) AS n_indexed, true AS complete",
    "table_features": with_(*CAT)
    + "SELECT table_name, row_count, column_count, domain, size_category, column_bucket, column_range, row_range, naming_pattern, array_to_string(type_counts, '|') AS type_counts, "
    + "array_to_string(list_filter([" + ", ".join(f"CASE WHEN type_counts[{i + 1}] > 0 THEN '{t}:' || type_counts[{i + 1}] END" for i, t in enumerate(X.TYPE_ORDER)) + "], lambda x: x IS NOT NULL), '|') AS type_signature, "
    + ", ".join(f"array_to_string({c}, '|') AS {c}" for c in ("key_columns", "matcher_keys", "identifier_columns", "domain_keywords"))
    + ", is_dimension, is_fact, round(foreign_key_ratio, 9) AS foreign_key_ratio, schema_pattern, table_signature FROM lf",
    "schema_summary": with_(LAKE) + f"SELECT table_name, {classify('lower(column_name)', X.SEMANTIC_GROUPS, chr(39) + 'general' + chr(39))} AS semantic_group, string_agg(column_name, '|' ORDER BY ordinal) AS columns FROM lc GROUP BY 1, 2",
    "column_features": with_(LAKE)
    + f""", n AS (SELECT *, list_filter(list_transform(sample_values, lambda v: try_cast({_NUMBER} AS DOUBLE)), lambda v: v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)) AS nums FROM lc),
    i AS (SELECT *, coalesce({classify('lower(column_name)', X.NAMED_TYPES, 'NULL')}, CASE WHEN len(sample_values) > 0 AND len(nums) >= 0.8 * len(sample_values) THEN 'numeric' END, 'text') AS inferred_type FROM n)
    SELECT table_name, column_name, {classify('data_type', N.METADATA_TYPES, "'other'")} AS metadata_type, {classify('data_type', N.MATCHER_TYPES, "'other'")} AS matcher_type,
      {classify('data_type', N.SIGNATURE_TYPES, "'other'")} AS signature_type, {qtype('data_type')} AS query_type, {group('data_type')} AS type_group,
      {has('data_type', ('int', 'integer', 'float', 'double', 'decimal', 'number', 'numeric'))} OR (len(sample_values) > 0 AND len(nums) >= 0.8 * len(sample_values)) AS is_numeric, inferred_type,
      {classify('lower(column_name)', X.SEMANTIC_GROUPS, "'general'")} AS semantic_group, array_to_string({_CATEGORY.format('sample_values')}, '|') AS categories, len(nums) AS n_numbers,
      'Table: ' || table_name || ' | Column: ' || column_name || ' | Type: ' || data_type || CASE WHEN array_to_string(list_slice(sample_values, 1, 3), ', ') <> '' THEN ' | Samples: ' || array_to_string(list_slice(sample_values, 1, 3), ', ') ELSE '' END AS text FROM i""",
    "table_texts": with_(LAKE) + "SELECT table_name, 'Table: ' || table_name || ' | Columns: ' || string_agg(column_name || ' (' || data_type || ')', ', ' ORDER BY ordinal) FILTER (ordinal < 20) AS text, table_name || ' ' || string_agg(column_name, ' ' ORDER BY ordinal) AS names FROM lc GROUP BY table_name",
    "metadata_search": with_(*CAT, META) + "SELECT query_table, table_name, score, row_number() OVER (PARTITION BY query_table ORDER BY score DESC, table_name) AS rank FROM ms WHERE raw > 0 QUALIFY rank <= 5",
    "best_of_queries": with_(*CAT, META) + "SELECT table_name, max(score) AS score FROM (SELECT * FROM ms WHERE query_table IN ('orders', 'customer') AND score > 0.5 QUALIFY row_number() OVER (PARTITION BY query_table ORDER BY score DESC, table_name) <= 10) GROUP BY 1",
    "relaxed_filter": with_(*CAT, META)
    + """, a AS (SELECT query_table, table_name, score, row_number() OVER (PARTITION BY query_table ORDER BY score DESC, table_name) AS pos, count(*) FILTER (score > 0.6) OVER (PARTITION BY query_table) AS h FROM ms WHERE query_table <> table_name AND score > 0),
    k AS (SELECT *, CASE WHEN score > 0.6 AND pos <= 6 THEN 0 WHEN score <= 0.6 AND score > 0.3 AND pos <= greatest(h, 3) THEN 1 WHEN pos <= 9 THEN 2 END AS kind FROM a)
    SELECT query_table, table_name, round(CASE kind WHEN 0 THEN score WHEN 1 THEN score * 0.8 ELSE score * 0.6 END, 9) AS score, kind FROM k WHERE kind IS NOT NULL""",
    "signature_search": with_(*CAT)
    + """, g AS (SELECT q.table_name AS query_table, t.table_name, list_distinct(list_concat(q.sig_types, t.sig_types)) AS ks, q.*, t.column_count AS tc, t.sig_types AS tt, t.schema_pattern AS tp, t.domain_keywords AS tw FROM lf q, lf t WHERE q.table_name <> t.table_name)
    SELECT query_table, table_name, round(0.2 * (1 - abs(column_count - tc)::DOUBLE / greatest(column_count, tc))
      + 0.3 * list_sum(list_transform(ks, lambda u: 1 - abs(""" + count_of("sig_types") + " - " + count_of("tt") + ")::DOUBLE / greatest(" + count_of("sig_types") + " + " + count_of("tt") + ", 1))) / len(ks) + 0.3 * "
    + jac("list_distinct(string_split(schema_pattern, '|'))", "list_distinct(string_split(tp, '|'))") + " + 0.2 * " + jac("domain_keywords", "tw") + ", 6) AS score FROM g",
    "prefilter": with_(*CAT)
    + """, t AS (SELECT table_name, list_has_any(domain_keywords, ['custkey', 'orderkey']) AS a, column_range IN ('small', 'medium', 'large') AS b FROM lf),
    b AS (SELECT * FROM t WHERE a AND b) SELECT table_name FROM t WHERE CASE WHEN (SELECT count(*) FROM b) >= 2 THEN a AND b ELSE a OR b END ORDER BY 1 LIMIT 20""",
    "shared_letters": with_(*CAT) + f"SELECT q.table_name AS query_table, t.table_name FROM lf q, lf t WHERE q.table_name <> t.table_name AND ((q.domain IN ('user', 'order', 'product') AND q.domain = t.domain) OR len(list_intersect({chars('q.table_name')}, {chars('t.table_name')})) >= least(3.0, 0.3 * length(q.table_name)))",
    "name_similarity": with_(LAKE, NAMES) + f"SELECT a, b, round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 9) AS levenshtein, round({jac(tokens('a', 1), tokens('b', 1))}, 9) AS tokens, round({char_jaccard('a', 'b')}, 9) AS characters, {stripped('a')} = {stripped('b')} AS alike FROM np",
    "table_rules": with_(*CAT)
    + f""", d AS (SELECT q.table_name AS query_table, t.table_name, q.names AS a, t.names AS b, q.types AS ta, t.types AS tb, q.matcher_keys AS ka, t.matcher_keys AS kb, q.is_dimension AS da, t.is_dimension AS db, q.is_fact AS fa, t.is_fact AS fb, q.foreign_key_ratio AS ra, t.foreign_key_ratio AS rb,
      len(list_filter(generate_series(1, least(length(q.table_name), length(t.table_name))), lambda k: left(q.table_name, k::BIGINT) = left(t.table_name, k::BIGINT))) AS pre FROM lf q, lf t WHERE q.table_name <> t.table_name),
    o AS (SELECT *, {jac('a', 'b', '0.0')} AS ov FROM d)
    SELECT query_table, table_name, round(CASE WHEN contains(query_table, table_name) OR contains(table_name, query_table) THEN 0.8 WHEN pre > 0 THEN 0.5 * pre / greatest(length(query_table), length(table_name)) ELSE 0.1 END, 9) AS name, round(ov, 9) AS overlap,
      len(a) = len(b) AND list_sort(list_transform(list_zip(a, ta), lambda z: z[1] || ':' || {classify('z[2]', N.MATCHER_TYPES, "'other'")})) = list_sort(list_transform(list_zip(b, tb), lambda z: z[1] || ':' || {classify('z[2]', N.MATCHER_TYPES, "'other'")})) AS identical,
      round(CASE WHEN len(ka) = 0 OR len(kb) = 0 THEN 0.0 ELSE len(list_filter(ka, lambda x: list_contains(kb, x) OR list_contains(list_transform(kb, lambda y: {stripped('y')}), {stripped('x')})))::DOUBLE / greatest(len(ka), len(kb)) END, 9) AS keys,
      CASE WHEN da AND db THEN ov > 0.6 WHEN fa AND fb THEN abs(ra - rb) < 0.2 ELSE false END AS pattern FROM o""",
    "pair_similarity": with_(LAKE, PAIRS)
    + f""", g AS (SELECT *, {group('qt')} AS g1, {group('tt')} AS g2, {_QC} AS qc, {_TC} AS tc FROM cp WHERE query_table < table_name)
    SELECT query_table, query_column, table_name, column_name,
      CASE WHEN qt = tt THEN 1.0 WHEN g1 IS NULL OR g2 IS NULL THEN 0.1 WHEN g1 = g2 THEN 0.8 WHEN g1 IN ('integer', 'float') AND g2 IN ('integer', 'float') THEN 0.6 ELSE 0.2 END AS type_sim,
      round(CASE WHEN len(list_distinct(qc)) = 0 OR len(list_distinct(tc)) = 0 THEN 0.0 ELSE 0.8 * {jac('qc', 'tc')} + 0.2 * least(len(qs), len(ts))::DOUBLE / greatest(len(qs), len(ts), 1) END, 9) AS value_sim,
      round((coalesce(CASE WHEN qu IS NOT NULL AND tu IS NOT NULL AND greatest(qu, tu) > 0 THEN least(qu, tu)::DOUBLE / greatest(qu, tu) END, 0) + (1 - abs(qn - tn)::DOUBLE / greatest(qn + tn, 1))) / (1 + (qu IS NOT NULL AND tu IS NOT NULL AND greatest(qu, tu) > 0)::INT), 9) AS stats_sim,
      round((CASE WHEN qt = tt THEN 1.0 WHEN (contains(qt, 'int') AND contains(tt, 'int')) OR (contains(qt, 'str') AND contains(tt, 'str')) THEN 0.8 ELSE 0.0 END + greatest(0.0, 1 - abs(qn - tn) / 100.0)) / 2, 9) AS structure_sim,
      round({jac('qc', 'tc', '0.0')}, 9) AS category_jaccard,
      round(CASE WHEN len(qc) = 0 OR len(tc) = 0 THEN 0.0 ELSE coalesce(list_sum(list_transform(list_distinct(list_concat(qc, tc)), lambda u: ({count_of('qc')} * {count_of('tc')})::DOUBLE)), 0) / (sqrt(list_sum(list_transform(list_distinct(qc), lambda u: pow({count_of('qc')}, 2)))) * sqrt(list_sum(list_transform(list_distinct(tc), lambda u: pow({count_of('tc')}, 2))))) END, 6) AS category_cosine FROM g""",
    "fast_pairs": with_(LAKE, PAIRS) + f"SELECT * FROM (SELECT query_table, query_column, table_name, column_name, round(0.5 * {char_jaccard('query_column', 'column_name')} + 0.3 * CASE WHEN qt = tt THEN 1.0 ELSE 0.3 END + 0.2 * {jac('qs', 'ts', '0.0')}, 9) AS score FROM cp) WHERE score > 0.5",
    "name_pairs": with_(LAKE, PAIRS, BY_NAMES) + "SELECT * FROM bn WHERE score > 0.5",
    "numeric_similarity": with_(PROFILES) + f"SELECT * FROM (SELECT p.table_name AS query_table, p.column_name AS query_column, t.table_name, t.column_name, round(0.4 * {diff('p.m', 't.m', _SALL, 'abs(p.m)', 'abs(t.m)')} + 0.3 * {diff('p.sd', 't.sd', 'p.sd', 't.sd')} + 0.3 * ({_QUART}) / 3, 6) AS score FROM pf p, pf t WHERE p.table_name < t.table_name) WHERE score > 0.2",
    "nearest": "WITH " + COS + top("p", 10) + " SELECT query_id, round(score, 6) AS score, count(*) AS n FROM r GROUP BY 1, 2",
    "nearest_ids": "WITH " + COS + top("p", 10) + " SELECT query_id, id, rank FROM r",
    "nearest_euclidean": "WITH " + VEC + "p AS (SELECT q.id AS query_id, t.id, round(1 / (1 + list_distance(q.v, t.v)), 9) AS score FROM e q, e t WHERE q.id % 20 = 0 AND q.id <> t.id), " + top("p", 5) + " SELECT query_id, id, rank FROM r",
    "nearest_filtered": "WITH " + COS + top("(SELECT * FROM p WHERE label IN (1, 3, 5) AND score >= 0.1)", 5) + " SELECT query_id, id, rank FROM r",
    "nearest_hybrid": "WITH " + VEC + "p AS (SELECT q.id AS query_id, t.id, round(0.4 * list_cosine_similarity(q.v, t.v) + 0.2 / (1 + list_distance(q.v, t.v)) + 0.2 * (0.6 * (q.label = t.label)::INT), 9) AS score FROM e q, e t WHERE q.id % 20 = 0 AND q.id <> t.id), " + top("p", 5) + " SELECT query_id, id, rank FROM r",
    "fused_queries": "WITH " + COS + top("p", 10) + ", f AS (SELECT id, round(0.6 * avg(score) + 0.4 * count(*) / (SELECT count(*) FROM e WHERE id % 20 = 0), 9) AS s FROM r GROUP BY 1) SELECT id, round(s, 6) AS score FROM f ORDER BY s DESC, id LIMIT 10",
    "vector_metrics": "WITH " + COS.replace("t.id, round", "t.id AS tid, CAST(t.id AS VARCHAR) AS id, round")
    + top("p", 10)
    + """, tr AS (SELECT query_id, count(*) FILTER (same) AS nt FROM p GROUP BY 1 HAVING count(*) FILTER (same) > 0),
    h AS (SELECT *, sum(same::INT) OVER (PARTITION BY query_id ORDER BY rank) AS sofar FROM r),
    m AS (SELECT tr.query_id, sum(same::INT) / count(*) AS p, sum(same::INT) / any_value(nt) AS r, coalesce(1.0 / min(rank) FILTER (same), 0) AS mrr, max(same::INT) AS hit, coalesce(sum(sofar / rank) FILTER (same), 0) / least(any_value(nt), 10) AS ap,
      sum(same::INT / log2(rank + 1.0)) / list_sum(list_transform(generate_series(1, least(any_value(nt), 10)), lambda i: 1 / log2(i + 1.0))) AS nd FROM tr JOIN h USING (query_id) GROUP BY 1)
    SELECT count(*) AS n_queries, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1, round(avg(mrr), 6) AS mrr, round(avg(hit), 6) AS hit, round(avg(ap), 6) AS average_precision, round(avg(nd), 6) AS ndcg FROM m""",
    "layer_metrics": "WITH " + COS.replace("t.id, round", "t.id AS tid, CAST(t.id AS VARCHAR) AS id, round")
    + top("p", 20)
    + """, tr AS (SELECT query_id, count(*) FILTER (same) AS nt FROM p GROUP BY 1 HAVING count(*) FILTER (same) > 0), o AS (SELECT query_id, count(*) AS n, sum(same::INT) AS kept FROM r GROUP BY 1)
    SELECT CAST(query_id AS VARCHAR) AS query_table, k, round(1 - any_value(n) / (SELECT count(*) FROM e), 6) AS filter_ratio, round(any_value(kept) / any_value(nt), 6) AS retention, round(sum(same::INT) FILTER (rank <= k) / k, 6) AS precision, round(sum(same::INT) FILTER (rank <= k) / any_value(nt), 6) AS recall, (sum(same::INT) FILTER (rank <= k) > 0)::INT AS hit
    FROM r JOIN tr USING (query_id) JOIN o USING (query_id), (VALUES (1), (3), (5), (10), (20)) c(k) WHERE n >= k GROUP BY query_id, k""",
    "truth_frequency": "WITH "
    + COS.removesuffix(", ")
    + " SELECT CAST(query_id AS VARCHAR) AS query_table, count(*) AS n_matches FROM p WHERE same GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "two_level": "WITH "
    + COS
    + top("p", 30)
    + ", f AS (SELECT * EXCLUDE (rank) FROM r QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) <= 3) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 5",
    "early_stop": with_(*CAT, META)
    + ", a AS (SELECT *, row_number() OVER (PARTITION BY query_table ORDER BY score DESC, table_name) AS pos FROM ms WHERE query_table <> table_name AND score > 0) SELECT query_table, max(score) FILTER (pos = 1) > 0.7 AND coalesce(max(score) FILTER (pos = 2) > 0.6, false) AS stop FROM a GROUP BY 1",
    "digest_vectors": "WITH t(table_name) AS (VALUES " + ", ".join(f"('{t}')" for t in SCHEMA) + "), d AS (SELECT table_name, i, ('0x' || substr(md5(table_name), (i % 32 + 1)::BIGINT, 1))::INT AS h FROM t, generate_series(0, 95) s(i)) "
    "SELECT table_name, (4 * i + j)::INT AS dim, round(CASE j WHEN 0 THEN h / 15.0 - 0.5 ELSE (h * (CASE j WHEN 1 THEN 7 WHEN 2 THEN 13 ELSE 17 END)) % 16 / 15.0 - 0.5 END, 9) AS x FROM d, generate_series(0, 3) g(j)",
    "minhash": with_(LAKE, FEATS) + "SELECT id, place, x FROM sg",
    "lsh_similar": with_(LAKE, FEATS)
    + """, b AS (SELECT x.id, x.place // 2 AS band, x.x AS x1, y.x AS x2 FROM sg x JOIN sg y ON x.id = y.id AND y.place = x.place + 1 WHERE x.place % 2 = 0 AND x.place < 16),
    c AS (SELECT DISTINCT q.id AS query_id, t.id FROM b q JOIN b t ON q.band = t.band AND q.x1 = t.x1 AND q.x2 = t.x2 WHERE q.id <> t.id)
    SELECT * FROM (SELECT query_id, c.id, round(""" + jac("q.features", "t.features") + ", 9) AS score FROM c JOIN ft q ON q.id = query_id JOIN ft t ON t.id = c.id) WHERE score >= 0.3",
    "merged_hits": with_(LAKE, VALUES, PAIRS, BY_NAMES, OVERLAP, MERGED) + "SELECT query_table, query_column, table_name, column_name, round(confidence, 6) AS confidence, match_type FROM mg",
    "table_scores": with_(LAKE, VALUES, TABLES, PAIRS, BY_NAMES, OVERLAP, MERGED)
    + """, g AS (SELECT query_table, table_name, count(*) AS n, avg(confidence) AS c, count(DISTINCT query_column) AS d, least(20.0, 0.2 * count(*) FILTER (regexp_matches(lower(column_name), 'id|key|uuid|guid|primary|pk'))) AS k FROM mg GROUP BY ALL)
    SELECT query_table, g.table_name, n AS n_matches, round(round(c, 9), 3) AS avg_confidence, round(round(d / column_count, 9), 3) AS coverage, round(round(k, 9), 3) AS key_bonus, round(round(least(100.0, 100 * (0.4 * least(n / column_count, 1.0) + 0.4 * c + 0.2 * d / column_count) + k), 6), 3) AS score FROM g JOIN lt ON lt.table_name = query_table""",
    "normalised_sums": with_(LAKE, PAIRS, BY_NAMES) + ", s AS (SELECT query_table, table_name, sum(score) AS t FROM bn WHERE score > 0.65 GROUP BY ALL) SELECT query_table, table_name, round(t / max(t) OVER (PARTITION BY query_table), 6) AS score FROM s",
    "pair_scores": with_(LAKE, TABLES, PAIRS, BY_NAMES)
    + """, g AS (SELECT query_table, table_name, avg(score) AS c, count(DISTINCT query_column) AS a, count(DISTINCT column_name) AS b, count(*) AS n_matches FROM bn WHERE score > 0.3 GROUP BY ALL),
    w AS (SELECT g.*, a / q.column_count AS s, b / t.column_count AS u, least(q.column_count, t.column_count) / greatest(q.column_count, t.column_count) AS r FROM g JOIN lt q ON q.table_name = query_table JOIN lt t ON t.table_name = g.table_name)
    SELECT query_table, table_name, n_matches, round(round(100 * least(0.4 * c + 0.3 * greatest(s, u) + 0.2 * least(s, u) + 0.1 * r, 1.0), 6), 3) AS score FROM w""",
    "best_pairs": with_(LAKE, TABLES, PAIRS, BY_NAMES)
    + """, o AS (SELECT * FROM bn WHERE score > 0.5 QUALIFY row_number() OVER (PARTITION BY query_table, table_name, query_column ORDER BY score DESC, column_name) = 1), g AS (SELECT query_table, table_name, avg(score) AS c, count(*) AS n FROM o GROUP BY ALL)
    SELECT query_table, g.table_name, n AS n_matches, round(round(c * n / column_count * 100, 6), 5) AS score, round(round(c, 9), 5) AS similarity, round(round(n / column_count, 9), 5) AS match_ratio FROM g JOIN lt ON lt.table_name = query_table""",
    "greedy_matching": with_(LAKE, PAIRS, BY_NAMES) + "SELECT * FROM bn WHERE score > 0.5 QUALIFY row_number() OVER (PARTITION BY query_table, table_name, query_column ORDER BY score DESC, column_name) = 1",
    "query_analysis": f"""WITH q(query_id, text, n_tables, n_columns) AS (VALUES {_questions()}), a AS (SELECT *, list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), lambda x: length(x) > 2 AND NOT list_contains({WORDS}, x))) AS w FROM q),
    b AS (SELECT *, {_hits(routing.DOMAINS)} AS dm, {_hits(routing.TYPES)} AS ty, {_INTENT} AS intent FROM a),
    c AS (SELECT *, round(least(least(len(w) * 0.05, 0.3) + len(dm) * 0.1 + CASE WHEN n_tables > 0 THEN least(n_tables * 0.1, 0.4) + least(n_columns * 0.01, 0.3) ELSE 0 END, 1.0)::DOUBLE, 9) AS complexity FROM b)
    SELECT query_id, array_to_string(w, '|') AS words, array_to_string(dm, '|') AS domains, array_to_string(ty, '|') AS types,
      array_to_string(list_filter([CASE WHEN complexity > 0.7 THEN 'use_prefiltering' END, CASE intent WHEN 'join' THEN 'focus_on_identifier_columns' WHEN 'union' THEN 'focus_on_schema_similarity' END, CASE WHEN len(dm) > 1 THEN 'multi_domain_query' END], lambda x: x IS NOT NULL), '|') AS suggestions,
      intent, complexity, complexity > 0.5 AS hierarchical, CASE WHEN complexity < 0.3 THEN 200 WHEN complexity < 0.6 THEN 500 ELSE 1000 END AS max_candidates,
      round(greatest(0.7 - (complexity > 0.7)::INT * 0.1 - (len(dm) > 2)::INT * 0.05, 0.5)::DOUBLE, 9) AS threshold, CASE WHEN complexity > 0.7 THEN 100 WHEN complexity < 0.3 THEN 20 ELSE 50 END AS top_tables, CASE intent WHEN 'join' THEN 30 WHEN 'analysis' THEN 100 ELSE 50 END AS top_columns FROM c""",
    "latencies": "WITH l AS (SELECT event_type, count(*) AS n, avg(value) AS mean, max(value) AS most, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT event_type, n, round(mean, 6) AS mean, v[(floor(n * 0.5) + 1)::BIGINT] AS p50, v[(floor(n * 0.9) + 1)::BIGINT] AS p90, CASE WHEN n < 100 THEN most ELSE v[(floor(n * 0.99) + 1)::BIGINT] END AS p99 FROM l",
    "windowed_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "upsert": "SELECT CASE o_orderstatus WHEN 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM orders GROUP BY 1",
    "verdicts": "",
}
_RULES = SQL["table_rules"]
SQL["verdicts"] = (
    _RULES[: _RULES.rindex("SELECT query_table, table_name, round(CASE WHEN contains")]
    + ", rl AS ("
    + _RULES[_RULES.rindex("SELECT query_table, table_name, round(CASE WHEN contains") :]
    + "), "
    + META
    + """, f AS (SELECT query_table, table_name, score FROM ms WHERE query_table <> table_name AND score > 0 QUALIFY row_number() OVER (PARTITION BY query_table ORDER BY score DESC, table_name) <= 5),
    v AS (SELECT f.*, CASE WHEN score > 0.9 AND overlap > 0.8 THEN 'overlap' WHEN identical THEN 'structure' WHEN keys > 0.8 THEN 'keys' WHEN pattern THEN 'pattern' WHEN score > 0.6 THEN 'uncertain' END AS rule FROM f JOIN rl USING (query_table, table_name))
    SELECT query_table, table_name, round(CASE WHEN rule = 'structure' THEN least(score * 1.2, 1.0) ELSE score END, 9) AS score, rule, CASE WHEN rule = 'uncertain' THEN 'uncertain' ELSE 'rule' END AS method FROM v WHERE rule IS NOT NULL"""
)

SQL["nearest_among"] = "WITH " + COS + top("(SELECT * FROM p WHERE query_id // 50 = id // 50)", 5) + " SELECT query_id, id, rank FROM r"
SQL["relaxed_vectors"] = (
    "WITH "
    + COS
    + top("p", 12)
    + """, a AS (SELECT *, count(*) FILTER (score > 0.25) OVER (PARTITION BY query_id) AS h FROM r),
    k AS (SELECT *, CASE WHEN score > 0.25 AND rank <= 6 THEN 0 WHEN score <= 0.25 AND score > 0.125 AND rank <= greatest(h, 3) THEN 1 WHEN rank <= 10 THEN 2 END AS kind FROM a)
    SELECT query_id AS query_table, id AS table_name, round(CASE kind WHEN 0 THEN score WHEN 1 THEN score * 0.9 ELSE score * 0.7 END, 6) AS score, kind FROM k WHERE kind IS NOT NULL"""
)
_MEANS = SQL["vector_metrics"]
SQL["metric_spread"] = (
    _MEANS[: _MEANS.rindex("SELECT count(*) AS n_queries")]
    + ", u AS (UNPIVOT (SELECT p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1, mrr::DOUBLE AS mrr, hit::DOUBLE AS hit, ap AS average_precision, nd AS ndcg FROM m) ON COLUMNS(*) INTO NAME metric VALUE x) "
    + "SELECT metric, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max FROM u GROUP BY 1"
)
_LAYER = SQL["layer_metrics"]
SQL["layer_means"] = (
    "SELECT layer, k, count(*) AS n_queries, round(avg(filter_ratio), 6) AS filter_ratio, round(avg(retention), 6) AS retention, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS layer, * FROM ({_LAYER.replace('rank <= 20', f'rank <= {k}').replace(', 6)', ', 9)')})" for n, k in (("wide", 20), ("narrow", 5)))
    + ") GROUP BY 1, 2"
)
#: Two minima make a bucket of a band.
BUCKETS = "bk AS MATERIALIZED (SELECT x.id, x.place // 2 AS band, x.x AS x1, y.x AS x2 FROM sg x JOIN sg y ON x.id = y.id AND y.place = x.place + 1 WHERE x.place % 2 = 0)"
SQL["lsh_statistics"] = with_(LAKE, FEATS, BUCKETS) + "SELECT count(*) AS n_buckets, round(avg(n), 6) AS items_per_bucket, max(n) AS largest_bucket FROM (SELECT count(*) AS n FROM bk GROUP BY band, x1, x2)"
SQL["minhash_estimate"] = (
    with_(LAKE, FEATS, BUCKETS)
    + """, c AS (SELECT DISTINCT q.id AS query_id, t.id FROM bk q JOIN bk t USING (band, x1, x2) WHERE q.id < t.id)
    SELECT query_id, c.id, round(count(*) FILTER (q.x = t.x) / 64.0, 9)::DOUBLE AS estimate FROM c JOIN sg q ON q.id = query_id JOIN sg t ON t.id = c.id AND t.place = q.place GROUP BY 1, 2"""
)
SQL["lsh_table_features"] = with_(LAKE) + """SELECT DISTINCT table_name, unnest(list_concat(['table:' || lower(table_name)], list_transform(list_filter(string_split(replace(lower(table_name), '_', ' '), ' '), lambda x: x <> ''), lambda x: 'table_word:' || x),
    list('has_column:' || lower(column_name)), list('has_type:' || lower(data_type)), ['column_count:' || count(*), 'table_size:' || CASE WHEN count(*) <= 5 THEN 'small' WHEN count(*) <= 15 THEN 'medium' ELSE 'large' END])) AS feature FROM lc GROUP BY table_name"""
SQL["text_search"] = (
    with_(LAKE)
    + f""", tp AS (SELECT DISTINCT table_name, column_name, unnest(regexp_split_to_array(lower(concat_ws(' ', table_name, column_name, data_type, array_to_string(list_slice(sample_values, 1, 5), ' '))), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM lc),
    ps AS (SELECT * FROM tp WHERE length(term) > 1), nc AS (SELECT count(*) AS n FROM (SELECT DISTINCT table_name, column_name FROM ps)),
    wt AS (SELECT term, ln(1 + n::DOUBLE / count(*)) AS idf FROM ps, nc WHERE term IN ('orders', 'custkey', 'string', 'doc') GROUP BY term, n),
    sc AS (SELECT table_name, column_name, round(sum(idf), 9) AS w FROM ps JOIN wt USING (term) GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (ORDER BY w DESC, table_name, column_name) AS rank FROM sc)
    SELECT table_name, column_name, round(w, 6) AS weight, rank, round(least(0.9, 1.0::DOUBLE / (1 + rank)), 9) AS score FROM rk WHERE rank <= 10"""
)
SQL["match_types"] = with_(LAKE, VALUES, PAIRS, BY_NAMES, OVERLAP, MERGED) + "SELECT query_table, table_name, match_type, count(*) AS n FROM mg GROUP BY ALL"
SQL["score_statistics"] = "SELECT count(*) AS n_tables, round(avg(score), 3) AS avg_score, round(max(score), 3) AS max_score, round(min(score), 3) AS min_score, round(avg(n_matches), 3) AS avg_matches FROM (" + SQL["table_scores"] + ")"
SQL["explanation"] = f"""SELECT query_table, table_name, count(*) AS n_matched, string_agg(query_column || ' = ' || column_name || ' (' || printf('%.2f', score) || ')', '; ' ORDER BY score DESC, query_column DESC, column_name DESC) FILTER (pos <= 3) AS explanation
    FROM (SELECT *, row_number() OVER (PARTITION BY query_table, table_name ORDER BY score DESC, query_column DESC, column_name DESC) AS pos FROM ({SQL['greedy_matching']})) GROUP BY 1, 2"""
SQL["pseudo_table"] = with_(LAKE) + "SELECT 'query' AS table_name, max(row_count) AS row_count, count(*) AS column_count, string_agg(column_name || ':' || data_type, '|' ORDER BY table_name, ordinal) AS columns FROM lc WHERE column_name LIKE '%key'"
SQL["slow_queries"] = """WITH l AS (SELECT user_id % 10 AS part, count(*) AS n, count(*) FILTER (value > 100) AS n_slow, avg(value) AS mean, max(value) AS most, list_sort(list(value)) AS v, count(*) / sum(value) AS qps,
      1 - avg(coalesce(event_type = 'error', false)::INT) AS ok FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL GROUP BY 1)
    SELECT part, n, n_slow, v[(floor(n * 0.5) + 1)::BIGINT] AS p50, v[(floor(n * 0.9) + 1)::BIGINT] AS p90, CASE WHEN n < 100 THEN most ELSE v[(floor(n * 0.99) + 1)::BIGINT] END AS p99, round(mean, 6) AS mean, round(ok, 6) AS success_rate, round(qps, 6) AS qps FROM l"""
SQL["alerts"] = """WITH s AS (SELECT 1 - avg((event_type = 'error')::INT) AS ok, avg(value) AS mean, avg((event_type = 'view')::INT) AS hits FROM events)
    SELECT unnest(list_filter([CASE WHEN ok < 0.95 THEN 'success rate below 95 %' END, CASE WHEN mean > 10 THEN 'mean time above 10 s' END, CASE WHEN hits < 0.30 THEN 'cache hit rate below 30 %' END], lambda x: x IS NOT NULL)) AS alert FROM s"""
