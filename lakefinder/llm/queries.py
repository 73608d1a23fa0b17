"""The registered queries of this subpackage: opN_<name>(spark, sf_dir), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakefinder.llm.arrow import bound_batches
from lakefinder.llm import bpe, decontaminate, dedup, langid, ngram_jaccard, pii, quality, sharding, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder; bounds Arrow batches in the session."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The key of op3, for tests; whoever runs it on real data passes another one.
PII_KEY = b"lakefinder test key"


def vocabulary() -> str:
    """Where the vocabulary of op7 and op8 lies; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by three-word shingles at 0.9. Null and empty texts link nothing; ids may be null, repeated and of any ordered type; an empty table gives no rows (see ``similar_documents``)."""
    out = ngram_jaccard.similar_documents(table(spark, sf_dir, "documents"), size=3, num=90, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents. Null and empty texts are scored by their lack of words; without labels of both classes all scores are alike; ids are not looked at but for held_out."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with pseudonyms in place of private values. A null text stays null, with 0 values; repeated rows get the same text."""
    out = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", F.coalesce(F.size("private"), F.lit(0)).cast("long").alias("n_private"), "text", "private")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every group of texts that are equal but for white space, the row that stays. Null counts as empty; ties go to the smallest id, a null id last (see ``exact_dedup``)."""
    out = dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.drop("row_no")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items. A null text has no words; an empty benchmark hits nothing; rows that repeat an id are looked at singly."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents. Null and empty texts get the score of no features; without labels of both classes all scores are alike; ids are not looked at but for held_out."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every text and of what they decode to. A null text is an empty one: no ids; repeated rows are encoded singly."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, vocabulary(), digests=True)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of encoded lengths with suffix sums. A null text counts 0 tokens; an empty table gives no rows."""
    lengths = token_counts.token_lengths(table(spark, sf_dir, "documents"), vocabulary())
    return token_counts.length_histogram(lengths)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text. Null texts and those without a letter are ``und`` with score 0; rows without lang teach nothing; without any lang all are ``und``."""
    return langid.classify(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight contiguous shards of near equal bytes. A null text has size 1; null ids come first; ties are cut by size, CRC and input place."""
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 8)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_quality, op3_pii, op4_exact_dedup, op5_decontamination, op6_toxicity, op7_bpe, op8_token_counts, op9_langid, op10_sharding)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE_SQL = {
    "op1_ngram_jaccard": rf"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(generate_series(1, len(w) - 2), lambda k: array_to_string(list_slice(w, k, k + 2), ' ')) END) AS s
            FROM words),
        sizes AS (SELECT doc_id, count(s) AS n FROM words LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
        common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT u, v FROM common JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * i >= 90 * (a.n + b.n - i)),
        reach(doc_id, r) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT v, r FROM reach JOIN links ON u = reach.doc_id)
        SELECT doc_id, any_value(n) AS n_shingles, min(r) AS component_id FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id
    """,
    "op5_decontamination": rf"""
        WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s
            FROM (SELECT item, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM (SELECT *, least(10, len(w)) AS n FROM items) WHERE n > 0)),
        words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
        places AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s
            FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
        hits AS (SELECT doc_id, k, n, item FROM places JOIN windows USING (n, s)),
        hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM hits) GROUP BY 1),
        found AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM hits GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
    "op4_exact_dedup": r"""
        WITH norm AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
            FROM documents),
        ranked AS (
            SELECT doc_id, body,
                   first_value(doc_id) OVER w AS keep_id,
                   count(*) OVER (PARTITION BY body) AS group_size,
                   row_number() OVER w = 1 AS kept
            FROM norm
            WINDOW w AS (PARTITION BY body ORDER BY n_chars DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, kept, sha256(body) AS text_sha256 FROM ranked
    """,
}
