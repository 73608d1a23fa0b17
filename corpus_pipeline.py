"""A training-corpus pipeline of five of the operators in ``lakefinder.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``.  All but the last return the columns of
``documents``; each drops the rows it decides against.

Of every stage: an empty table gives an empty table, other columns stay as they are, whatever
their names, and texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakefinder.llm import bpe, decontaminate, dedup, ngram_jaccard, toxicity
from lakefinder.llm.queries import table, vocabulary
from lakefinder.scratch import materialize

#: A document is rejected as toxic from this score on.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC``; the model learns from the labelled ones among them all.

    Null and empty texts have no features and the score of that; rows that repeat a doc_id are scored singly.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity_scores(docs, model, out="__score", keep_text=True)
    return scored.where(F.col("__score") < TOXIC).drop("__score")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space.

    Null counts as empty.  The longest text stays, then the smallest doc_id, a null one last; of rows
    equal in doc_id and text any single one.
    """
    return dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more in shingles of five words.

    Null and empty texts, and rows without a doc_id, stay.  The smallest doc_id stays; rows that repeat
    a doc_id count one by one.
    """
    return ngram_jaccard.one_of_each(docs, size=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs.

    An item of fewer words is one window.  Null and empty texts have no words and stay; an empty
    benchmark drops nothing.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each document that is left; the ids decode by ``bpe.decode_ids``.

    A null or empty text has no ids; repeated rows are encoded singly; other columns are left out.
    """
    return bpe.encode_documents(docs.select("doc_id", "text", "lang", "source"), vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learnt scores, connected components and a vocabulary's merges are beyond SQL; the stages are tested against plain Python.
ORACLE_SQL = None
