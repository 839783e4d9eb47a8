"""A training corpus from ``documents``: five stages, each on all that the one before it kept.

``STAGES`` lists name and function; each function takes the session, the
documents so far, stored as files, and the folder of the tables.  All stages
but the last return the columns they were given, whatever others there are beside
those of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import exact_dedup, language_id, mixing, near_dedup, packing
from spanloom.llm.common import written
from spanloom.llm.queries import MIX_KEEP, MIX_TARGETS, domain_labels, tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification doesn't reject.

    Null texts and texts without a letter have no language and go, and so does all
    if no row has a language to learn from.  Long texts are read whole, repeated
    rows share their fate, an empty table stays empty.
    """
    return language_id.known(docs, language_id.fit(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text but for white space: that with most characters, then the least id.

    Null texts count as empty, and of those one stays; of repeated rows one stays;
    null ids come last.  Long texts are hashed whole, an empty table stays empty.
    """
    return exact_dedup.exact_dedup(docs, keep_all=False)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of the least id, null ids last.

    Documents without words are near nothing and stay; of repeated rows one stays.
    Long texts are compared whole, an empty table stays empty.
    """
    return near_dedup.near_dedup(docs, stored=True, keep_only=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of the labelled domains take them, ``mixing.MOST`` times at most.

    A document that is likeliest clean is taken once at least.  Null and empty texts
    have the posterior of texts without evidence, and repeated rows the same rate;
    without labels every document is taken once.  An empty table stays empty.
    """
    labels = domain_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.resampled(docs, labels, MIX_TARGETS, MIX_KEEP, stored=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2,048 tokens.

    Null and empty texts are one end token; longer documents than a sequence are cut
    into pieces; repeated rows are packed each; an empty table gives no piece.
    """
    return packing.best_fit(docs, tokenizer_path(), end_id=0)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the trained classifiers nor the tokenizer; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
