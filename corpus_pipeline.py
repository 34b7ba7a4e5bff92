"""A corpus pipeline of five operators: quality rules, quality classifier, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents; the
last returns the pieces of packed sequences. run() applies them one after the other, each result written to the shared
folder and read again, so that a lost executor costs no more than a part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quantloom.llm import near_dedup, packing, quality_classifier, quality_rules, substring_dedup
from quantloom.llm.common import table, written
from quantloom.llm.queries import vocabulary


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language's distributions, worked out from docs.

    Null and empty texts go (no words); null and repeated ids make no difference, as each row is judged by its text; very
    long texts are taken whole; further columns stay, whatever their names; an empty table stays empty."""
    return quality_rules.keep_good(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade is likely. The model is fitted on rated rows of the whole documents table, so that it
    has seen low grades even where the rules have removed those. Rows are judged by their texts alone: null ids, repeated
    rows, empty and very long texts like any other; further columns stay. Without labels nothing is known of any text: all
    are as likely as the model without weights says."""
    model = quality_classifier.fit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.keep_top(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id. Rows of null ids and texts without words
    stay; of rows with one id and different texts each is judged by its own; repeated rows stay or go together."""
    return near_dedup.drop_near_duplicates(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in a document of a smaller id; n_chars follows the text. Every row stays, if
    need be with an empty text: those of null ids and texts as they are, repeated rows alike."""
    cut = substring_dedup.remove_repeats(docs, counts=None)
    return cut.select(*[F.char_length("text").cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of tokens. A null or empty text is its end id alone; rows of equal or null ids are
    documents of their own; further columns have no part."""
    return packing.pack_documents(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("packing", packing_stage),
]

#: The classifier is fitted, which SQL can't express: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
