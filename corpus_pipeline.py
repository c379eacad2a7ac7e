"""A corpus pipeline: quality, near duplicates, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtype.llm.common import discard, saved, table
from loomtype.llm.mixing import mix_sources
from loomtype.llm.packing import pack
from loomtype.llm.quality import keep_good
from loomtype.llm.queries import tokenizer_path
from loomtype.llm.shingles import keep_one


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents, or the parts of them in drawn blocks, as often as they were drawn.

    A document that is taken whole keeps its text; of one that is taken in part the words are joined by single spaces.
    """
    return mix_sources(docs, keep_text=True).texts()


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes among the packed sequences."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: The first stage is a learned model, which SQL cannot express; tests hold each stage against a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each on what the one before it kept.

    Null and empty texts go through like others where the classifier keeps them: they have no duplicates, are no part of
    the mixture and so of no sequence. Repeated rows are near duplicates of each other. Empty tables give no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
