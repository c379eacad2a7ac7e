"""Similarity of sequences across genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import letters


def best_offset_mismatches(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Least Hamming distance of the shorter string over all offsets in the longer, plus the difference in length."""
    shorter = F.length(a) <= F.length(b)
    rows = pairs.select(*keys, F.when(shorter, F.col(a)).otherwise(F.col(b)).alias("_s"), F.when(shorter, F.col(b)).otherwise(F.col(a)).alias("_l"))
    extra = F.length("_l") - F.length("_s")
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), extra)))
    cells = F.zip_with(letters(F.col("_s")), letters(F.substring(F.col("_l"), F.col("_o") + 1, F.length("_s"))), lambda x, y: (x != y).cast("int"))
    return rows.withColumn("_d", F.aggregate(cells, F.lit(0), lambda n, x: n + x) + extra).groupBy(*keys).agg(F.min("_d").cast("long").alias("mismatches"))


def cross_locus_similarity(sequences: DataFrame) -> DataFrame:
    """Per exon and pair of genes (locus1 < locus2) the least edit distance between their alleles' sequences.

    The join is on the exon; equal sequences are compared once.
    """
    distinct = sequences.select("exon", "locus", "seq").distinct()
    one = distinct.select("exon", F.col("locus").alias("locus1"), F.col("seq").alias("_a"))
    two = distinct.select("exon", F.col("locus").alias("locus2"), F.col("seq").alias("_b"))
    rows = one.join(two, "exon").where("locus1 < locus2").withColumn("_d", F.levenshtein("_a", "_b"))
    return rows.groupBy("exon", "locus1", "locus2").agg(F.min("_d").alias("nearest"), F.min_by("_a", "_d").alias("seq1"), F.min_by("_b", "_d").alias("seq2"))
