"""Likelihoods of alleles and of allele pairs, and the posterior over pairs.

Scores are rows ``read_id, locus, allele_id, llhd, pos``: the log10 likelihood of a read on an allele and its best
column. Sums over reads are grouped sums, so Spark adds partial sums before any shuffle.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of_sample(rows: DataFrame) -> list[str]:
    """The key of samples, where rows are of many."""
    return ["sample"] if "sample" in rows.columns else []


def allele_log_likelihood(scores: DataFrame) -> DataFrame:
    return scores.groupBy(*of_sample(scores), "locus", "allele_id").agg(F.sum("llhd").alias("llhd"), F.count("*").alias("reads"))


def mate_product(scores: DataFrame) -> DataFrame:
    """One row per read and allele from its mates' rows: likelihoods multiplied, positions sorted."""
    return scores.groupBy(*of_sample(scores), "read_id", "locus", "allele_id").agg(
        F.sum("llhd").alias("llhd"), F.array_sort(F.collect_list("pos")).alias("positions"))


def allele_pairs(scores: DataFrame, dx: float = 1e-6, pairs: DataFrame | None = None) -> DataFrame:
    """Per read and pair i <= j: the higher likelihood, its position, and the weights of both sides.

    Likelihoods closer than ``dx`` count as equal and weigh (1, 1), with the first allele's position. The join has
    the read and the gene as equi keys, so it is partitioned by them. With ``pairs`` (locus, i, j) only these are made:
    their first alleles' rows meet them before the second side is joined.
    """
    of = of_sample(scores)
    a = scores.select(*of, "read_id", "locus", F.col("allele_id").alias("i"), F.col("llhd").alias("_a"), F.col("pos").alias("_pa"))
    b = scores.select(*of, "read_id", "locus", F.col("allele_id").alias("j"), F.col("llhd").alias("_b"), F.col("pos").alias("_pb"))
    if pairs is None:
        both = a.join(b, [*of, "read_id", "locus"]).where("i <= j")
    else:
        both = a.join(pairs.select(*of, "locus", "i", "j"), [*of, "locus", "i"]).join(b, [*of, "read_id", "locus", "j"])
    equal = F.abs(F.col("_a") - F.col("_b")) < dx
    first = equal | (F.col("_a") > F.col("_b"))
    return both.select(*of, "read_id", "locus", "i", "j", F.when(first, F.col("_a")).otherwise(F.col("_b")).alias("llhd"),
                       F.when(first, F.col("_pa")).otherwise(F.col("_pb")).alias("pos"),
                       F.when(equal, 1).when(first, 2).otherwise(0).alias("w1"), F.when(equal, 1).when(first, 0).otherwise(2).alias("w2"))


def pair_log_likelihood(scores: DataFrame, dx: float = 1e-6) -> DataFrame:
    return allele_pairs(scores, dx).groupBy(*of_sample(scores), "locus", "i", "j").agg(F.sum("llhd").alias("z"), F.count("*").alias("reads"))


def pair_sums_blocked(scores: DataFrame, dx: float = 1e-6, lane_bytes: int = 64 << 20) -> DataFrame:
    """``pair_log_likelihood`` for genes with thousands of alleles, by matrices of blocks (see ``vectors.pair_sums``)."""
    from .vectors import pair_sums, to_vectors

    vectors, ids = to_vectors(scores)
    return pair_sums(vectors, ids, dx, lane_bytes)


def rank_alleles(scores: DataFrame, k: int = 5) -> DataFrame:
    """Each read's ``k`` best alleles of a gene."""
    best = Window.partitionBy(*of_sample(scores), "read_id", "locus").orderBy(F.desc("llhd"), "allele_id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def rank_pairs(pairs: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The pairs with the ``k`` highest likelihoods of each gene, equal ones (after rounding) together."""
    best = Window.partitionBy(*of_sample(pairs), "locus").orderBy(F.desc(F.round("z", digits)))
    return pairs.withColumn("rank", F.dense_rank().over(best)).where(F.col("rank") <= k)


def pair_emissions(scores: DataFrame, top: DataFrame, dx: float = 1e-6) -> DataFrame:
    """Weights by pair, side and position, for the pairs in ``top`` (locus, i, j) only."""
    of = of_sample(scores)
    rows = allele_pairs(scores, dx, top)
    sums = rows.groupBy(*of, "locus", "i", "j", "pos").agg(F.sum("w1").alias("w1"), F.sum("w2").alias("w2"))
    sides = sums.select(*of, "locus", "i", "j", "pos", F.explode(F.array(
        F.struct(F.lit(1).alias("side"), F.col("w1").alias("w")), F.struct(F.lit(2).alias("side"), F.col("w2").alias("w")))).alias("s"))
    return sides.where("s.w > 0").select(*of, "locus", "i", "j", "s.side", "pos", F.col("s.w").cast("long").alias("weight"))


def number_of_reads(emissions: DataFrame) -> DataFrame:
    return emissions.groupBy(*of_sample(emissions), "locus", "i", "j", "side").agg((F.sum("weight") / 2).alias("reads"))


def log10_factorial(n: Column) -> Column:
    """log10 n!: exact below 256, else by Stirling's series (to 1e-12)."""
    small = F.array(*[F.lit(v) for v in np.concatenate([[0.0], np.cumsum(np.log10(np.arange(1, 256)))]).tolist()])
    x = n.cast("double")
    series = (x + 0.5) * F.log10(x) - x * math.log10(math.e) + 0.5 * math.log10(2 * math.pi) + (1 / (12 * x) - 1 / (360 * x * x * x)) / math.log(10)
    return F.when(n < 256, F.get(small, n.cast("int"))).otherwise(series)


def coverage_likelihood(emissions: DataFrame, columns: int) -> DataFrame:
    """Per pair the multinomial log10 likelihood of its positions' weights, both sides added.

    ``columns`` is the number of alignment columns; each side gives log10 n! - n log10 columns - sum of log10 w!.
    """
    of = of_sample(emissions)
    sides = emissions.groupBy(*of, "locus", "i", "j", "side").agg(F.sum("weight").alias("n"), F.sum(log10_factorial(F.col("weight"))).alias("fws"))
    return sides.groupBy(*of, "locus", "i", "j").agg(F.sum(log10_factorial(F.col("n")) - F.col("n") * math.log10(columns) - F.col("fws")).alias("c"))


def evaluated_pairs(scores: DataFrame, columns: int, dx: float = 1e-6) -> DataFrame:
    """``pair_log_likelihood`` and ``coverage_likelihood`` of every pair: ``locus, i, j, z, reads, c``.

    Rows of a read and a pair are dealt out once, by the pair; sums by position and by pair need no other shuffle.
    Where all pairs are wanted, a join of the scores with them would make a row for each score and pair of its allele.
    """
    key = [*of_sample(scores), "locus", "i", "j"]
    by_pos = allele_pairs(scores, dx).repartition(*key).groupBy(*key, "pos").agg(
        F.sum("llhd").alias("z"), F.count("*").alias("reads"), F.sum("w1").alias("w1"), F.sum("w2").alias("w2"))
    # a side without reads gives nothing: 0! is 1
    side = lambda w: log10_factorial(F.sum(w)) - F.sum(w) * math.log10(columns) - F.sum(log10_factorial(F.col(w)))
    return by_pos.groupBy(*key).agg(F.sum("z").alias("z"), F.sum("reads").alias("reads"), (side("w1") + side("w2")).alias("c"))


def pair_posterior(pairs: DataFrame, coverage: DataFrame | None = None, cut: bool = True) -> DataFrame:
    """Normalised posterior of each gene's pairs from their log10 likelihoods ``z`` (and coverage ``c``).

    ``pairs`` is the whole pair table: those without coverage were not ranked, and with ``cut`` each of them adds the
    lowest reported probability to the norm. No pairs give an empty result. Without ``coverage`` all pairs count, with
    the ``c`` that they have (``evaluated_pairs``) or none. A gene's sums are rows joined to its pairs: no window holds
    all pairs of a gene.
    """
    of = of_sample(pairs)
    gene = [*of, "locus"]
    if coverage is None:
        kept = pairs if "c" in pairs.columns else pairs.withColumn("c", F.lit(0.0))
    else:
        kept = pairs.join(coverage.where("c IS NOT NULL").select(*gene, "i", "j", "c"), [*gene, "i", "j"])
    scored = kept.withColumn("_s", F.col("z") + F.col("c"))
    p = F.pow(F.lit(10.0), F.col("_s") - F.col("_m"))
    tops = scored.groupBy(*gene).agg(F.max("_s").alias("_m"))
    sums = scored.join(tops, gene).groupBy(*gene, "_m").agg(F.sum(p).alias("_sum"), F.min(p).alias("_least"), F.count("*").alias("_n"))
    if coverage is None or not cut:
        sums = sums.withColumn("_missing", F.lit(0))
    else:
        sums = sums.join(pairs.groupBy(*gene).agg(F.count("*").alias("_all")), gene).withColumn("_missing", F.col("_all") - F.col("_n"))
    norm = F.col("_sum") + F.col("_least") * F.col("_missing")
    return scored.join(sums, gene).withColumn("prob", p / norm).select(*gene, "i", "j", "z", "c", "prob")


def top_pairs(posterior: DataFrame, size: int | None = None, least: float | None = None) -> DataFrame:
    """Report size: the ``size`` best of each gene, those above ``least``, or all."""
    if least is not None:
        return posterior.where(F.col("prob") > least)
    if size is None:
        return posterior
    best = Window.partitionBy(*of_sample(posterior), "locus").orderBy(F.desc("prob"), "i", "j")
    return posterior.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= size).drop("_r")


def most_likely_pair(posterior: DataFrame) -> DataFrame:
    return top_pairs(posterior, size=1)


def assign_reads(scores: DataFrame, reported: DataFrame) -> DataFrame:
    """Each read's allele among those of the reported pairs: the likeliest, the earlier pair's on ties."""
    of = of_sample(scores)
    order = Window.partitionBy(*of, "locus").orderBy(F.desc("prob"), "i", "j")
    members = reported.withColumn("_o", F.row_number().over(order)).select(
        *of, "locus", "_o", F.posexplode(F.array("i", "j")).alias("_side", "allele_id")).groupBy(*of, "locus", "allele_id").agg(
        F.min(F.struct("_o", "_side")).alias("_at"))
    best = Window.partitionBy(*of, "read_id").orderBy(F.desc("llhd"), "_at", "locus")
    return scores.join(members, [*of, "locus", "allele_id"]).withColumn("_r", F.row_number().over(best)).where("_r = 1").select(
        *of, "read_id", "locus", "allele_id", "llhd")


def best_locus(scores: DataFrame) -> DataFrame:
    """Each read's gene: unfiltered before filtered, pairs before singles, then the likelihood, then the earlier gene."""
    filtered = F.col("filter_reason").isNotNull() if "filter_reason" in scores.columns else F.lit(False)
    paired = F.col("paired") if "paired" in scores.columns else F.lit(False)
    best = Window.partitionBy(*of_sample(scores), "read_id").orderBy(filtered, F.desc(paired), F.desc("llhd"), "locus", "allele_id")
    return scores.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def best_orientation(scores: DataFrame) -> DataFrame:
    """Per read and gene the orientation with the best allele; the regular one wins ties, filtered ones lose."""
    filtered = F.col("filter_reason").isNotNull() if "filter_reason" in scores.columns else F.lit(False)
    key = [*of_sample(scores), "read_id", *(["mate"] if "mate" in scores.columns else []), "locus"]
    best = Window.partitionBy(*key).orderBy(filtered, F.desc("llhd"), "rc", "allele_id")
    chosen = scores.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*key, "rc")
    return scores.join(chosen, [*key, "rc"])


def final_emission(cells: DataFrame) -> DataFrame:
    """Per read and allele, from its last row's cells ``pos, llhd``: the log10 sum, and the first column with the largest term."""
    key = [*of_sample(cells), "read_id", "allele_id"]
    tops = cells.groupBy(*key).agg(F.max("llhd").alias("_m"), F.max_by("pos", F.struct("llhd", -F.col("pos"))).alias("pos"))
    sums = cells.join(tops.select(*key, "_m"), key).groupBy(*key).agg(F.sum(F.pow(F.lit(10.0), F.col("llhd") - F.col("_m"))).alias("_s"))
    return tops.join(sums, key).select(*key, (F.col("_m") + F.log10("_s")).alias("llhd"), "pos")


def report_depth(rows: DataFrame, n: int | None, by: list[str], order: list) -> DataFrame:
    """Cut a list per key to ``n`` rows; None keeps all, 0 none."""
    if n is None:
        return rows
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
