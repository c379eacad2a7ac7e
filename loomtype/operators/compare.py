"""Comparison of reads on named alleles, groups of reads, rank correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved
from .spread import tasks


def compare_two(scores: DataFrame, one: str, two: str) -> DataFrame:
    """``read_id``, the likelihoods on two named alleles, and E, L or G."""
    sides = scores.where(F.col("allele").isin(one, two)).groupBy("read_id").pivot("allele", [one, two]).agg(F.max("llhd"))
    a, b = F.col(one), F.col(two)
    return sides.withColumn("flag", F.when(a == b, "E").when(a < b, "L").when(a > b, "G"))


def compare_many(scores: DataFrame, alleles: list[str], dx: float = 1e-6) -> DataFrame:
    """Per read the named alleles from best to worst, joined by ``>=``, or ``=`` where equal within ``dx``."""
    mine = scores.where(F.col("allele").isin(alleles))
    order = Window.partitionBy("read_id").orderBy(F.desc("llhd"), "allele")
    before = F.lag("llhd").over(order)
    sign = F.when(before.isNull(), "").when(F.abs(before - F.col("llhd")) < dx, "=").otherwise(">=")
    marked = mine.withColumn("_t", F.concat(sign, "allele")).withColumn("_r", F.row_number().over(order))
    ordered = F.array_sort(F.collect_list(F.struct("_r", "_t")))
    return marked.groupBy("read_id").agg(F.array_join(F.transform(ordered, lambda x: x["_t"]), "").alias("ordering"))


def reads_by_locus(assigned: DataFrame) -> DataFrame:
    """``locus, read_id``: the reads of each gene, each once; a read without one is an error."""
    locus = F.coalesce("locus", F.raise_error(F.concat(F.lit("read without a gene: "), F.col("read_id").cast("string"))))
    return assigned.select(locus.alias("locus"), "read_id").distinct()


def read_intervals(scores: DataFrame, read_size: int = 100) -> DataFrame:
    """The stretch that each read covers: (pos - read_size, pos)."""
    return scores.withColumn("start", F.col("pos") - read_size).withColumn("stop", F.col("pos"))


def group_by_boundary(reads: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Put each read into the region whose boundary precedes its position (the later one of a pair); the last is open."""
    marks = boundaries.groupBy("locus").agg(F.array_sort(F.collect_list(F.struct("pos", "region"))).alias("_marks"))
    met = reads.join(marks, "locus").withColumn("_m", F.filter("_marks", lambda m: m["pos"] <= F.col("pos"))).where("size(_m) > 0")
    return met.withColumn("region", F.try_element_at("_m", F.lit(-1))["region"]).select(*[F.col(c) for c in reads.columns], "region")


def mean_ranks(rows: DataFrame, by: list[str], c: str, lanes: int) -> DataFrame:
    """``by, c, rank``: the mean rank of each value (null first, as a window has it) among its group's rows.

    Values are counted and dealt to ranges; a value's rank is its range's start plus the counts before it in the range. No
    window holds a group.
    """
    counts = rows.groupBy(*by, c).agg(F.count("*").alias("_n"))
    # stored, so that ranges stay what they were when they are read again
    ranged = saved(counts.repartitionByRange(lanes, *by, c).withColumn("_lane", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = ranged.groupBy(*by, "_lane").agg(F.sum("_n").alias("_s")).select(*by, "_lane", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*by, "_lane").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*by, "_lane"]]
    return placed.alias("r").join(starts.alias("s"), same).select(*[f"r.{k}" for k in [*by, c]], (F.col("_start") + F.col("_before") + (F.col("_n") + 1) / 2).alias("rank"))


def spearman(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation of two columns per group, ties at their mean rank."""
    pairs = saved(rows.groupBy(*by, a, b).agg(F.count("*").alias("_n")))
    lanes = tasks(rows)
    out = pairs
    for c, name in ((a, "_a"), (b, "_b")):
        ranks = mean_ranks(pairs.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))), by, c, lanes).withColumnsRenamed({k: f"_r{k}" for k in [*by, c]} | {"rank": name})
        on = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in [*by, c]]
        out = out.join(ranks, on).drop(*[f"_r{k}" for k in [*by, c]])
    each = out.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return each.groupBy(*by).agg(F.corr("_a", "_b").alias("rho"))


def mismatch_histogram(mismatches: DataFrame, width: int) -> DataFrame:
    """How many reads have how many mismatches, in bins of ``width``."""
    return mismatches.groupBy((F.floor(F.col("mismatches") / width) * width).alias("bin")).count()
