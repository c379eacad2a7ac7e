"""Evaluation against validated types, and comparison of runs.

``truth``: sample, locus, allele rows (two a gene). ``called``: sample, locus, and pairs with a probability; alleles are
parsed names (struct of f1..f4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N


def truth_diploids(truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Genes of samples with just two alleles as diploids (``sample, locus, truth``), and the other groups with their counts."""
    grouped = truth.groupBy("sample", "locus").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("allele")).alias("_a"))
    two = grouped.where("n = 2").select("sample", "locus", N.diploid(F.col("_a")[0], F.col("_a")[1]).alias("truth"))
    return two, grouped.where("n <> 2").select("sample", "locus", "n")


def called_diploids(called: DataFrame) -> DataFrame:
    """``sample, locus, diploid, prob`` of called pairs (allele1, allele2)."""
    return called.withColumn("diploid", N.diploid(F.col("allele1"), F.col("allele2")))


def truth_join(truth: DataFrame, called: DataFrame) -> DataFrame:
    """Called pairs with the truth, where there is one; genes only in the truth are left out."""
    return called.join(truth, ["sample", "locus"], "left")


def most_likely_minimum_distance_pair(joined: DataFrame) -> DataFrame:
    """Per sample and gene the called pair closest to the truth at two fields, ties to the likelier."""
    d = joined.where("truth IS NOT NULL").withColumn("_d", N.diploid_distance(F.col("truth"), F.col("diploid"), 2))
    order = Window.partitionBy("sample", "locus").orderBy(F.col("_d.near"), F.col("_d.far"), F.desc("prob"), "diploid")
    return d.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_d")


def most_likely(joined: DataFrame) -> DataFrame:
    order = Window.partitionBy("sample", "locus").orderBy(F.desc("prob"), "diploid")
    return joined.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def reduce_resolution(called: DataFrame) -> DataFrame:
    """Pairs at two fields, probabilities of equal ones summed."""
    two = F.struct(N.reduce_two(F.col("diploid.lower")).alias("lower"), N.reduce_two(F.col("diploid.upper")).alias("upper"))
    return called.withColumn("diploid", two).groupBy("sample", "locus", "diploid").agg(F.sum("prob").alias("prob"))


def categorize(joined: DataFrame) -> DataFrame:
    """Category of each sample and gene by its likeliest pair: BothRight, OneRight, Different or NoSpec.

    Also the number of called pairs, whether a homozygous truth was called heterozygous, and for BothRight the summed
    probability of the pairs that agree with the called one at two fields.
    """
    best = most_likely(joined)
    d = N.diploid_distance(F.col("truth"), F.col("diploid"), 2)
    zero = F.struct(*[F.lit(0).alias(f) for f in N.FIELDS])
    category = F.when(F.col("truth").isNull(), "NoSpec").when(F.col("_d.far") == zero, "BothRight").when(F.col("_d.near") == zero, "OneRight").otherwise("Different")
    two = lambda c: F.struct(N.reduce_two(F.col(f"{c}.lower")).alias("lower"), N.reduce_two(F.col(f"{c}.upper")).alias("upper"))
    keys = ["sample", "locus"]
    summed = joined.withColumn("_two", two("diploid")).groupBy(*keys, "_two").agg(F.sum("prob").alias("_p"), F.count("*").alias("_k"))
    alternatives = joined.groupBy(*keys).agg(F.count("*").alias("alternatives"))
    rows = best.withColumn("_d", d).withColumn("category", category).withColumn("_two", two("diploid")).join(summed, [*keys, "_two"]).join(alternatives, keys)
    wrong = (F.col("truth.lower") == F.col("truth.upper")) & (F.col("diploid.lower") != F.col("diploid.upper"))
    return rows.select(*keys, "category", "alternatives", F.coalesce(wrong, F.lit(False)).alias("wrong_homozygosity"),
                       F.when(F.col("category") == "BothRight", F.col("_p")).alias("matched_prob"))


def aggregate_by_locus(categories: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(F.col("category") == c).alias(c)
    return categories.groupBy("locus").agg(count("BothRight"), count("OneRight"), count("Different"), count("NoSpec"),
                                           F.count_if("wrong_homozygosity").alias("wrongly_homozygous"), F.avg("matched_prob").alias("mean_matched_prob"))


def assign_read_to_diploid(reads: DataFrame, best: DataFrame) -> DataFrame:
    """Each assigned read goes to allele 1 or 2 of the best pair by name distance; a tie is dropped unless both are equal."""
    rows = reads.join(best.select("sample", "locus", "diploid"), ["sample", "locus"])
    one, two = N.name_distance(F.col("allele"), F.col("diploid.lower")), N.name_distance(F.col("allele"), F.col("diploid.upper"))
    same = F.col("diploid.lower") == F.col("diploid.upper")
    side = F.when(one < two, 1).when(two < one, 2).when(same, 1)
    return rows.withColumn("side", side).where("side IS NOT NULL")


def compare_two_runs(one: DataFrame, two: DataFrame, strict: bool = True) -> DataFrame:
    """Samples and genes in one run only, or in another category (with ``strict`` also with other details)."""
    detail = ["category", "alternatives", "wrong_homozygosity"] if strict else ["category"]
    a = one.select("sample", "locus", F.struct(*detail).alias("first"))
    b = two.select("sample", "locus", F.struct(*detail).alias("second"))
    return a.join(b, ["sample", "locus"], "full_outer").where(~F.col("first").eqNullSafe(F.col("second")))


def compare_times(one: DataFrame, two: DataFrame) -> DataFrame:
    """Timings of two runs by sample; a sample that one of them lacks is an error."""
    rows = one.select("sample", F.col("real").alias("real1")).join(two.select("sample", F.col("real").alias("real2")), "sample", "full_outer")
    missing = F.raise_error(F.concat(F.lit("no time for sample "), F.col("sample")))
    return rows.select("sample", F.coalesce("real1", missing).alias("real1"), F.coalesce("real2", missing).alias("real2")).withColumn(
        "ratio", F.col("real2") / F.col("real1"))


def reconcile_sequences(aligned: DataFrame, fasta: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``allele, found``: JustFasta, JustAlign, Same or Diff, less the alleles in ``known``."""
    both = aligned.select("allele", F.col("seq").alias("_a")).join(fasta.select("allele", F.col("seq").alias("_f")), "allele", "full_outer")
    found = F.when(F.col("_a").isNull(), "JustFasta").when(F.col("_f").isNull(), "JustAlign").when(F.col("_a") == F.col("_f"), "Same").otherwise("Diff")
    rows = both.select("allele", found.alias("found"))
    return rows if known is None else rows.join(known.select("allele"), "allele", "left_anti")
