"""Sets of alleles as sorted arrays, and maps from alleles to values as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allele_set(column: str, condition: Column | None = None) -> Column:
    """Aggregate: the distinct alleles (that meet a condition), sorted."""
    value = F.col(column) if condition is None else F.when(condition, F.col(column))
    return F.array_sort(F.collect_set(value))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def inter_diff(a: Column, b: Column) -> Column:
    """struct(inter, diff, identical, disjoint): what of ``a`` is in ``b``, and what not."""
    inter, diff = intersection(a, b), difference(a, b)
    return F.struct(inter.alias("inter"), diff.alias("diff"), (F.size(diff) == 0).alias("identical"), (F.size(inter) == 0).alias("disjoint"))


def with_member(a: Column, member: Column) -> Column:
    return F.array_sort(F.array_union(a, F.array(member)))


def without_member(a: Column, member: Column) -> Column:
    return F.array_remove(a, member)


def listed(a: Column) -> Column:
    return F.array_join(a, ";")


def readable(a: Column, everything: Column, longest: int = 1000, prefix: str = "C. of ") -> Column:
    """Everything, Nothing, the members, or what is missing where that is shorter, cut to ``longest`` characters."""
    half = F.floor(F.size(everything) / 2)
    text = F.when(F.size(a) == F.size(everything), F.lit("Everything")).when(F.size(a) == 0, F.lit("Nothing")).when(
        F.size(a) <= half, listed(a)).otherwise(F.concat(F.lit(prefix), listed(difference(everything, a))))
    return F.left(text, F.lit(longest))


def map_values(rows: DataFrame, value: Column) -> DataFrame:
    return rows.withColumn("value", value)


def map_two(a: DataFrame, b: DataFrame, value) -> DataFrame:
    """Combine two maps over the same alleles: ``value(a's column, b's column)``."""
    both = a.withColumnRenamed("value", "_a").join(b.withColumnRenamed("value", "_b"), ["locus", "allele"])
    return both.withColumn("value", value(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def update_from_set(rows: DataFrame, members: DataFrame, value) -> DataFrame:
    """Change the values of the alleles in ``members`` (locus, allele)."""
    marked = rows.join(members.select("locus", "allele").distinct().withColumn("_in", F.lit(True)), ["locus", "allele"], "left")
    return marked.withColumn("value", F.when(F.col("_in"), value(F.col("value"))).otherwise(F.col("value"))).drop("_in")


def inverted(rows: DataFrame) -> DataFrame:
    """``locus, value, alleles``: the alleles that share a value."""
    return rows.groupBy("locus", "value").agg(F.array_sort(F.collect_set("allele")).alias("alleles"))
