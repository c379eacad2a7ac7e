"""Selection of alleles and reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import SPLICE_VARIANTS


def select_by_regex(alleles: DataFrame, pattern: str) -> DataFrame:
    return alleles.where(F.col("allele").rlike(pattern))


def select_specific(alleles: DataFrame, wanted: list[str]) -> DataFrame:
    return alleles.where(F.col("allele").isin(wanted))


def select_number(alleles: DataFrame, n: int, *tie_breakers: str) -> DataFrame:
    """The first ``n`` alleles of each gene in the order of their names."""
    order = Window.partitionBy("locus").orderBy("f1", "f2", "f3", "f4", "allele", *tie_breakers)
    return alleles.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def drop_suffixed(alleles: DataFrame) -> DataFrame:
    return alleles.where(F.col("suffix").isNull())


def apply_selectors(alleles: DataFrame, regexes: list[str] = (), specific: list[str] = (), number: int | None = None,
                    keep_suffixed: bool = False) -> DataFrame:
    """Alleles that any selector takes, each once; all where there is no selector. Suffixed ones go unless kept."""
    if not keep_suffixed:
        alleles = drop_suffixed(alleles)
    taken: Column | None = None
    for condition in [F.col("allele").rlike(r) for r in regexes] + ([F.col("allele").isin(list(specific))] if specific else []):
        taken = condition if taken is None else taken | condition
    if number is None:
        return alleles if taken is None else alleles.where(taken)
    order = Window.partitionBy("locus").orderBy("f1", "f2", "f3", "f4", "allele")
    first = F.col("_r") <= number
    ranked = alleles.withColumn("_r", F.row_number().over(order))
    return ranked.where(first if taken is None else taken | first).drop("_r")


def drop_splice_variants(alleles: DataFrame) -> DataFrame:
    """Leave out the listed splice variants; genes without a list are kept whole."""
    return alleles.where(~F.col("allele").isin([a for known in SPLICE_VARIANTS.values() for a in known]))


def limit_reads(reads: DataFrame, n: int) -> DataFrame:
    """The first ``n`` reads by id; a pair counts once."""
    return reads.orderBy("read_id").limit(n)


def specific_reads(reads: DataFrame, wanted: DataFrame) -> DataFrame:
    """Reads with one of the wanted names, each name once (its first read)."""
    found = reads.join(wanted.select("name").distinct(), "name", "left_semi")
    first = Window.partitionBy("name").orderBy("read_id")
    return found.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def split_by_quality(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads whose qualities can be decoded, and the others for a quarantine table."""
    good = F.coalesce(F.col("qual").rlike("^[!-~]*$") & (F.length("qual") == F.length("seq")), F.lit(False))
    return reads.where(good), reads.where(~good)


def non_zero_posterior(pairs: DataFrame, least: float = 1e-6) -> DataFrame:
    return pairs.where(F.col("prob") > least)


def between_positions(positions: DataFrame, start: int, end: int) -> DataFrame:
    return positions.where((F.col("pos") >= start) & (F.col("pos") < end))


def in_window(reads: DataFrame, start: int, end: int) -> DataFrame:
    """Reads whose best position lies strictly inside the window."""
    return reads.where((F.col("pos") > start) & (F.col("pos") < end))


def full_sequences_only(positions: DataFrame, *by: str) -> DataFrame:
    """Alleles (or alleles and regions) without an unknown position."""
    keys = ["locus", "allele", *by]
    return positions.groupBy(*keys).agg(F.max(F.col("state") == "unknown").alias("_u")).where(~F.col("_u")).select(*keys)


def strip_to_exons(positions: DataFrame) -> DataFrame:
    return positions.where(F.col("region_kind") == "Exon")
