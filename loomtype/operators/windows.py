"""Runs, neighbours and medians by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved
from .spread import sent


def ranked(rows: DataFrame, by: list[str], order: list[Column | str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``name``, their place from 0 in the order of their group, and the stored table that they are read from.

    Rows fall into ranges of groups and order, whose rows are counted: a row's place is its range's start in the group plus
    its place in the range. No window holds a group.
    """
    cut = saved(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_id", F.monotonically_increasing_id()))
    before = Window.partitionBy(*by).orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = cut.groupBy(*by, F.shiftright("_id", 33).alias("_lane")).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    starts = lanes.select(*by, "_lane", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    placed = cut.withColumn("_lane", F.shiftright("_id", 33)).join(sent(starts), [*by, "_lane"])
    return placed.withColumn(name, F.col("_start") + F.col("_id")).drop("_id", "_lane", "_start"), cut


def low_median(rows: DataFrame, by: list[str], value: str, *ties: str) -> DataFrame:
    """The row of rank floor(n / 2), at least 1, by value in each group."""
    order = Window.partitionBy(*by).orderBy(value, *ties)
    return rows.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(*by))).where(
        F.col("_r") == F.greatest(F.floor(F.col("_n") / 2), F.lit(1))).drop("_r", "_n")


def region_index(rows: DataFrame, by: list[str], order: str, is_mark) -> DataFrame:
    """How many region marks lie at or before each row."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("region_ix", F.sum(F.when(is_mark, 1).otherwise(0)).over(upto).cast("int"))


def runs(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Maximal runs of equal values: ``by, value, start, length, run`` (run counts from 1)."""
    along = Window.partitionBy(*by).orderBy(order)
    new = (F.lag(value).over(along).eqNullSafe(F.col(value)) & (F.row_number().over(along) > 1)).cast("int")
    numbered = rows.withColumn("_new", 1 - new).withColumn("run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run", value).agg(F.min(order).alias("start"), F.count("*").alias("length"))


def run_align(one: DataFrame, two: DataFrame, by: list[str]) -> DataFrame:
    """Walk two run lists (``start, value``) of equal total length together: a row where either changes."""
    edges = one.select(*by, "start").union(two.select(*by, "start")).distinct()
    upto = Window.partitionBy(*by).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    for name, side in (("a", one), ("b", two)):
        edges = edges.join(side.select(*by, "start", F.col("value").alias(f"_{name}")), [*by, "start"], "left").withColumn(
            name, F.last(f"_{name}", ignorenulls=True).over(upto)).drop(f"_{name}")
    nxt = F.lead("start").over(Window.partitionBy(*by).orderBy("start"))
    return edges.withColumn("stop", nxt)


def next_known(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    return rows.withColumn("next_pos", F.lead(order).over(Window.partitionBy(*by).orderBy(order)))


def segment_bounds(marks: DataFrame, by: list[str], pos: str = "pos", end: str = "end") -> DataFrame:
    """Length of each region: to the next boundary, or to the end."""
    nxt = F.lead(pos).over(Window.partitionBy(*by).orderBy(pos))
    return marks.withColumn("length", F.coalesce(nxt, F.col(end)) - F.col(pos))


def non_gapped_start(columns: DataFrame, by: list[str], pos: str = "pos", has_gap: str = "has_gap") -> DataFrame:
    """For each column the latest one, at or before it, where no allele has a gap."""
    upto = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return columns.withColumn("non_gapped", F.last(F.when(~F.col(has_gap), F.col(pos)), ignorenulls=True).over(upto))


def running_threshold(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("threshold", F.max(value).over(upto))


def consecutive_pairs(rows: DataFrame, by: list[str], order: str, value: str, combine) -> DataFrame:
    """Apply ``combine(previous, current)`` to neighbours; the first row of a group is left out."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("_b", before).where(F.col("_b").isNotNull()).withColumn("combined", combine(F.col("_b"), F.col(value))).drop("_b")


def compress_names(names: DataFrame, by: list[str], last: str) -> DataFrame:
    """Join consecutive numbers in the last field into ``01-05``; a run of two stays a run, singles stay single."""
    distinct = names.select(*by, last).distinct()
    along = Window.partitionBy(*by).orderBy(last)
    spans = distinct.withColumn("_g", F.col(last) - F.row_number().over(along)).groupBy(*by, "_g").agg(
        F.min(last).alias("lo"), F.max(last).alias("hi"))
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    shown = F.when(F.col("lo") == F.col("hi"), two("lo")).otherwise(F.concat(two("lo"), F.lit("-"), two("hi")))
    ordered = F.array_sort(F.collect_list(F.struct("lo", shown.alias("t"))))
    return spans.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), ",").alias("compressed"))


def position_map(positions: DataFrame, by: list[str]) -> DataFrame:
    """Dense index of each letter of an allele among its letters: ``pos`` -> ``column``."""
    letters = positions.where("state = 'base'")
    return letters.withColumn("column", F.row_number().over(Window.partitionBy(*by).orderBy("pos")) - 1)


def in_order_check(spans: DataFrame, by: list[str], start: str = "start", end: str = "stop") -> DataFrame:
    """Spans that begin before the one before them has ended."""
    before = F.lag(end).over(Window.partitionBy(*by).orderBy(start, end))
    return spans.withColumn("_b", before).where(F.col("_b") > F.col(start)).drop("_b")
