"""The allele graph as tables: nodes are a letter at a position, edges carry the alleles that use them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .msa import GROUP, by_allele, stream_cells


def nodes(resolved: DataFrame) -> DataFrame:
    """``pos, ch, alleles``: equal letters at one position are one node."""
    return resolved.where("state = 'base'").groupBy(*GROUP, "pos", "ch").agg(F.array_sort(F.collect_set("allele")).alias("alleles"))


def allele_graph(resolved: DataFrame) -> DataFrame:
    """Edges ``src, src_ch, dst, dst_ch, alleles`` from each letter to the next known letter of the allele."""
    along = Window.partitionBy(*GROUP, "allele").orderBy("pos")
    steps = resolved.where("state = 'base'").withColumn("dst", F.lead("pos").over(along)).withColumn("dst_ch", F.lead("ch").over(along))
    return steps.where("dst IS NOT NULL").groupBy(*GROUP, F.col("pos").alias("src"), F.col("ch").alias("src_ch"), "dst", "dst_ch").agg(
        F.array_sort(F.collect_set("allele")).alias("alleles"))


def join_same_paths(edges: DataFrame) -> DataFrame:
    """Unbranched runs of edges as one: edges whose end has one way in and one way out continue a run.

    Returns ``src, run, stop, letters`` for runs along positions: chains are found as islands, not by walking. A node's
    letter is in the run of its way out; at the end of all paths it is in the run of its way in, or, of several ways
    in, a run of its own.
    """
    out_n = edges.groupBy(*GROUP, F.col("src").alias("pos"), F.col("src_ch").alias("ch")).agg(F.count("*").alias("out_n"))
    in_n = edges.groupBy(*GROUP, F.col("dst").alias("pos"), F.col("dst_ch").alias("ch")).agg(F.count("*").alias("in_n"))
    through = out_n.join(in_n, [*GROUP, "pos", "ch"]).where("out_n = 1 AND in_n = 1").select(*GROUP, F.col("pos").alias("src"), F.col("ch").alias("src_ch"))
    marked = edges.join(through.withColumn("_on", F.lit(1)), [*GROUP, "src", "src_ch"], "left")
    along = Window.partitionBy(*GROUP, "alleles").orderBy("src", "src_ch")
    new = F.when(F.col("_on").isNull() | (F.lag("dst").over(along) != F.col("src")) | F.lag("dst").over(along).isNull(), 1).otherwise(0)
    numbered = marked.withColumn("_new", new).withColumn("run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "src_ch"))), lambda x: x["src_ch"]), "")
    ends = in_n.join(out_n, [*GROUP, "pos", "ch"], "left_anti")
    runs = numbered.groupBy(*GROUP, "alleles", "run").agg(
        F.min("src").alias("src"), F.max("dst").alias("stop"), letters.alias("letters"), F.max_by("dst_ch", "dst").alias("_ch"))
    last = ends.where("in_n = 1").select(*GROUP, F.col("pos").alias("stop"), F.col("ch").alias("_ch"), F.col("ch").alias("_tail"))
    runs = runs.join(last, [*GROUP, "stop", "_ch"], "left").withColumn("letters", F.concat("letters", F.coalesce("_tail", F.lit(""))))
    inward = edges.select(*GROUP, F.col("dst").alias("pos"), F.col("dst_ch").alias("ch"), F.explode("alleles").alias("_a"))
    alone = ends.where("in_n > 1").join(inward, [*GROUP, "pos", "ch"]).groupBy(*GROUP, "pos", "ch").agg(F.array_sort(F.collect_set("_a")).alias("alleles"))
    own = alone.select(*GROUP, "alleles", F.lit(0).cast("long").alias("run"), F.col("pos").alias("src"), F.col("pos").alias("stop"), F.col("ch").alias("letters"))
    return runs.select(*GROUP, "alleles", "run", "src", "stop", "letters").unionByName(own)


def terminal_nodes(resolved: DataFrame) -> DataFrame:
    """``kind, pos, alleles``: where known spans start (S) and end (E, one behind), and boundaries (B) that alleles cross."""
    spans = bounds(resolved)
    known = resolved.where("state <> 'unknown'")
    along = Window.partitionBy(*GROUP, "allele").orderBy("pos")
    crossed = known.withColumn("_p", F.lag("region_ix").over(along)).withColumn("_q", F.lag("pos").over(along)).where("_p <> region_ix AND _q = pos - 1")
    rows = spans.select(*GROUP, F.lit("S").alias("kind"), F.col("start").alias("pos"), "allele").unionByName(
        spans.select(*GROUP, F.lit("E").alias("kind"), F.col("stop").alias("pos"), "allele")).unionByName(
        crossed.select(*GROUP, F.lit("B").alias("kind"), "pos", "allele"))
    return rows.groupBy(*GROUP, "kind", "pos").agg(F.array_sort(F.collect_set("allele")).alias("alleles"))


def sequence_slice(resolved: DataFrame, start: int, stop: int, pad: bool = False) -> DataFrame:
    """Each allele's letters in [start, stop); with ``pad`` a point stands for every missing column."""
    rows = resolved.where((F.col("pos") >= start) & (F.col("pos") < stop))
    letter = F.when(F.col("state") == "base", F.col("ch")).otherwise(F.lit("." if pad else ""))
    ordered = F.array_sort(F.collect_list(F.struct("pos", letter.alias("c"))))
    return rows.groupBy(*GROUP, "allele").agg(F.array_join(F.transform(ordered, lambda x: x["c"]), "").alias("seq"))


def allele_slices(resolved: DataFrame, start: int | None = None, begin: str = "at", stop: int | None = None, length: int | None = None,
                  pad: bool = False, marks: bool = False) -> DataFrame:
    """``allele, seq``: the letters of each allele along its path, cut at both sides.

    Without ``start`` all known spans follow each other. With it the path begins in one span and ends where that span
    ends: ``at`` needs a letter at that position (``seq`` is null without one), ``next`` takes the first letter there or
    behind, ``pad`` does too and writes a point for each position before it. The path ends before position ``stop``, or
    after ``length`` characters, points and marks included; with ``pad`` points fill what lacks of these. With
    ``marks`` a bar stands for each boundary that the path crosses. Alleles without a letter on the path have no row.
    """
    if begin not in ("at", "next", "pad"):
        raise ValueError(f"a slice begins at, next or pad, not {begin}")
    if stop is not None and length is not None or pad and length is None:
        raise ValueError("a slice has a stop or a length, and points fill a length only")
    known = resolved.where("state <> 'unknown'")
    if start is not None:
        known = known.where(F.col("pos") >= start)
    if stop is not None:
        known = known.where(F.col("pos") < stop)
    allele = Window.partitionBy(*GROUP, "allele")
    base = F.col("state") == "base"
    cells = known.withColumn("_span", F.col("pos") - F.row_number().over(allele.orderBy("pos")))
    span = Window.partitionBy(*GROUP, "allele", "_span").orderBy("pos")
    cells = cells.withColumn("_cross", F.col("region_ix") - F.lag("region_ix").over(span)).withColumn("_first", F.min(F.when(base, F.col("pos"))).over(allele))
    if start is None:
        cells = cells.where("_first IS NOT NULL")
        bars = F.coalesce(F.col("_cross"), F.lit(0))
    else:
        cells = cells.withColumn("_own", F.min(F.when(base, F.col("_span"))).over(allele)).where("_span = _own AND pos >= _first")
        bars = F.when(F.col("pos") > F.col("_first"), F.coalesce(F.col("_cross"), F.lit(0))).otherwise(0)
    if length is not None:  # no more letters are gathered than can be kept
        cells = cells.withColumn("_n", F.count(F.when(base, 1)).over(allele.orderBy("pos"))).where(F.col("_n") <= length)
    letter = F.when(base, F.col("ch")).otherwise("")
    piece = F.concat(F.repeat(F.lit("|"), bars.cast("int")), letter) if marks else letter
    ordered = F.array_sort(F.collect_list(F.struct("pos", piece.alias("c"))))
    rows = cells.groupBy(*GROUP, "allele").agg(F.array_join(F.transform(ordered, lambda x: x["c"]), "").alias("seq"), F.first("_first").alias("_first"))
    seq = F.col("seq")
    if start is not None and begin == "at":
        seq = F.when(F.col("_first") == start, seq)
    elif start is not None and begin == "pad":
        seq = F.concat(F.repeat(F.lit("."), (F.col("_first") - start).cast("int")), seq)
    if length is not None:
        seq = F.rpad(seq, length, ".") if pad else F.substring(seq, 1, length)
    return rows.select(*GROUP, "allele", seq.alias("seq"))


def nodes_at(resolved: DataFrame, pos: int, on_gap: str = "null") -> DataFrame:
    """Each allele's letter at a position; in a gap null, or an error."""
    letter = F.when(F.col("state") == "base", F.col("ch"))
    if on_gap == "error":
        letter = F.coalesce(letter, F.raise_error(F.concat(F.lit("no node at this position in "), F.col("allele"))))
    return resolved.where(F.col("pos") == pos).select(*GROUP, "allele", letter.alias("ch"))


def _spans(r) -> tuple:
    """Where an allele's known letters begin and end."""
    known = np.concatenate([[False], stream_cells(r.stream, r.source == "prot")[2], [False]])
    edges = np.flatnonzero(known[1:] != known[:-1]) + r.start_pos
    return edges[::2], edges[1::2]


def bounds(resolved: DataFrame) -> DataFrame:
    """All known spans of each allele: ``start, stop`` (stop excluded); of positions or of resolved streams."""
    if "stream" in resolved.columns:
        return by_allele(resolved, _spans, {"start": "int", "stop": "int"})
    known = resolved.where("state <> 'unknown'")
    span = F.col("pos") - F.row_number().over(Window.partitionBy(*GROUP, "allele").orderBy("pos"))
    return known.withColumn("_g", span).groupBy(*GROUP, "allele", "_g").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop")).drop("_g")


def alleles_with_data(spans: DataFrame, pos: int, include_ends: bool = True) -> DataFrame:
    inside = (F.col("start") <= pos) & ((F.col("stop") >= pos) if include_ends else (F.col("stop") > pos))
    return spans.where(inside).select(*GROUP, "allele").distinct()


def starts_by_position(spans: DataFrame) -> DataFrame:
    """One start node per position, with the alleles that begin there."""
    return spans.groupBy(*GROUP, "start").agg(F.array_sort(F.collect_set("allele")).alias("alleles"))


def alignment_range(spans: DataFrame) -> DataFrame:
    return spans.groupBy(*GROUP).agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def subgraph_between(edges: DataFrame, start: int, stop: int) -> DataFrame:
    return edges.where((F.col("src") >= start) & (F.col("dst") <= stop))


def by_position(node_rows: DataFrame) -> DataFrame:
    """Nodes grouped by position: their number and letters."""
    return node_rows.groupBy(*GROUP, "pos").agg(F.count("*").alias("nodes"), F.array_join(F.array_sort(F.collect_set("ch")), "").alias("letters"))


def neighbour_through_gap(edges: DataFrame, pos: int) -> DataFrame:
    """For alleles without a letter at ``pos``: the edge that leaps over it, with the nearer end as neighbour."""
    over = edges.where((F.col("src") < pos) & (F.col("dst") > pos))
    before = (F.lit(pos) - F.col("src")) <= (F.col("dst") - F.lit(pos))
    return over.select(*GROUP, F.explode("alleles").alias("allele"), F.when(before, F.col("src")).otherwise(F.col("dst")).alias("neighbour"))
