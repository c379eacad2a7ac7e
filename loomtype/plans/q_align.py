"""Queries over alignments that are derived from the texts' letters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.values import letters
from ..operators import graph as G
from ..operators import msa as M
from ..operators import select as S
from ..operators import windows as W
from ..operators.spread import dealt
from .registry import derive, query

_LETTERS = "translate(regexp_replace(lower(text), '[^a-z]', ''{g}), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
_ROWS = {"documents": "lang AS locus, doc_id AS id", "benchmark": "concat('L', item_id % 3) AS locus, item_id AS id"}


_CODES = np.zeros(256, np.uint8)
_CODES[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = np.frombuffer(b"ACGTACGTACGTACGTACGTACGTAC", np.uint8)


def streams(spark, sf, table="documents", refs=False):
    """Alignment streams: gaps, unknown beginnings and the reference's letters as a file would have them; of references only with ``refs``."""
    x = derive(spark, sf, f"SELECT {_ROWS[table]}, lower(text) AS text FROM {{{table}}} WHERE text IS NOT NULL", table).where("text RLIKE '[a-z]'")
    ids = x.groupBy("locus").agg(F.min("id").alias("ref"))
    seq = F.expr(_LETTERS.format(g=""))
    # the references' letters; two rows of one id are one reference
    first = x.join(F.broadcast(ids), "locus").where("id = ref").select("locus", "ref", seq.alias("ref_seq")).groupBy("locus").agg(F.first("ref").alias("ref"), F.min("ref_seq").alias("ref_seq"))

    def build(frames):
        for frame in frames:
            frame["stream"] = [_cells(r.text, r.ref_seq, r.id, r.id == r.ref) for r in frame.itertuples()]
            yield frame[["locus", "id", "ref", "stream"]]

    rows = (x if refs else dealt(x)).join(F.broadcast(first), "locus")  # a row a locus
    if refs:
        rows = rows.where("id = ref")
    rows = rows.withColumn("ref_seq", F.expr("substr(ref_seq, 1, length(text))")).mapInPandas(build, "locus string, id long, ref long, stream string")
    return rows.select("locus", F.lit("nuc").alias("source"), F.concat(F.lit("D"), F.col("id").cast("string")).alias("allele"),
                       (F.col("id") == F.col("ref")).alias("is_ref"), F.lit(1).alias("start_pos"), "stream")


def _cells(text: str, ref: str, number: int, is_ref: bool) -> str:
    """A stream's letters, with ``|`` after every fifty."""
    own = _CODES[np.frombuffer(text.encode(), np.uint8)]
    own = own[own > 0]
    i = np.arange(1, len(own) + 1)
    out = own.copy()
    if not is_ref:
        other = np.zeros(len(own), np.uint8)
        other[: len(ref)] = np.frombuffer(ref.encode(), np.uint8)[: len(own)]
        out[own == other] = ord("-")
        out[(number + i) % 29 == 0] = ord(".")
        out[(i <= number % 7) | ((number % 7 > 0) & (i >= 60) & (i < 60 + number % 5))] = ord("*")
    return np.insert(out, i[(i % 50 == 0) & (i < len(own))], ord("|")).tobytes().decode()


def cells_sql(table="documents"):
    return f"""WITH x AS (SELECT * FROM (SELECT {_ROWS[table]}, {_LETTERS.format(g=", 'g'")} AS seq FROM {table} WHERE text IS NOT NULL) y WHERE seq <> ''),
r AS (SELECT locus, min(id) AS ref FROM x GROUP BY locus),
c AS (SELECT x.locus, id, id = ref AS is_ref, unnest(range(1, length(seq) + 1)) AS pos, unnest(string_split(seq, '')) AS c FROM x JOIN r ON x.locus = r.locus),
cell AS (SELECT locus, concat('D', id) AS allele, is_ref, CAST(pos AS INT) AS pos, CAST((pos - 1) // 50 AS INT) AS region_ix,
  CASE WHEN is_ref THEN c WHEN pos <= id % 7 OR id % 7 > 0 AND pos >= 60 AND pos < 60 + id % 5 THEN '*' WHEN (id + pos) % 29 = 0 THEN '.' ELSE c END AS ch,
  CASE WHEN is_ref THEN 'base' WHEN pos <= id % 7 OR id % 7 > 0 AND pos >= 60 AND pos < 60 + id % 5 THEN 'unknown' WHEN (id + pos) % 29 = 0 THEN 'gap' ELSE 'base' END AS state FROM c)"""


_D, _B = cells_sql(), cells_sql("benchmark")


def whole(spark, sf, table="documents"):
    """Resolved streams, a row an allele."""
    return M.resolve_streams(streams(spark, sf, table), streams(spark, sf, table, refs=True))


def resolved(spark, sf, table="documents"):
    """Their letters, a row each."""
    return M.parse_streams(whole(spark, sf, table))


@query("src6_parse_alignments", f"""{_D} SELECT locus, allele, region_ix, CAST(min(pos) AS INT) AS first_pos, CAST(max(pos) AS INT) AS last_pos, count(*) FILTER (state = 'gap') AS gaps,
  count(*) FILTER (state = 'unknown') AS unknown, count(*) FILTER (state = 'base') AS known FROM cell GROUP BY locus, allele, region_ix""")
def src6(spark, sf):
    return M.parse_streams(streams(spark, sf)).groupBy("locus", "allele", "region_ix").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count_if(F.col("state") == "gap").alias("gaps"),
        F.count_if(F.col("state") == "unknown").alias("unknown"), F.count_if(F.col("state").isin("base", "same")).alias("known"))


@query("jn4_resolve_to_reference", f"{_D} SELECT locus, allele, md5(string_agg(ch, '' ORDER BY pos)) AS digest, count(*) AS letters FROM cell WHERE state = 'base' GROUP BY locus, allele")
def jn4(spark, sf):
    return M.allele_sequences(whole(spark, sf)).select("locus", "allele", F.md5("seq").alias("digest"), F.length("seq").cast("long").alias("letters"))


@query("jn5_reference_sequence", f"{_D} SELECT locus, string_agg(ch, '' ORDER BY pos) AS seq FROM cell WHERE is_ref GROUP BY locus")
def jn5(spark, sf):
    p = M.parse_streams(streams(spark, sf)).where("is_ref")
    return M.allele_sequences(p).select("locus", "seq")


_REF = "ref AS (SELECT locus, pos, ch AS r FROM cell WHERE is_ref)"
_STATUS = "CASE WHEN count(*) FILTER (state <> 'unknown') = 0 THEN 'Missing' WHEN count(*) FILTER (state <> 'unknown') < count(*) THEN 'Partial' ELSE 'Full' END"


@query("jn6_segment_distance_to_reference", f"""{_D}, {_REF}
SELECT c.locus, allele, region_ix, count(*) FILTER (state <> 'unknown' AND ch <> coalesce(r, '.')) AS mismatches, {_STATUS} AS status
FROM cell c LEFT JOIN ref ON c.locus = ref.locus AND c.pos = ref.pos WHERE NOT is_ref GROUP BY c.locus, allele, region_ix""")
def jn6(spark, sf):
    return M.segment_distance_to_reference(whole(spark, sf), references=streams(spark, sf, refs=True)).select("locus", "allele", "region_ix", "mismatches", "status")


_SEG = f"""{_B}, seg AS (SELECT a.locus, a.allele AS target, b.allele AS candidate, a.region_ix, count(*) FILTER (a.state <> 'unknown' AND b.state <> 'unknown' AND a.ch <> b.ch) AS mismatches,
  count(*) FILTER (a.state = 'unknown') = 0 AS ta, count(*) FILTER (b.state = 'unknown') = 0 AS tb FROM cell a JOIN cell b ON a.locus = b.locus AND a.pos = b.pos AND a.region_ix = b.region_ix AND a.allele <> b.allele
  GROUP BY a.locus, a.allele, b.allele, a.region_ix)"""


@query("jn7_segment_distance_between", f"{_SEG} SELECT locus, target, candidate, region_ix, mismatches, ta AS target_full, tb AS candidate_full FROM seg")
def jn7(spark, sf):
    return M.segment_distances(resolved(spark, sf, "benchmark")).select(
        "locus", "target", "candidate", "region_ix", "mismatches", (F.col("target_status") == "Full").alias("target_full"), (F.col("candidate_status") == "Full").alias("candidate_full"))


_WEIGHTED = f"""{_SEG}, len AS (SELECT locus, region_ix, count(*) AS len FROM cell WHERE is_ref GROUP BY locus, region_ix), refs AS (SELECT DISTINCT locus, allele AS ref FROM cell WHERE is_ref),
w AS (SELECT seg.locus, target, candidate, sum(CASE WHEN ta THEN mismatches * len END) AS m, sum(CASE WHEN ta THEN len END) AS l, bool_and(ta = tb) AS same FROM seg JOIN len ON seg.locus = len.locus AND seg.region_ix = len.region_ix GROUP BY seg.locus, target, candidate),
d AS (SELECT w.locus, target, candidate, m / l AS distance FROM w LEFT JOIN refs ON w.locus = refs.locus AND w.candidate = ref WHERE (same OR ref IS NOT NULL) AND l > 0),
dist AS (SELECT *, row_number() OVER (PARTITION BY locus, target ORDER BY distance, candidate) AS rank FROM d)"""


def _weighted(spark, sf):
    return M.weighted_distances(resolved(spark, sf, "benchmark"))


@query("jn8_distance_weighted_per_segment", f"{_WEIGHTED} SELECT locus, target, candidate, round(distance, 6) AS distance, rank FROM dist")
def jn8(spark, sf):
    return _weighted(spark, sf).select("locus", "target", "candidate", F.round("distance", 6).alias("distance"), F.col("rank").cast("long"))


@query("jn11_compute_distances", f"{_WEIGHTED} SELECT locus, target, candidate AS nearest FROM dist WHERE rank = 1")
def jn11(spark, sf):
    return M.compute_distances("weighted", resolved(spark, sf, "benchmark")).where("rank = 1").select("locus", "target", F.col("candidate").alias("nearest"))


@query("jn10_distance_reference", f"""{_B}, a AS (SELECT DISTINCT locus, allele, is_ref FROM cell)
SELECT t.locus, t.allele AS target, c.allele AS candidate, c.is_ref AS is_zero FROM a t JOIN a c ON t.locus = c.locus AND t.allele <> c.allele""")
def jn10(spark, sf):
    d = M.compute_distances("reference", alleles=streams(spark, sf, "benchmark"))
    return d.select("locus", "target", "candidate", (F.col("distance") == 0).alias("is_zero"))


_FILL = f"""{_WEIGHTED}, u AS (SELECT locus, allele, count(*) FILTER (state = 'unknown') AS n, bool_or(is_ref) AS ref FROM cell GROUP BY locus, allele),
donor AS (SELECT locus, target, candidate FROM (SELECT d.*, row_number() OVER (PARTITION BY d.locus, target ORDER BY rank) AS k FROM dist d JOIN u t ON d.locus = t.locus AND target = t.allele AND t.n > 0 AND NOT t.ref
  JOIN u c ON d.locus = c.locus AND candidate = c.allele AND c.n = 0) WHERE k = 1),
filled AS (SELECT c.locus, c.allele, c.pos, c.region_ix, d.candidate AS donor, CASE WHEN c.state = 'unknown' AND x.ch IS NOT NULL THEN x.ch ELSE c.ch END AS ch, c.state = 'unknown' AND x.ch IS NOT NULL AS f
  FROM cell c LEFT JOIN donor d ON c.locus = d.locus AND c.allele = d.target LEFT JOIN cell x ON x.locus = c.locus AND x.allele = d.candidate AND x.pos = c.pos)"""


@query("jn12_impute_missing", f"{_FILL} SELECT locus, allele, md5(string_agg(ch, '' ORDER BY pos)) AS digest, count(*) FILTER (f) AS filled FROM filled GROUP BY locus, allele")
def jn12(spark, sf):
    rows, _ = M.impute_missing(resolved(spark, sf, "benchmark"), _weighted(spark, sf))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "ch")))
    return rows.groupBy("locus", "allele").agg(F.md5(F.array_join(F.transform(ordered, lambda x: x["ch"]), "")).alias("digest"), F.count_if("filled").alias("filled"))


@query("jn13_imputed_segments", f"{_FILL} SELECT locus, allele, donor, region_ix, CAST(min(pos) AS INT) AS start, CAST(max(pos) + 1 AS INT) AS stop FROM filled WHERE f GROUP BY locus, allele, donor, region_ix")
def jn13(spark, sf):
    _, alterations = M.impute_missing(resolved(spark, sf, "benchmark"), _weighted(spark, sf))
    return alterations.select("locus", "allele", "donor", "region_ix", "start", F.col("end").alias("stop"))


@query("jn14_match_gen_nuc", """
WITH a AS (SELECT DISTINCT lang AS locus, source AS allele FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT lang AS locus, source AS allele FROM documents WHERE doc_id % 3 = 0)
SELECT coalesce(a.locus, b.locus) AS locus, coalesce(a.allele, b.allele) AS allele, CASE WHEN a.locus IS NULL THEN 'nuc' WHEN b.locus IS NULL THEN 'gen' ELSE 'both' END AS found
FROM a FULL OUTER JOIN b ON a.locus = b.locus AND a.allele = b.allele""")
def jn14(spark, sf):
    d = derive(spark, sf, "SELECT doc_id, lang AS locus, source AS allele FROM {documents}", "documents")
    return M.match_gen_nuc(d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0"))


@query("agg19_region_variability", f"""{_D}, {_REF}, whole AS (SELECT locus, allele FROM cell GROUP BY locus, allele HAVING count(*) FILTER (state = 'unknown') = 0),
v AS (SELECT DISTINCT c.locus, c.region_ix, c.pos, c.ch FROM cell c JOIN whole w ON c.locus = w.locus AND c.allele = w.allele JOIN ref ON c.locus = ref.locus AND c.pos = ref.pos WHERE state = 'base' AND ch <> r),
n AS (SELECT locus, region_ix, count(*) AS variants FROM v GROUP BY locus, region_ix), l AS (SELECT locus, region_ix, count(*) AS length FROM cell WHERE is_ref GROUP BY locus, region_ix)
SELECT l.locus, l.region_ix, coalesce(variants, 0) AS variants, length FROM l LEFT JOIN n ON l.locus = n.locus AND l.region_ix = n.region_ix""")
def agg19(spark, sf):
    return M.region_variability(whole(spark, sf), references=streams(spark, sf, refs=True)).select("locus", "region_ix", "variants", "length")


@query("agg22_region_sizes", f"{_D} SELECT region_ix, count(DISTINCT n) AS sizes FROM (SELECT allele, region_ix, count(*) FILTER (state = 'base') AS n FROM cell GROUP BY locus, allele, region_ix) GROUP BY region_ix")
def agg22(spark, sf):
    n = M.region_lengths(whole(spark, sf))
    return n.groupBy("region_ix").agg(F.size(F.collect_set("length")).cast("long").alias("sizes"))


@query("agg26_sequence_length", f"{_D} SELECT locus, allele, count(*) FILTER (state <> 'unknown') AS length FROM cell GROUP BY locus, allele")
def agg26(spark, sf):
    return M.sequence_length(M.parse_streams(streams(spark, sf))).select("locus", "allele", "length")


@query("flt13_full_sequences_only", f"{_D} SELECT locus, allele, region_ix FROM cell GROUP BY locus, allele, region_ix HAVING count(*) FILTER (state = 'unknown') = 0")
def flt13(spark, sf):
    return S.full_sequences_only(M.parse_streams(streams(spark, sf)), "region_ix")


@query("flt16_between_positions", f"{_D} SELECT locus, count(*) AS cells, count(DISTINCT allele) AS alleles FROM cell WHERE pos >= 40 AND pos < 140 GROUP BY locus")
def flt16(spark, sf):
    rows = S.between_positions(M.parse_streams(streams(spark, sf)), 40, 140)
    return rows.groupBy("locus").agg(F.count("*").alias("cells"), F.count_distinct("allele").alias("alleles"))


@query("prj1_gene_region_of", f"{_D} SELECT locus, concat('X', region_ix + 1) AS region, CAST(min(pos) AS INT) AS first_pos, count(*) AS cells FROM cell GROUP BY locus, region_ix")
def prj1(spark, sf):
    from ..functions.values import region_label

    p = M.parse_streams(streams(spark, sf)).withColumn("region", region_label(F.col("region_kind"), F.col("region_n"), short=True))
    return p.groupBy("locus", "region").agg(F.min("pos").alias("first_pos"), F.count("*").alias("cells"))


@query("prj2_strip_to_exons", f"{_D} SELECT locus, count(*) AS cells FROM cell GROUP BY locus")
def prj2(spark, sf):
    return S.strip_to_exons(M.parse_streams(streams(spark, sf))).groupBy("locus").agg(F.count("*").alias("cells"))


@query("win1_region_index", f"{_D} SELECT locus, allele, CAST(max(region_ix) AS INT) AS regions FROM cell GROUP BY locus, allele")
def win1(spark, sf):
    s = streams(spark, sf).select("locus", "allele", F.posexplode(letters(F.col("stream"))).alias("k", "c"))
    return W.region_index(s, ["locus", "allele"], "k", F.col("c") == "|").groupBy("locus", "allele").agg(F.max("region_ix").alias("regions"))


@query("win2_runs", f"""{_B}, g AS (SELECT *, pos - row_number() OVER (PARTITION BY locus, allele, state ORDER BY pos) AS g FROM cell)
SELECT locus, allele, state, CAST(min(pos) AS INT) AS start, count(*) AS length FROM g GROUP BY locus, allele, state, g""")
def win2(spark, sf):
    return W.runs(resolved(spark, sf, "benchmark"), ["locus", "allele"], "pos", "state").select("locus", "allele", "state", "start", "length")


@query("win4_next_known", f"{_B} SELECT locus, allele, pos, CAST(lead(pos) OVER (PARTITION BY locus, allele ORDER BY pos) AS INT) AS next_pos FROM cell WHERE state = 'base'")
def win4(spark, sf):
    return W.next_known(resolved(spark, sf, "benchmark").where("state = 'base'"), ["locus", "allele"], "pos").select("locus", "allele", "pos", "next_pos")


@query("win7_segment_bounds", f"""{_D} SELECT locus, region_ix, CAST(min(pos) AS INT) AS pos, count(*) AS length FROM cell WHERE is_ref GROUP BY locus, region_ix""")
def win7(spark, sf):
    ref = M.parse_streams(streams(spark, sf)).where("is_ref")
    ends = ref.groupBy("locus").agg((F.max("pos") + 1).alias("end"))
    marks = ref.groupBy("locus", "region_ix").agg(F.min("pos").alias("pos")).join(ends, "locus")
    return W.segment_bounds(marks, ["locus"]).select("locus", "region_ix", "pos", F.col("length").cast("long").alias("length"))


@query("win8_non_gapped_start", f"""{_B}, g AS (SELECT locus, pos, bool_or(state = 'gap') AS has_gap FROM cell GROUP BY locus, pos)
SELECT locus, pos, CAST(max(CASE WHEN NOT has_gap THEN pos END) OVER (PARTITION BY locus ORDER BY pos) AS INT) AS non_gapped FROM g""")
def win8(spark, sf):
    cols = resolved(spark, sf, "benchmark").groupBy("locus", "pos").agg(F.max(F.col("state") == "gap").alias("has_gap"))
    return W.non_gapped_start(cols, ["locus"]).select("locus", "pos", "non_gapped")


_EDGE = f"""{_B}, n AS (SELECT locus, allele, pos AS src, ch AS src_ch, lead(pos) OVER w AS dst, lead(ch) OVER w AS dst_ch FROM cell WHERE state = 'base' WINDOW w AS (PARTITION BY locus, allele ORDER BY pos)),
edge AS (SELECT locus, src, src_ch, dst, dst_ch, count(DISTINCT allele) AS alleles FROM n WHERE dst IS NOT NULL GROUP BY locus, src, src_ch, dst, dst_ch)"""


@query("gr1_allele_graph", f"{_EDGE} SELECT locus, src, src_ch, dst, dst_ch, alleles FROM edge")
def gr1(spark, sf):
    return G.allele_graph(resolved(spark, sf, "benchmark")).select("locus", "src", "src_ch", "dst", "dst_ch", F.size("alleles").cast("long").alias("alleles"))


@query("gr3_allele_sequence_slice", f"{_D} SELECT locus, allele, string_agg(CASE WHEN state = 'base' THEN ch ELSE '.' END, '' ORDER BY pos) AS seq FROM cell WHERE pos >= 20 AND pos < 60 GROUP BY locus, allele")
def gr3(spark, sf):
    return G.sequence_slice(resolved(spark, sf), 20, 60, pad=True).select("locus", "allele", "seq")


def _slice_sql(cells, seq, start=None, where="TRUE"):
    """Slices along alleles' paths: from ``start`` in one span, or of all spans."""
    own = "TRUE" if start is None else "span = own AND pos >= first"
    bars = "coalesce(crossed, 0)" if start is None else "CASE WHEN pos > first THEN coalesce(crossed, 0) ELSE 0 END"
    return f"""{cells}, k AS (SELECT *, pos - row_number() OVER (PARTITION BY locus, allele ORDER BY pos) AS span FROM cell WHERE state <> 'unknown' AND pos >= {start or 0} AND {where}),
b AS (SELECT *, min(CASE WHEN state = 'base' THEN pos END) OVER (PARTITION BY locus, allele) AS first, min(CASE WHEN state = 'base' THEN span END) OVER (PARTITION BY locus, allele) AS own,
  region_ix - lag(region_ix) OVER (PARTITION BY locus, allele, span ORDER BY pos) AS crossed FROM k),
g AS (SELECT locus, allele, min(first) AS first, string_agg(CASE WHEN state = 'base' THEN ch ELSE '' END, '' ORDER BY pos) AS bare,
  string_agg(concat(repeat('|', {bars}), CASE WHEN state = 'base' THEN ch ELSE '' END), '' ORDER BY pos) AS marked FROM b WHERE first IS NOT NULL AND {own} GROUP BY locus, allele)
SELECT locus, allele, {seq} AS seq FROM g"""


@query("gr3_slice_whole", _slice_sql(_B, "marked"))
def gr3_whole(spark, sf):
    return G.allele_slices(resolved(spark, sf, "benchmark"), marks=True).select("locus", "allele", "seq")


@query("gr3_slice_between", _slice_sql(_D, "CASE WHEN first = 30 THEN bare END", 30, "pos < 120"))
def gr3_between(spark, sf):
    return G.allele_slices(resolved(spark, sf), 30, stop=120).select("locus", "allele", "seq")


@query("gr3_slice_next_length", _slice_sql(_B, "substr(marked, 1, 40)", 30))
def gr3_next(spark, sf):
    return G.allele_slices(resolved(spark, sf, "benchmark"), 30, "next", length=40, marks=True).select("locus", "allele", "seq")


@query("gr3_slice_padded", _slice_sql(_B, "rpad(concat(repeat('.', first - 3), bare), 400, '.')", 3))
def gr3_padded(spark, sf):
    return G.allele_slices(resolved(spark, sf, "benchmark"), 3, "pad", length=400, pad=True).select("locus", "allele", "seq")


@query("gr4_nodes_at", f"{_D} SELECT locus, allele, CASE WHEN state = 'base' THEN ch END AS ch FROM cell WHERE pos = 30")
def gr4(spark, sf):
    return G.nodes_at(resolved(spark, sf), 30).select("locus", "allele", "ch")


_SPAN = f"{_D}, span AS (SELECT locus, allele, CAST(min(pos) AS INT) AS start, CAST(max(pos) + 1 AS INT) AS stop FROM (SELECT *, pos - row_number() OVER (PARTITION BY locus, allele ORDER BY pos) AS g FROM cell WHERE state <> 'unknown') GROUP BY locus, allele, g)"


@query("gr5_alleles_with_data", f"{_SPAN} SELECT DISTINCT locus, allele FROM span WHERE start <= 3 AND stop >= 3")
def gr5(spark, sf):
    return G.alleles_with_data(G.bounds(whole(spark, sf)), 3).select("locus", "allele")


@query("gr6_bounds", f"{_SPAN} SELECT locus, allele, start, stop FROM span")
def gr6(spark, sf):
    return G.bounds(whole(spark, sf)).select("locus", "allele", "start", "stop")


@query("gr7_compressed_starts", f"{_SPAN} SELECT locus, start, string_agg(allele, ';' ORDER BY allele) AS alleles FROM span GROUP BY locus, start")
def gr7(spark, sf):
    return G.starts_by_position(G.bounds(whole(spark, sf))).select("locus", "start", F.array_join("alleles", ";").alias("alleles"))


@query("agg24_starts_by_position", f"{_SPAN} SELECT locus, start, count(*) AS alleles FROM span GROUP BY locus, start")
def agg24(spark, sf):
    return G.starts_by_position(G.bounds(whole(spark, sf))).select("locus", "start", F.size("alleles").cast("long").alias("alleles"))


@query("agg25_alignment_range", f"{_SPAN} SELECT locus, min(start) AS start, max(stop) AS stop FROM span GROUP BY locus")
def agg25(spark, sf):
    return G.alignment_range(G.bounds(whole(spark, sf))).select("locus", "start", "stop")


@query("gr8_subgraph_between", f"{_EDGE} SELECT locus, src, dst, sum(alleles) AS uses FROM edge WHERE src >= 10 AND dst <= 50 GROUP BY locus, src, dst")
def gr8(spark, sf):
    e = G.subgraph_between(G.allele_graph(resolved(spark, sf, "benchmark")), 10, 50)
    return e.groupBy("locus", "src", "dst").agg(F.sum(F.size("alleles")).alias("uses"))


@query("gr9_fold_by_position", f"{_B} SELECT locus, pos, count(DISTINCT ch) AS nodes, string_agg(DISTINCT ch, '' ORDER BY ch) AS letters FROM cell WHERE state = 'base' GROUP BY locus, pos")
def gr9(spark, sf):
    return G.by_position(G.nodes(resolved(spark, sf, "benchmark"))).select("locus", "pos", "nodes", "letters")


@query("gr10_neighbour_through_gap", f"""{_EDGE} SELECT locus, allele, CASE WHEN 29 - src <= dst - 29 THEN src ELSE dst END AS neighbour FROM n WHERE src < 29 AND dst > 29""")
def gr10(spark, sf):
    return G.neighbour_through_gap(G.allele_graph(resolved(spark, sf, "benchmark")), 29).select("locus", "allele", "neighbour")


@query("sc33_position_map", f"{_B} SELECT locus, allele, pos, row_number() OVER (PARTITION BY locus, allele ORDER BY pos) - 1 AS dense FROM cell WHERE state = 'base'")
def sc33(spark, sf):
    return W.position_map(resolved(spark, sf, "benchmark"), ["locus", "allele"]).select("locus", "allele", "pos", F.col("column").alias("dense"))


@query("sc34_in_order_check", "SELECT l_orderkey, count(*) AS wrong FROM (SELECT l_orderkey, l_linenumber * 10 AS start, lag(l_linenumber * 10 + l_partkey % 15) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linenumber * 10 + l_partkey % 15) AS b FROM lineitem) WHERE b > start GROUP BY l_orderkey")
def sc34(spark, sf):
    spans = derive(spark, sf, "SELECT l_orderkey, l_linenumber * 10 AS start, l_linenumber * 10 + l_partkey % 15 AS stop FROM {lineitem}", "lineitem")
    return W.in_order_check(spans, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("wrong"))
