"""Queries over genomic and coding alignments of the same alleles, their merging, and projections of zipped columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rings import RINGS
from ..functions.values import letters
from ..operators import graph as G
from ..operators import msa as M
from ..operators import select as S
from ..sources.shared import saved
from .q_align import _B, _D, _LETTERS, _REF, resolved, streams, whole
from .registry import NAMES, derive, names, query

# Every text is an allele of regions of 50 letters: UTR5, exon 1, intron 1, exon 2, ... Every fourth has coding data only.
_ONLY_CODING = "(id // 3) % 4 = 3"
_X = f"""WITH x AS (SELECT concat('L', item_id % 3) AS locus, item_id AS id, {_LETTERS.format(g=", 'g'")} AS seq FROM benchmark WHERE text IS NOT NULL),
r AS (SELECT locus, min(id) AS ref FROM x WHERE seq <> '' GROUP BY locus), c AS (SELECT x.locus, concat('D', id) AS allele, id, id = ref AS is_ref, unnest(range(1, length(seq) + 1)) AS x, unnest(string_split(seq, '')) AS c FROM x JOIN r ON x.locus = r.locus),
gen AS (SELECT locus, allele, id, is_ref, x, (x - 1) // 50 AS region, CASE WHEN is_ref THEN c WHEN x <= id % 7 THEN '*' WHEN (id + x) % 29 = 0 THEN '.' ELSE c END AS ch FROM c WHERE NOT {_ONLY_CODING}),
nuc AS (SELECT locus, allele, id, is_ref, x, (x - 1) // 50 AS region, CASE WHEN is_ref THEN c WHEN (id + x) % 31 = 0 THEN '.' ELSE c END AS ch FROM c WHERE (x - 1) // 50 % 2 = 1),
twice AS (SELECT DISTINCT g.locus, g.allele FROM gen g JOIN nuc n ON g.locus = n.locus AND g.allele = n.allele),
ends AS (SELECT locus, max(region) AS last FROM gen GROUP BY locus),
merged AS (SELECT n.locus, n.allele, n.is_ref, n.x, n.region, n.ch FROM nuc n JOIN twice USING (locus, allele) JOIN ends e ON n.locus = e.locus AND n.region <= e.last
  UNION ALL SELECT g.locus, g.allele, g.is_ref, g.x, g.region, g.ch FROM gen g JOIN twice USING (locus, allele) WHERE g.region % 2 = 0)"""


def _stream(rows, source, gap, start, begins_unknown=False):
    """One stream an allele: the reference's letters as dashes, gaps where (id + place) is a multiple of ``gap``."""
    head = rows.groupBy("locus").agg(F.min("id").alias("ref"), F.min_by("seq", "id").alias("ref_seq"))
    both = rows.join(head, "locus")

    def cell(x, i0):
        i = i0 + 1
        unknown = (i <= F.col("id") % 7) if source == "gen" else _begins_unknown(i) if begins_unknown else F.lit(False)
        return F.when(x["c"].isNull(), "").when(F.col("id") == F.col("ref"), x["c"]).when(unknown, "*").when((F.col("id") + i) % gap == 0, ".").when(x["c"] == x["r"], "-").otherwise(x["c"])

    cells = F.transform(F.arrays_zip(letters(F.col("seq")).alias("c"), letters(F.col("ref_seq")).alias("r")), cell)
    count = F.ceil(F.length("seq") / 50).cast("int")
    regions = F.transform(F.sequence(F.lit(0), count - 1), lambda r: F.array_join(F.slice(cells, r * 50 + 1, F.lit(50)), ""))
    if source == "nuc":
        regions = F.filter(regions, lambda _, r: r % 2 == 1)
    return both.select("locus", F.lit(source).alias("source"), F.concat(F.lit("D"), F.col("id").cast("string")).alias("allele"), (F.col("id") == F.col("ref")).alias("is_ref"),
                       F.lit(start).alias("start_pos"), F.array_join(regions, "|").alias("stream")).where("stream <> ''")


def _begins_unknown(i):
    """The first letters of exon 1 of alleles with coding data only."""
    return (F.expr("(id div 3) % 4 = 3")) & (i > 50) & (i <= 50 + F.col("id") % 5)


def _texts(spark, sf):
    return derive(spark, sf, f"SELECT concat('L', item_id % 3) AS locus, item_id AS id, {_LETTERS.format(g='')} AS seq FROM {{benchmark}} WHERE text IS NOT NULL", "benchmark").where("seq <> ''")


def _gen(spark, sf):
    rows = _texts(spark, sf).where("(id div 3) % 4 <> 3")
    return saved(M.resolve_to_reference(M.parse_streams(_stream(rows, "gen", 29, -49))))


def _nuc(spark, sf, begins_unknown=False):
    return saved(M.resolve_to_reference(M.parse_streams(_stream(_texts(spark, sf), "nuc", 31, 1, begins_unknown))))


@query("jn15_merge_gen_nuc", f"{_X} SELECT locus, allele, md5(string_agg(ch, '' ORDER BY x) FILTER (ch NOT IN ('.', '*'))) AS digest, count(*) AS cells, max(x) - 1 AS last FROM merged GROUP BY locus, allele")
def jn15(spark, sf):
    m = M.merge_gen_nuc(_gen(spark, sf), _nuc(spark, sf))
    return _digests(m)


def _digests(rows):
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("state") == "base", F.col("ch")).otherwise("").alias("c"))))
    return rows.groupBy("locus", "allele").agg(F.md5(F.array_join(F.transform(ordered, lambda x: x["c"]), "")).alias("digest"), F.count("*").alias("cells"), F.max("pos").cast("long").alias("last"))


@query("jn16_merge_nearest_donor", f"""{_X}, seg AS (SELECT a.locus, a.allele AS target, b.allele AS candidate, a.region, count(*) FILTER (a.ch <> b.ch) AS m FROM nuc a JOIN nuc b ON a.locus = b.locus AND a.x = b.x AND a.allele <> b.allele GROUP BY a.locus, a.allele, b.allele, a.region),
len AS (SELECT locus, region, count(*) AS len FROM nuc WHERE is_ref GROUP BY locus, region), d AS (SELECT s.locus, target, candidate, sum(m * len) / sum(len) AS distance FROM seg s JOIN len l ON s.locus = l.locus AND s.region = l.region GROUP BY s.locus, target, candidate),
donor AS (SELECT d.locus, target, candidate FROM (SELECT d.*, row_number() OVER (PARTITION BY d.locus, target ORDER BY distance, candidate) AS k FROM d JOIN twice b ON d.locus = b.locus AND d.candidate = b.allele
  WHERE NOT EXISTS (SELECT 1 FROM twice t WHERE t.locus = d.locus AND t.allele = d.target)) d WHERE k = 1),
given AS (SELECT o.locus, target AS allele, m.x, m.ch FROM donor o JOIN merged m ON o.locus = m.locus AND o.candidate = m.allele),
own AS (SELECT n.locus, n.allele, n.x, n.ch FROM nuc n JOIN donor o ON n.locus = o.locus AND n.allele = o.target JOIN ends e ON n.locus = e.locus AND n.region <= e.last),
taken AS (SELECT coalesce(n.locus, m.locus) AS locus, coalesce(n.allele, m.allele) AS allele, coalesce(n.x, m.x) AS x, coalesce(CASE WHEN n.ch <> '*' THEN n.ch END, m.ch, n.ch) AS ch
  FROM own n FULL OUTER JOIN given m ON n.locus = m.locus AND n.allele = m.allele AND n.x = m.x),
full_ AS (SELECT locus, allele, x, ch FROM merged UNION ALL SELECT locus, allele, x, ch FROM taken)
SELECT locus, allele, md5(string_agg(ch, '' ORDER BY x) FILTER (ch NOT IN ('.', '*'))) AS digest, count(*) AS cells, max(x) - 1 AS last FROM full_ GROUP BY locus, allele""")
def jn16(spark, sf):
    return _completed(spark, sf, _nuc(spark, sf))


def _completed(spark, sf, nuc):
    gen = _gen(spark, sf)
    segments = saved(M.merge_segments(gen, nuc))
    return _digests(M.merge_nearest_donor(M.merge_gen_nuc(gen, nuc, segments), nuc, M.weighted_distances(nuc), segments))


# As before, with exons that begin unknown: regions that are not whole take no part in distances, and only the reference
# is compared with an allele whose whole regions are others than its own.
_Y = _X.replace("CASE WHEN is_ref THEN c WHEN (id + x) % 31 = 0 THEN '.' ELSE c END AS ch FROM c WHERE (x - 1) // 50 % 2 = 1",
                f"CASE WHEN is_ref THEN c WHEN {_ONLY_CODING} AND x > 50 AND x <= 50 + id % 5 THEN '*' WHEN (id + x) % 31 = 0 THEN '.' ELSE c END AS ch FROM c WHERE (x - 1) // 50 % 2 = 1")


@query("jn16_merge_partial_exons", f"""{_Y}, seg AS (SELECT a.locus, a.allele AS target, b.allele AS candidate, a.region, count(*) FILTER (a.ch <> b.ch AND a.ch <> '*' AND b.ch <> '*') AS m,
  count(*) FILTER (a.ch = '*') = 0 AS ta, count(*) FILTER (b.ch = '*') = 0 AS tb, bool_or(b.is_ref) AS ref FROM nuc a JOIN nuc b ON a.locus = b.locus AND a.x = b.x AND a.allele <> b.allele GROUP BY a.locus, a.allele, b.allele, a.region),
len AS (SELECT locus, region, count(*) AS len FROM nuc WHERE is_ref GROUP BY locus, region),
d AS (SELECT s.locus, target, candidate, sum(CASE WHEN ta THEN m * len END) / sum(CASE WHEN ta THEN len END) AS distance FROM seg s JOIN len l ON s.locus = l.locus AND s.region = l.region GROUP BY s.locus, target, candidate
  HAVING (bool_and(ta = tb) OR bool_or(ref)) AND sum(CASE WHEN ta THEN len END) > 0),
donor AS (SELECT d.locus, target, candidate FROM (SELECT d.*, row_number() OVER (PARTITION BY d.locus, target ORDER BY distance, candidate) AS k FROM d JOIN twice b ON d.locus = b.locus AND d.candidate = b.allele
  WHERE NOT EXISTS (SELECT 1 FROM twice t WHERE t.locus = d.locus AND t.allele = d.target)) d WHERE k = 1),
given AS (SELECT o.locus, target AS allele, m.x, m.ch FROM donor o JOIN merged m ON o.locus = m.locus AND o.candidate = m.allele),
own AS (SELECT n.locus, n.allele, n.x, n.ch FROM nuc n JOIN donor o ON n.locus = o.locus AND n.allele = o.target JOIN ends e ON n.locus = e.locus AND n.region <= e.last),
taken AS (SELECT coalesce(n.locus, m.locus) AS locus, coalesce(n.allele, m.allele) AS allele, coalesce(n.x, m.x) AS x, coalesce(CASE WHEN n.ch <> '*' THEN n.ch END, m.ch, n.ch) AS ch
  FROM own n FULL OUTER JOIN given m ON n.locus = m.locus AND n.allele = m.allele AND n.x = m.x),
full_ AS (SELECT locus, allele, x, ch FROM merged UNION ALL SELECT locus, allele, x, ch FROM taken)
SELECT locus, allele, md5(string_agg(ch, '' ORDER BY x) FILTER (ch NOT IN ('.', '*'))) AS digest, count(*) AS cells, max(x) - 1 AS last FROM full_ GROUP BY locus, allele""")
def jn16_partial(spark, sf):
    return _completed(spark, sf, _nuc(spark, sf, begins_unknown=True))


@query("prj2_genomic_to_exons", f"{_X} SELECT locus, allele, count(*) AS cells, CAST(max(region) AS INT) AS last_region FROM gen WHERE region % 2 = 1 GROUP BY locus, allele")
def prj2b(spark, sf):
    return S.strip_to_exons(_gen(spark, sf)).groupBy("locus", "allele").agg(F.count("*").alias("cells"), F.max("region_ix").alias("last_region"))


@query("prj1_genomic_regions", f"""{_X} SELECT g.locus, CAST(region AS INT) AS region_ix, CASE WHEN region = 0 THEN 'UTR5' WHEN region = last AND region % 2 = 0 THEN 'UTR3' WHEN region % 2 = 1 THEN 'Exon' ELSE 'Intron' END AS region_kind, count(*) AS cells
FROM gen g JOIN ends e ON g.locus = e.locus GROUP BY g.locus, region, last""")
def prj1b(spark, sf):
    return _gen(spark, sf).groupBy("locus", "region_ix", "region_kind").agg(F.count("*").alias("cells"))


@query("ud3_projection", f"""{_D}, {_REF} SELECT c.locus, allele, region_ix, count(*) FILTER (state <> 'unknown' AND concat(ch, coalesce(r, '.')) IN ('AG', 'GA', 'CT', 'TC')) AS transitions
FROM cell c LEFT JOIN ref ON c.locus = ref.locus AND c.pos = ref.pos WHERE NOT is_ref GROUP BY c.locus, allele, region_ix""")
def ud3(spark, sf):
    swap = lambda own, other: F.concat(own, other).isin("AG", "GA", "CT", "TC")
    return M.segment_distance_to_reference(whole(spark, sf), swap, streams(spark, sf, refs=True)).select("locus", "allele", "region_ix", F.col("mismatches").alias("transitions"))


_P = "(l_quantity + 1) / 100"


@query("ud4_probability_ring", f"""SELECT l_orderkey, round(product({_P}), 9) AS plain, round(sum(ln({_P})), 9) AS ln, round(sum(log10({_P})), 9) AS log10,
round(sum({_P}), 9) AS plain_total, round(ln(sum({_P})), 9) AS ln_total, round(log10(sum({_P})), 9) AS log10_total FROM lineitem GROUP BY l_orderkey""")
def ud4(spark, sf):
    rows = derive(spark, sf, f"SELECT l_orderkey, {_P} AS p FROM {{lineitem}}", "lineitem")
    out = None
    for name, ring in RINGS.items():
        own = rows.select("l_orderkey", ring.of(F.col("p")).alias("v"))
        one = own.groupBy("l_orderkey").agg(F.round(ring.product(F.col("v")), 9).alias(name)).join(
            ring.total(own, ["l_orderkey"], "v", "t").select("l_orderkey", F.round("t", 9).alias(f"{name}_total")), "l_orderkey")
        out = one if out is None else out.join(one, "l_orderkey")
    return out


@query("srt6_longest_first", f"""{_B}, k AS (SELECT locus, allele, count(*) FILTER (state = 'base') AS known, count(*) FILTER (state = 'unknown') AS unknown FROM cell GROUP BY locus, allele)
SELECT locus, allele, known, row_number() OVER (PARTITION BY locus ORDER BY known DESC, allele) AS place FROM k WHERE unknown > 0""")
def srt6(spark, sf):
    return M.longest_first(resolved(spark, sf, "benchmark")).select("locus", "allele", "known", F.col("place").cast("long").alias("place"))


@query("gr1_terminal_nodes", f"""{_B}, i AS (SELECT *, pos - row_number() OVER (PARTITION BY locus, allele ORDER BY pos) AS g FROM cell WHERE state <> 'unknown'),
s AS (SELECT locus, allele, min(pos) AS start, max(pos) + 1 AS stop FROM i GROUP BY locus, allele, g),
b AS (SELECT locus, allele, pos FROM (SELECT *, lag(region_ix) OVER w AS p, lag(pos) OVER w AS q FROM i WINDOW w AS (PARTITION BY locus, allele ORDER BY pos)) WHERE p <> region_ix AND q = pos - 1),
n AS (SELECT locus, 'S' AS kind, start AS pos, allele FROM s UNION ALL SELECT locus, 'E', stop, allele FROM s UNION ALL SELECT locus, 'B', pos, allele FROM b)
SELECT locus, kind, pos, string_agg(DISTINCT allele, ';' ORDER BY allele) AS alleles FROM n GROUP BY locus, kind, pos""")
def gr1b(spark, sf):
    return G.terminal_nodes(resolved(spark, sf, "benchmark")).select("locus", "kind", "pos", F.array_join("alleles", ";").alias("alleles"))


@query("gr2_join_same_paths", f"""WITH RECURSIVE {_B[5:]}, n AS (SELECT locus, allele, pos AS src, ch AS src_ch, lead(pos) OVER w AS dst, lead(ch) OVER w AS dst_ch FROM cell WHERE state = 'base' WINDOW w AS (PARTITION BY locus, allele ORDER BY pos)),
e AS (SELECT locus, src, src_ch, dst, dst_ch, string_agg(DISTINCT allele, ';' ORDER BY allele) AS als FROM n WHERE dst IS NOT NULL GROUP BY locus, src, src_ch, dst, dst_ch),
o AS (SELECT locus, src AS pos, src_ch AS ch, count(*) AS ways FROM e GROUP BY locus, src, src_ch), w AS (SELECT locus, dst AS pos, dst_ch AS ch, count(*) AS ways FROM e GROUP BY locus, dst, dst_ch),
t AS (SELECT o.locus, o.pos, o.ch FROM o JOIN w ON o.locus = w.locus AND o.pos = w.pos AND o.ch = w.ch WHERE o.ways = 1 AND w.ways = 1),
link AS (SELECT a.locus, a.als, b.src, b.src_ch, b.dst, b.dst_ch FROM e a JOIN e b ON a.locus = b.locus AND a.als = b.als AND a.dst = b.src AND a.dst_ch = b.src_ch JOIN t ON t.locus = b.locus AND t.pos = b.src AND t.ch = b.src_ch),
p(locus, als, first, dst, dst_ch, letters) AS (SELECT e.locus, e.als, e.src, e.dst, e.dst_ch, e.src_ch FROM e LEFT JOIN link l ON e.locus = l.locus AND e.als = l.als AND e.src = l.src AND e.src_ch = l.src_ch AND e.dst = l.dst AND e.dst_ch = l.dst_ch WHERE l.src IS NULL
  UNION ALL SELECT p.locus, p.als, p.first, l.dst, l.dst_ch, concat(p.letters, l.src_ch) FROM p JOIN link l ON p.locus = l.locus AND p.als = l.als AND p.dst = l.src AND p.dst_ch = l.src_ch),
whole AS (SELECT p.* FROM p LEFT JOIN link l ON p.locus = l.locus AND p.als = l.als AND p.dst = l.src AND p.dst_ch = l.src_ch WHERE l.src IS NULL),
f AS (SELECT w.* FROM w LEFT JOIN o ON w.locus = o.locus AND w.pos = o.pos AND w.ch = o.ch WHERE o.ch IS NULL)
SELECT a.locus, CAST(first AS INT) AS src, CAST(dst AS INT) AS stop, concat(letters, CASE WHEN f.ways = 1 THEN f.ch ELSE '' END) AS letters, a.als AS alleles FROM whole a LEFT JOIN f ON a.locus = f.locus AND a.dst = f.pos AND a.dst_ch = f.ch
UNION ALL SELECT f.locus, CAST(f.pos AS INT), CAST(f.pos AS INT), f.ch, string_agg(DISTINCT n.allele, ';' ORDER BY n.allele) FROM f JOIN n ON n.locus = f.locus AND n.dst = f.pos AND n.dst_ch = f.ch WHERE f.ways > 1 GROUP BY f.locus, f.pos, f.ch""")
def gr2(spark, sf):
    return G.join_same_paths(G.allele_graph(resolved(spark, sf, "benchmark"))).select("locus", "src", "stop", "letters", F.array_join("alleles", ";").alias("alleles"))


_RANK = "SELECT *, rank() OVER (PARTITION BY locus, target ORDER BY CASE WHEN t{i} > 0 THEN abs(f{i} - t{i}) ELSE f{i} END, CASE WHEN t{i} > 0 THEN f{i} ELSE 0 END DESC) AS r{i} FROM {before}"


@query("jn9_distance_trie", f"""WITH n AS (SELECT DISTINCT locus, allele, f1, f2, f3, f4 FROM ({NAMES})),
p AS (SELECT t.locus, t.allele AS target, c.allele AS candidate, t.f1 AS t1, t.f2 AS t2, t.f3 AS t3, t.f4 AS t4, c.f1, c.f2, c.f3, c.f4 FROM n t JOIN n c ON t.locus = c.locus AND t.allele <> c.allele),
a AS ({_RANK.format(i=1, before='p')}), b AS ({_RANK.format(i=2, before='a WHERE r1 = 1')}), c AS ({_RANK.format(i=3, before='b WHERE r2 = 1')}), d AS ({_RANK.format(i=4, before='c WHERE r3 = 1')})
SELECT locus, target, min(candidate) AS candidate, CAST(1 AS DOUBLE) AS distance FROM d WHERE r4 = 1 GROUP BY locus, target""")
def jn9(spark, sf):
    return M.compute_distances("trie", alleles=names(spark, sf).dropDuplicates(["allele"]))
