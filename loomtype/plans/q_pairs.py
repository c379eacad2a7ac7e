"""Queries over likelihoods of alleles and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairs as P
from ..operators import select as S
from ..sources.shared import saved
from .registry import SCORES, derive, query, scores, text

_S = f"WITH s AS ({SCORES})"
_PAIRS = f"""{_S}, p AS (SELECT a.read_id, a.locus, a.allele_id AS i, b.allele_id AS j, greatest(a.llhd, b.llhd) AS llhd,
  CASE WHEN a.llhd >= b.llhd THEN a.pos ELSE b.pos END AS pos, CASE WHEN a.llhd = b.llhd THEN 1 WHEN a.llhd > b.llhd THEN 2 ELSE 0 END AS w1,
  CASE WHEN a.llhd = b.llhd THEN 1 WHEN a.llhd > b.llhd THEN 0 ELSE 2 END AS w2
  FROM s a JOIN s b ON a.read_id = b.read_id AND a.locus = b.locus AND a.allele_id <= b.allele_id)"""
_Z = f"{_PAIRS}, z AS (SELECT locus, i, j, CAST(sum(llhd) AS BIGINT) AS z, count(*) AS reads FROM p GROUP BY locus, i, j)"


@query("agg1_allele_log_likelihood", f"{_S} SELECT locus, allele_id, CAST(sum(llhd) AS BIGINT) AS llhd, count(*) AS reads FROM s GROUP BY locus, allele_id")
def agg1(spark, sf):
    return P.allele_log_likelihood(scores(spark, sf))


@query("jn19_allele_pairs", f"{_PAIRS} SELECT read_id, locus, i, j, llhd, pos, w1, w2 FROM p")
def jn19(spark, sf):
    return P.allele_pairs(scores(spark, sf))


@query("agg2_pair_log_likelihood", f"{_Z} SELECT locus, i, j, z, reads FROM z")
def agg2(spark, sf):
    return P.pair_log_likelihood(scores(spark, sf))


_MATES = "SELECT l_orderkey AS read_id, l_suppkey % 5 AS allele_id, 'A' AS locus, -CAST(round(l_extendedprice) AS BIGINT) AS llhd, CAST(l_linenumber AS BIGINT) AS pos FROM lineitem"


@query("agg3_mate_product", f"SELECT read_id, allele_id, CAST(sum(llhd) AS BIGINT) AS llhd, string_agg(CAST(pos AS STRING), ',' ORDER BY pos) AS positions FROM ({_MATES}) GROUP BY read_id, allele_id")
def agg3(spark, sf):
    m = P.mate_product(derive(spark, sf, text(_MATES, "lineitem"), "lineitem"))
    return m.select("read_id", "allele_id", "llhd", F.concat_ws(",", F.transform("positions", lambda x: x.cast("string"))).alias("positions"))


_TOP = f"{_Z}, t AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY locus ORDER BY z DESC) AS r FROM z) WHERE r <= 20)"
_E = f"""{_TOP}, e AS (SELECT p.locus, p.i, p.j, side, pos, CAST(sum(CASE side WHEN 1 THEN w1 ELSE w2 END) AS BIGINT) AS weight
  FROM p JOIN t ON p.locus = t.locus AND p.i = t.i AND p.j = t.j, (VALUES (1), (2)) v(side)
  WHERE CASE side WHEN 1 THEN w1 ELSE w2 END > 0 GROUP BY p.locus, p.i, p.j, side, pos)"""


def _ranked(spark, sf):
    """All pairs, and those of the twenty best ranks, equal ones together."""
    z = saved(P.pair_log_likelihood(scores(spark, sf)))
    return z, P.rank_pairs(z, 20)


@query("agg4_pair_emissions", f"{_E} SELECT locus, i, j, side, pos, weight FROM e")
def agg4(spark, sf):
    return P.pair_emissions(scores(spark, sf), _ranked(spark, sf)[1])


_C = f"""{_E}, g AS (SELECT locus, i, j, side, CAST(sum(weight) AS BIGINT) AS n, sum(lgamma(weight + 1.0) / ln(10.0)) AS fws FROM e GROUP BY locus, i, j, side),
c AS (SELECT locus, i, j, sum(lgamma(n + 1.0) / ln(10.0) - n * log10(3000.0) - fws) AS c FROM g GROUP BY locus, i, j)"""


@query("agg5_coverage_likelihood", f"{_C} SELECT locus, i, j, round(c, 4) AS c FROM c")
def agg5(spark, sf):
    c = P.coverage_likelihood(P.pair_emissions(scores(spark, sf), _ranked(spark, sf)[1]), 3000)
    return c.select("locus", "i", "j", F.round("c", 4).alias("c"))


def _post(c: str) -> str:
    """The posterior in SQL; pairs that ``c`` doesn't hold were cut, and count with the least chance of those it holds."""
    return f"""{c}, q AS (SELECT z.locus, z.i, z.j, z.z / 1000.0 / reads AS z, c / 100 AS c FROM z JOIN c ON z.locus = c.locus AND z.i = c.i AND z.j = c.j),
n AS (SELECT locus, count(*) AS n FROM z GROUP BY locus), m AS (SELECT q.*, n, max(z + c) OVER (PARTITION BY q.locus) AS m, count(*) OVER (PARTITION BY q.locus) AS kept FROM q JOIN n ON q.locus = n.locus),
post AS (SELECT locus, i, j, z, c, pow(10.0, z + c - m) / (sum(pow(10.0, z + c - m)) OVER (PARTITION BY locus) + (n - kept) * min(pow(10.0, z + c - m)) OVER (PARTITION BY locus)) AS prob FROM m)"""


_POST, _ALL = _post(_C), _post(_C.replace("WHERE r <= 20", ""))


def _posterior(spark, sf):
    z, top = _ranked(spark, sf)
    c = P.coverage_likelihood(P.pair_emissions(scores(spark, sf), top), 3000).select("locus", "i", "j", (F.col("c") / 100).alias("c"))
    return P.pair_posterior(z.select("locus", "i", "j", (F.col("z") / 1000.0 / F.col("reads")).alias("z")), c)


@query("agg6_pair_posterior", f"{_POST} SELECT locus, i, j, round(z, 4) AS z, round(c, 4) AS c, round(prob, 4) AS prob FROM post")
def agg6(spark, sf):
    return _posterior(spark, sf).select("locus", "i", "j", F.round("z", 4).alias("z"), F.round("c", 4).alias("c"), F.round("prob", 4).alias("prob"))


# every pair is evaluated
@query("flt14_non_zero_posterior", f"{_ALL} SELECT locus, i, j FROM post WHERE prob > 0.001")
def flt14(spark, sf):
    every = saved(P.evaluated_pairs(scores(spark, sf), 3000).select("locus", "i", "j", (F.col("z") / 1000.0 / F.col("reads")).alias("z"), (F.col("c") / 100).alias("c")))
    return S.non_zero_posterior(P.pair_posterior(every), 1e-3).select("locus", "i", "j")


@query("srt4_top_pairs", f"{_POST} SELECT locus, i, j FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY prob DESC, i, j) AS r FROM post) WHERE r <= 3")
def srt4(spark, sf):
    return P.top_pairs(_posterior(spark, sf), size=3).select("locus", "i", "j")


@query("srt5_most_likely_pair", f"{_POST} SELECT locus, i, j FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY prob DESC, i, j) AS r FROM post) WHERE r = 1")
def srt5(spark, sf):
    return P.most_likely_pair(_posterior(spark, sf)).select("locus", "i", "j")


@query("jn20_assign_read_to_allele", f"""{_POST}, o AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY prob DESC, i, j) AS r FROM post),
a AS (SELECT locus, allele_id, min(r * 2 + side) AS spot FROM (SELECT locus, i AS allele_id, r, 0 AS side FROM o UNION ALL SELECT locus, j, r, 1 FROM o) GROUP BY locus, allele_id)
SELECT read_id, locus, allele_id, llhd FROM (SELECT s.*, row_number() OVER (PARTITION BY read_id ORDER BY llhd DESC, spot, s.locus) AS r
  FROM s JOIN a ON s.locus = a.locus AND s.allele_id = a.allele_id) WHERE r = 1""")
def jn20(spark, sf):
    return P.assign_reads(scores(spark, sf), _posterior(spark, sf))


@query("agg8_log10_sum", f"{_S} SELECT locus, allele_id, round(m + log10(sum(pow(10.0, llhd / 1e4 - m))), 6) AS total FROM (SELECT *, max(llhd / 1e4) OVER (PARTITION BY locus, allele_id) AS m FROM s) GROUP BY locus, allele_id, m")
def agg8(spark, sf):
    m = F.max(F.col("llhd") / 1e4).alias("m")
    tops = scores(spark, sf).groupBy("locus", "allele_id").agg(m)
    both = scores(spark, sf).join(tops, ["locus", "allele_id"])
    return both.groupBy("locus", "allele_id", "m").agg(F.sum(F.pow(F.lit(10.0), F.col("llhd") / 1e4 - F.col("m"))).alias("s")).select(
        "locus", "allele_id", F.round(F.col("m") + F.log10("s"), 6).alias("total"))


@query("agg9_median_match", f"""{_S}, r AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY llhd, allele_id) AS r, count(*) OVER (PARTITION BY read_id) AS n FROM s)
SELECT read_id, llhd AS median FROM r WHERE r = greatest(n // 2, 1)""")
def agg9(spark, sf):
    from ..operators.windows import low_median

    return low_median(scores(spark, sf), ["read_id"], "llhd", "allele_id").select("read_id", F.col("llhd").alias("median"))


_LOCI = "SELECT l_orderkey AS read_id, chr(65 + CAST(l_suppkey % 3 AS INT)) AS locus, l_suppkey AS allele_id, max(-CAST(round(l_extendedprice) AS BIGINT)) AS llhd, max(l_linenumber) > 4 AS paired, max(l_quantity) > 49 AS bad, min(l_partkey) % 2 = 1 AS rc FROM lineitem GROUP BY l_orderkey, l_suppkey"
_LOCI_SPARK = text(_LOCI, "lineitem")


def _loci(spark, sf):
    return derive(spark, sf, _LOCI_SPARK, "lineitem").withColumn("filter_reason", F.when(F.col("bad"), F.lit("threshold")))


@query("agg10_best_locus_per_read", f"SELECT read_id, locus, allele_id, llhd FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY bad, paired DESC, llhd DESC, locus, allele_id) AS r FROM ({_LOCI})) WHERE r = 1")
def agg10(spark, sf):
    return P.best_locus(_loci(spark, sf)).select("read_id", "locus", "allele_id", "llhd")


@query("agg11_best_orientation", f"""WITH l AS ({_LOCI}), b AS (SELECT read_id, locus, rc FROM (SELECT *, row_number() OVER (PARTITION BY read_id, locus ORDER BY bad, llhd DESC, rc, allele_id) AS r FROM l) WHERE r = 1)
SELECT l.read_id, l.locus, l.allele_id, l.rc, l.llhd FROM l JOIN b ON l.read_id = b.read_id AND l.locus = b.locus AND l.rc = b.rc""")
def agg11(spark, sf):
    return P.best_orientation(_loci(spark, sf)).select("read_id", "locus", "allele_id", "rc", "llhd")


@query("agg23_number_of_reads", f"{_E} SELECT locus, i, j, side, sum(weight) / 2 AS reads FROM e GROUP BY locus, i, j, side")
def agg23(spark, sf):
    return P.number_of_reads(P.pair_emissions(scores(spark, sf), _ranked(spark, sf)[1]))


@query("win5_rank_alleles", f"{_S} SELECT read_id, locus, allele_id, llhd, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY read_id, locus ORDER BY llhd DESC, allele_id) AS INT) AS rank FROM s) WHERE rank <= 3")
def win5(spark, sf):
    return P.rank_alleles(scores(spark, sf), 3).select("read_id", "locus", "allele_id", "llhd", "rank")


@query("win6_rank_pairs", f"{_Z} SELECT locus, i, j, z, rank FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY locus ORDER BY z DESC) AS INT) AS rank FROM z) WHERE rank <= 10")
def win6(spark, sf):
    return P.rank_pairs(P.pair_log_likelihood(scores(spark, sf)), 10).select("locus", "i", "j", "z", "rank")


@query("srt2_allele_report_order", f"{_S}, a AS (SELECT locus, allele_id, sum(llhd) AS v FROM s GROUP BY locus, allele_id) SELECT locus, allele_id, row_number() OVER (PARTITION BY locus ORDER BY v DESC, allele_id) AS place FROM a")
def srt2(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("locus").orderBy(F.desc("llhd"), "allele_id")
    return P.allele_log_likelihood(scores(spark, sf)).select("locus", "allele_id", F.row_number().over(w).alias("place"))


@query("srt3_top_n", f"{_S} SELECT read_id, allele_id, llhd FROM s ORDER BY llhd DESC, read_id, allele_id LIMIT 25")
def srt3(spark, sf):
    return scores(spark, sf).orderBy(F.desc("llhd"), "read_id", "allele_id").limit(25).select("read_id", "allele_id", "llhd")


@query("snk7_report_depth", f"{_S} SELECT read_id, allele_id FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY llhd DESC, allele_id) AS r FROM s) WHERE r <= 2")
def snk7(spark, sf):
    return P.report_depth(scores(spark, sf), 2, ["read_id"], [F.desc("llhd"), "allele_id"]).select("read_id", "allele_id")


@query("flt17_read_window_filter", f"{_S} SELECT read_id, allele_id, pos FROM s WHERE pos > 1 AND pos < 4")
def flt17(spark, sf):
    return S.in_window(scores(spark, sf), 1, 4).select("read_id", "allele_id", "pos")


@query("jn27_compare_read_to_alleles", f"""{_S}, x AS (SELECT read_id, max(CASE WHEN allele_id % 2 = 0 THEN llhd END) AS a, max(CASE WHEN allele_id % 2 = 1 THEN llhd END) AS b FROM s GROUP BY read_id)
SELECT read_id, a, b, CASE WHEN a = b THEN 'E' WHEN a < b THEN 'L' WHEN a > b THEN 'G' END AS flag FROM x""")
def jn27(spark, sf):
    from ..operators.compare import compare_two

    named = scores(spark, sf).withColumn("allele", F.when(F.col("allele_id") % 2 == 0, "a").otherwise("b"))
    return compare_two(named, "a", "b")


@query("agg17_reads_by_locus", f"{_S} SELECT locus, count(DISTINCT read_id) AS reads FROM s GROUP BY locus")
def agg17(spark, sf):
    from ..operators.compare import reads_by_locus

    return reads_by_locus(P.best_locus(scores(spark, sf))).groupBy("locus").agg(F.count("*").alias("reads"))


@query("agg18_read_intervals", f"{_S} SELECT read_id, allele_id, pos * 1000 - 100 AS start, pos * 1000 AS stop FROM s")
def agg18(spark, sf):
    from ..operators.compare import read_intervals

    return read_intervals(scores(spark, sf).withColumn("pos", F.col("pos") * 1000)).select("read_id", "allele_id", "start", "stop")


@query("agg21_spearman_check", f"""{_S}, x AS (SELECT read_id, max(llhd) AS a, min(llhd) AS b, locus FROM s GROUP BY read_id, locus),
r AS (SELECT locus, rank() OVER (PARTITION BY locus ORDER BY a) + (count(*) OVER (PARTITION BY locus, a) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY locus ORDER BY b) + (count(*) OVER (PARTITION BY locus, b) - 1) / 2.0 AS rb FROM x)
SELECT locus, round(corr(ra, rb), 6) AS rho FROM r GROUP BY locus""")
def agg21(spark, sf):
    from ..operators.compare import spearman

    x = scores(spark, sf).groupBy("read_id", "locus").agg(F.max("llhd").alias("a"), F.min("llhd").alias("b"))
    return spearman(x, ["locus"], "a", "b").select("locus", F.round("rho", 6).alias("rho"))


@query("hm10_per_read_metrics", f"{_S} SELECT read_id, llhd, pos FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY llhd DESC, locus, allele_id) AS r FROM s) WHERE r = 1")
def hm10(spark, sf):
    return P.best_locus(scores(spark, sf)).select("read_id", "llhd", "pos")


def flagship(spark, sf):
    """The posterior over allele pairs with its members' likelihoods: 20 ranks reported, all pairs in the norm."""
    s = scores(spark, sf)
    z = P.pair_log_likelihood(s)
    c = P.coverage_likelihood(P.pair_emissions(s, P.rank_pairs(z, 20)), 3000).select("locus", "i", "j", (F.col("c") / 100).alias("c"))
    return P.pair_posterior(z.select("locus", "i", "j", (F.col("z") / 1000.0 / F.col("reads")).alias("z")), c)


_MATE = """SELECT l_orderkey AS read_id, chr(65 + CAST(l_suppkey % 2 AS INT)) AS locus, l_suppkey AS allele_id, CAST(1 + l_linenumber % 2 AS INT) AS mate, l_partkey % 2 = 1 AS rc,
  max(-CAST(round(l_extendedprice) AS BIGINT)) AS llhd, max(l_quantity) > 45 AS bad FROM lineitem GROUP BY 1, 2, 3, 4, 5"""
_ONE = "row_number() OVER (PARTITION BY read_id, locus ORDER BY bad, llhd DESC, rc, allele_id) AS r"


@query("jn18_second_mate_orientation", f"""WITH l AS ({_MATE}), b1 AS (SELECT read_id, locus, rc FROM (SELECT *, {_ONE} FROM l WHERE mate = 1) WHERE r = 1),
o1 AS (SELECT l.* FROM l JOIN b1 ON l.read_id = b1.read_id AND l.locus = b1.locus AND l.rc = b1.rc WHERE mate = 1), f AS (SELECT DISTINCT read_id, locus, rc FROM o1 WHERE NOT bad),
s AS (SELECT l.* FROM l LEFT JOIN f ON l.read_id = f.read_id AND l.locus = f.locus WHERE mate = 2 AND (f.rc IS NULL OR l.rc <> f.rc)),
b2 AS (SELECT read_id, locus, rc FROM (SELECT *, {_ONE} FROM s) WHERE r = 1), o2 AS (SELECT s.* FROM s JOIN b2 ON s.read_id = b2.read_id AND s.locus = b2.locus AND s.rc = b2.rc)
SELECT read_id, locus, allele_id, mate, rc, llhd FROM o1 UNION ALL SELECT read_id, locus, allele_id, mate, rc, llhd FROM o2""")
def jn18(spark, sf):
    from ..operators.score import second_mate_scores

    rows = derive(spark, sf, text(_MATE, "lineitem"), "lineitem").withColumn("filter_reason", F.when(F.col("bad"), F.lit("threshold")))
    return second_mate_scores(rows).select("read_id", "locus", "allele_id", "mate", "rc", "llhd")
