"""Queries over evaluation: truth from orders, calls from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..sources.shared import saved
from .registry import derive, query, text

_TRUTH = "SELECT CAST(o_custkey AS STRING) AS sample, o_orderpriority AS locus, CAST(1 + o_orderkey % 4 AS INT) AS f1, CAST(1 + o_orderkey % 3 AS INT) AS f2 FROM orders"
_CALLS = """SELECT CAST(o_custkey AS STRING) AS sample, o_orderpriority AS locus, CAST(1 + l_partkey % 4 AS INT) AS a1, CAST(1 + l_partkey % 3 AS INT) AS a2,
  CAST(1 + l_suppkey % 4 AS INT) AS b1, CAST(1 + l_suppkey % 3 AS INT) AS b2, max(CAST(l_quantity * 100 AS BIGINT) * 1000 + l_partkey % 1000) AS prob
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4, 5, 6"""


def _name(a, b):
    return F.struct(F.col(a).alias("f1"), F.col(b).alias("f2"), F.lit(0).alias("f3"), F.lit(0).alias("f4"))


def _truth(spark, sf):
    return derive(spark, sf, text(_TRUTH, "orders"), "orders").select("sample", "locus", _name("f1", "f2").alias("allele"))


def _calls(spark, sf):
    c = derive(spark, sf, text(_CALLS, "lineitem", "orders"), "lineitem", "orders")
    return E.called_diploids(c.select("sample", "locus", _name("a1", "a2").alias("allele1"), _name("b1", "b2").alias("allele2"), "prob"))


_T = f"""WITH t0 AS ({_TRUTH}), t AS (SELECT sample, locus, min(row(f1, f2)) AS tl, max(row(f1, f2)) AS tu FROM t0 GROUP BY sample, locus HAVING count(*) = 2)"""
_J = f"""{_T}, c0 AS ({_CALLS}), c AS (SELECT sample, locus, least(row(a1, a2), row(b1, b2)) AS cl, greatest(row(a1, a2), row(b1, b2)) AS cu, prob FROM c0),
j AS (SELECT c.*, tl, tu, row(abs(tl[1] - cl[1]), abs(tl[2] - cl[2])) AS s1, row(abs(tu[1] - cu[1]), abs(tu[2] - cu[2])) AS s2,
  row(abs(tl[1] - cu[1]), abs(tl[2] - cu[2])) AS x1, row(abs(tu[1] - cl[1]), abs(tu[2] - cl[2])) AS x2 FROM c LEFT JOIN t ON c.sample = t.sample AND c.locus = t.locus),
d AS (SELECT *, least(row(least(s1, s2), greatest(s1, s2)), row(least(x1, x2), greatest(x1, x2))) AS d FROM j)"""


@query("agg12_truth_diploids", f"{_T} SELECT sample, locus, tl[1] AS l1, tl[2] AS l2, tu[1] AS u1, tu[2] AS u2 FROM t")
def agg12(spark, sf):
    t, _ = E.truth_diploids(_truth(spark, sf))
    return t.select("sample", "locus", F.col("truth.lower.f1").alias("l1"), F.col("truth.lower.f2").alias("l2"), F.col("truth.upper.f1").alias("u1"), F.col("truth.upper.f2").alias("u2"))


def _joined(spark, sf):
    return E.truth_join(E.truth_diploids(_truth(spark, sf))[0], _calls(spark, sf))


@query("jn22_truth_join", f"{_J} SELECT sample, locus, count(*) AS pairs, count(tl) AS with_truth FROM j GROUP BY sample, locus")
def jn22(spark, sf):
    return _joined(spark, sf).groupBy("sample", "locus").agg(F.count("*").alias("pairs"), F.count("truth").alias("with_truth"))


@query("agg15_most_likely_minimum_distance_pair", f"""{_J} SELECT sample, locus, cl[1] AS c1, cl[2] AS c2, prob FROM (SELECT *, row_number() OVER (PARTITION BY sample, locus ORDER BY d, prob DESC, cl, cu) AS r FROM d WHERE tl IS NOT NULL) WHERE r = 1""")
def agg15(spark, sf):
    m = E.most_likely_minimum_distance_pair(_joined(spark, sf))
    return m.select("sample", "locus", F.col("diploid.lower.f1").alias("c1"), F.col("diploid.lower.f2").alias("c2"), "prob")


@query("agg13_reduce_resolution", f"{_J} SELECT sample, locus, cl[1] AS l1, cl[2] AS l2, cu[1] AS u1, cu[2] AS u2, CAST(sum(prob) AS BIGINT) AS prob FROM c GROUP BY sample, locus, cl, cu")
def agg13(spark, sf):
    r = E.reduce_resolution(_calls(spark, sf))
    return r.select("sample", "locus", F.col("diploid.lower.f1").alias("l1"), F.col("diploid.lower.f2").alias("l2"), F.col("diploid.upper.f1").alias("u1"), F.col("diploid.upper.f2").alias("u2"), "prob")


_CAT = f"""{_J}, b AS (SELECT *, row_number() OVER (PARTITION BY sample, locus ORDER BY prob DESC, cl, cu) AS r, count(*) OVER (PARTITION BY sample, locus) AS alternatives,
  sum(prob) OVER (PARTITION BY sample, locus, cl, cu) AS p FROM d),
cat AS (SELECT sample, locus, CASE WHEN tl IS NULL THEN 'NoSpec' WHEN d[2][1] = 0 AND d[2][2] = 0 THEN 'BothRight' WHEN d[1][1] = 0 AND d[1][2] = 0 THEN 'OneRight' ELSE 'Different' END AS category,
  alternatives, coalesce(tl = tu AND cl <> cu, false) AS wrong_homozygosity, CAST(p AS BIGINT) AS p FROM b WHERE r = 1)"""


@query("agg14_categorize_sample_locus", f"{_CAT} SELECT sample, locus, category, alternatives, wrong_homozygosity, CASE WHEN category = 'BothRight' THEN p END AS matched_prob FROM cat")
def agg14(spark, sf):
    return E.categorize(_joined(spark, sf))


@query("agg16_aggregate_by_locus", f"""{_CAT} SELECT locus, count(*) FILTER (category = 'BothRight') AS "BothRight", count(*) FILTER (category = 'OneRight') AS "OneRight", count(*) FILTER (category = 'Different') AS "Different",
  count(*) FILTER (category = 'NoSpec') AS "NoSpec", count(*) FILTER (wrong_homozygosity) AS wrongly_homozygous, round(avg(CASE WHEN category = 'BothRight' THEN p END), 2) AS mean_matched_prob FROM cat GROUP BY locus""")
def agg16(spark, sf):
    return E.aggregate_by_locus(E.categorize(_joined(spark, sf))).withColumn("mean_matched_prob", F.round("mean_matched_prob", 2))


@query("jn23_compare_two_runs", f"""{_CAT}, two AS (SELECT * REPLACE (CASE WHEN length(sample) % 2 = 0 AND category = 'OneRight' THEN 'Different' ELSE category END AS category) FROM cat WHERE locus <> '1-URGENT')
SELECT coalesce(cat.sample, two.sample) AS sample, coalesce(cat.locus, two.locus) AS locus, cat.category AS first, two.category AS second FROM cat FULL OUTER JOIN two ON cat.sample = two.sample AND cat.locus = two.locus WHERE cat.category IS DISTINCT FROM two.category""")
def jn23(spark, sf):
    one = saved(E.categorize(_joined(spark, sf)))  # both runs are made of it
    other = F.when((F.length("sample") % 2 == 0) & (F.col("category") == "OneRight"), "Different").otherwise(F.col("category"))
    c = E.compare_two_runs(one, one.where("locus <> '1-URGENT'").withColumn("category", other), strict=False)
    return c.select("sample", "locus", F.col("first.category").alias("first"), F.col("second.category").alias("second"))


@query("jn21_assign_read_to_diploid", f"""{_J}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample, locus ORDER BY prob DESC, cl, cu) AS r FROM c) WHERE r = 1),
x AS (SELECT t0.sample, t0.locus, f1, f2, row(abs(f1 - cl[1]), abs(f2 - cl[2])) AS d1, row(abs(f1 - cu[1]), abs(f2 - cu[2])) AS d2, cl = cu AS same FROM t0 JOIN best ON t0.sample = best.sample AND t0.locus = best.locus)
SELECT sample, locus, f1, f2, CAST(CASE WHEN d1 < d2 THEN 1 WHEN d2 < d1 THEN 2 ELSE 1 END AS INT) AS side FROM x WHERE d1 <> d2 OR same""")
def jn21(spark, sf):
    best = E.most_likely(_calls(spark, sf))
    a = E.assign_read_to_diploid(_truth(spark, sf), best)
    return a.select("sample", "locus", F.col("allele.f1").alias("f1"), F.col("allele.f2").alias("f2"), "side")


_TIMES = "SELECT CAST(c_custkey AS STRING) AS sample, c_acctbal + 2000 AS real FROM customer"


@query("jn24_compare_times", "SELECT CAST(c_custkey AS STRING) AS sample, c_acctbal + 2000 AS real1, (c_acctbal + 2000) * 2 AS real2, CAST(2 AS DOUBLE) AS ratio FROM customer")
def jn24(spark, sf):
    one = derive(spark, sf, text(_TIMES, "customer"), "customer")
    return E.compare_times(one, one.withColumn("real", F.col("real") * 2))


@query("jn25_reconcile_sequences", """
WITH a AS (SELECT doc_id AS allele, md5(text) AS seq FROM documents WHERE doc_id % 5 <> 0), f AS (SELECT doc_id AS allele, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE md5(text) END AS seq FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(a.allele, f.allele) AS allele, CASE WHEN a.allele IS NULL THEN 'JustFasta' WHEN f.allele IS NULL THEN 'JustAlign' WHEN a.seq = f.seq THEN 'Same' ELSE 'Diff' END AS found
FROM a FULL OUTER JOIN f ON a.allele = f.allele""")
def jn25(spark, sf):
    d = derive(spark, sf, "SELECT doc_id AS allele, md5(text) AS seq FROM {documents} WHERE text IS NOT NULL", "documents")
    changed = F.when(F.col("allele") % 7 == 0, "x").otherwise(F.col("seq"))
    return E.reconcile_sequences(d.where("allele % 5 <> 0"), d.where("allele % 3 <> 0").withColumn("seq", changed))


@query("jn26_group_reads_by_boundary", """
WITH b AS (SELECT l_returnflag AS locus, l_linenumber AS region, min(l_suppkey) + l_linenumber * 10 AS pos FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, lead(pos) OVER (PARTITION BY locus ORDER BY pos) AS nxt FROM b),
r AS (SELECT l_orderkey AS read_id, l_linenumber AS k, l_returnflag AS locus, CAST(l_quantity * 2 AS BIGINT) AS pos FROM lineitem)
SELECT read_id, k, r.locus, region FROM r JOIN s ON r.locus = s.locus AND r.pos >= s.pos AND (nxt IS NULL OR r.pos < nxt)""")
def jn26(spark, sf):
    from ..operators.compare import group_by_boundary

    b = derive(spark, sf, "SELECT l_returnflag AS locus, l_linenumber AS region, min(l_suppkey) + l_linenumber * 10 AS pos FROM {lineitem} GROUP BY 1, 2", "lineitem")
    r = derive(spark, sf, "SELECT l_orderkey AS read_id, l_linenumber AS k, l_returnflag AS locus, CAST(l_quantity * 2 AS BIGINT) AS pos FROM {lineitem}", "lineitem")
    return group_by_boundary(r, b).select("read_id", "k", "locus", "region")


@query("win9_running_threshold", "SELECT o_custkey, o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS threshold FROM orders")
def win9(spark, sf):
    from ..operators.windows import running_threshold

    rows = derive(spark, sf, "SELECT o_custkey, o_orderkey, o_totalprice FROM {orders}", "orders")
    return running_threshold(rows, ["o_custkey"], "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey", "threshold")


@query("win10_consecutive_pairs", "SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders) WHERE step IS NOT NULL")
def win10(spark, sf):
    from ..operators.windows import consecutive_pairs

    rows = derive(spark, sf, "SELECT o_custkey, o_orderkey FROM {orders}", "orders")
    return consecutive_pairs(rows, ["o_custkey"], "o_orderkey", "o_orderkey", lambda a, b: b - a).select("o_custkey", "o_orderkey", F.col("combined").alias("step"))


@query("win3_run_align", """
WITH a AS (SELECT o_custkey AS k, o_orderkey AS start, o_orderstatus AS v FROM orders WHERE o_orderkey % 2 = 1), b AS (SELECT o_custkey AS k, o_orderkey AS start, o_orderpriority AS v FROM orders WHERE o_orderkey % 3 = 1),
e AS (SELECT k, start FROM a UNION SELECT k, start FROM b), j AS (SELECT e.k, e.start, a.v AS av, b.v AS bv FROM e LEFT JOIN a ON e.k = a.k AND e.start = a.start LEFT JOIN b ON e.k = b.k AND e.start = b.start)
SELECT k, start, last_value(av IGNORE NULLS) OVER w AS a, last_value(bv IGNORE NULLS) OVER w AS b FROM j WINDOW w AS (PARTITION BY k ORDER BY start)""")
def win3(spark, sf):
    from ..operators.windows import run_align

    rows = derive(spark, sf, "SELECT o_custkey AS k, o_orderkey AS start, o_orderstatus, o_orderpriority FROM {orders}", "orders")
    one = rows.where("start % 2 = 1").select("k", "start", F.col("o_orderstatus").alias("value"))
    two = rows.where("start % 3 = 1").select("k", "start", F.col("o_orderpriority").alias("value"))
    return run_align(one, two, ["k"]).select("k", "start", "a", "b")


@query("win11_compress_names", """
WITH n AS (SELECT DISTINCT 1 + p_partkey % 7 AS f1, p_size AS f2 FROM part), g AS (SELECT *, f2 - row_number() OVER (PARTITION BY f1 ORDER BY f2) AS g FROM n),
s AS (SELECT f1, min(f2) AS lo, max(f2) AS hi FROM g GROUP BY f1, g)
SELECT f1, string_agg(CASE WHEN lo = hi THEN lpad(CAST(lo AS STRING), 2, '0') ELSE concat(lpad(CAST(lo AS STRING), 2, '0'), '-', lpad(CAST(hi AS STRING), 2, '0')) END, ',' ORDER BY lo) AS compressed FROM s GROUP BY f1""")
def win11(spark, sf):
    from ..operators.windows import compress_names

    n = derive(spark, sf, "SELECT 1 + p_partkey % 7 AS f1, p_size AS f2 FROM {part}", "part")
    return compress_names(n, ["f1"], "f2")


@query("agg20_mismatch_histogram", "SELECT CAST(floor(l_quantity / 5) * 5 AS BIGINT) AS bin, count(*) AS count FROM lineitem GROUP BY 1")
def agg20(spark, sf):
    from ..operators.compare import mismatch_histogram

    rows = derive(spark, sf, "SELECT CAST(l_quantity AS BIGINT) AS mismatches FROM {lineitem}", "lineitem")
    return mismatch_histogram(rows, 5).select(F.col("bin").cast("long"), "count")
