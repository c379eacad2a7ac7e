"""Queries over scored reads.

Every document is a read and every benchmark text an allele: their letters are digests of the whole texts. The model's
recurrence over cells is a recursive query in SQL, letter by letter, with windows along the columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kernel, score
from ..operators.pairs import final_emission, pair_sums_blocked
from ..operators.spread import dealt
from ..sources.shared import saved
from .q_align import _LETTERS
from .registry import derive, query, text

_DIGEST = "translate(md5(text), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_ALLELES = f"SELECT item_id AS allele_id, concat('L', item_id % 3) AS locus, substr({_DIGEST}, 1, CAST(18 + item_id % 5 AS INT)) AS seq FROM benchmark WHERE text IS NOT NULL"
_READS = f"SELECT doc_id AS read_id, substr({_DIGEST}, 1, 12) AS seq FROM documents WHERE text IS NOT NULL"


def alleles(spark, sf):
    return derive(spark, sf, text(_ALLELES, "benchmark"), "benchmark")


def reads(spark, sf):
    quality = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: ((F.col("read_id") * 31 + i * 17) % 31 + 10).cast("int"))
    return derive(spark, sf, text(_READS, "documents"), "documents").withColumn("mate", F.lit(0)).withColumn("q", quality)


STRETCH = 50


def stretches(spark, sf):
    """All letters of every text, in reads of ``STRETCH`` letters and a last one of what is left."""
    rows = derive(spark, sf, f"SELECT doc_id, {_LETTERS.format(g='')} AS letters FROM {{documents}} WHERE text IS NOT NULL", "documents").where("letters <> ''")
    parts = dealt(rows).select("doc_id", "letters", F.explode(F.sequence(F.lit(0), F.expr(f"(length(letters) - 1) div {STRETCH}").cast("int"))).alias("k"))
    reads = parts.select((F.col("doc_id") * 1_000_000 + F.col("k")).alias("read_id"), F.lit(0).alias("mate"), F.expr(f"substr(letters, k * {STRETCH} + 1, {STRETCH})").alias("seq"))
    return reads.withColumn("q", F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: ((F.col("read_id") * 31 + i * 17) % 31 + 10).cast("int")))


def whole_alleles(spark, sf):
    """All letters of every benchmark text as an allele of one of three genes."""
    return derive(spark, sf, f"SELECT item_id AS allele_id, concat('L', item_id % 3) AS locus, {_LETTERS.format(g='')} AS seq FROM {{benchmark}} WHERE text IS NOT NULL", "benchmark").where("seq <> ''")


def _scores(spark, sf, **options):
    return score.forward_scores(score.oriented(reads(spark, sf)), score.build_emissions(alleles(spark, sf)), **options)


def cells_sql(parts: int = 1) -> str:
    """Cells f (read, orientation, part, allele, letter i, column k: match, insert, delete) of all reads on all alleles."""
    n = 12 // parts
    return f"""WITH RECURSIVE a AS ({_ALLELES}), g AS (SELECT locus, CAST(max(length(seq)) AS DOUBLE) AS g FROM a GROUP BY locus),
al AS (SELECT allele_id, a.locus, unnest(range(1, length(seq) + 1)) AS k, unnest(string_split(seq, '')) AS ch, g, 1 / (2 * greatest(g - 12, 1)) AS me FROM a JOIN g ON a.locus = g.locus),
o AS (SELECT read_id, false AS rc, seq FROM ({_READS}) UNION ALL SELECT read_id, true, reverse(translate(seq, 'ACGT', 'TGCA')) FROM ({_READS})),
rl AS (SELECT read_id, rc, CAST((x - 1) // {n} AS INT) AS part, CAST((x - 1) % {n} + 1 AS INT) AS i, substr(seq, CAST(x AS INT), 1) AS b,
  pow(10, -((read_id * 31 + (CASE WHEN rc THEN 12 - x ELSE x - 1 END) * 17) % 31 + 10) / 10.0) AS e FROM (SELECT *, unnest(range(1, 13)) AS x FROM o)),
f(read_id, rc, part, allele_id, i, k, m, s, d) AS (
  SELECT read_id, rc, part, allele_id, 1, k, CASE WHEN b = ch THEN 1 - e ELSE e / 3 END * 0.999 / g, 0.25 * 0.001 / g, CAST(0 AS DOUBLE) FROM rl, al WHERE i = 1
  UNION ALL
  SELECT read_id, rc, part, allele_id, i, k, m, s, coalesce(0.001 * pow(10, 1 - k) * sum(m * pow(10, k)) OVER (PARTITION BY read_id, rc, part, allele_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) FROM (
    SELECT f.read_id, f.rc, f.part, f.allele_id, rl.i, f.k,
      CASE WHEN b = ch THEN 1 - e ELSE e / 3 END * coalesce(lag(0.998 * m + 0.9 * s + 0.9 * d) OVER (PARTITION BY f.read_id, f.rc, f.part, f.allele_id ORDER BY f.k), 0) AS m, 0.25 * (0.001 * m + 0.1 * s) AS s
    FROM f JOIN rl ON f.read_id = rl.read_id AND f.rc = rl.rc AND f.part = rl.part AND rl.i = f.i + 1 JOIN al ON f.allele_id = al.allele_id AND f.k = al.k)),
ends AS (SELECT f.read_id, f.rc, f.part, f.allele_id, al.locus, f.k, (m + s) * me AS v, g, me FROM f JOIN al ON f.allele_id = al.allele_id AND f.k = al.k WHERE i = {n}),
value AS (SELECT read_id, rc, part, allele_id, locus, log10(sum(v)) AS llhd, CAST(arg_max(k, v) - 1 AS BIGINT) AS pos, max(g) AS g, max(me) AS me FROM ends GROUP BY read_id, rc, part, allele_id, locus)"""


_F = cells_sql()
_BEST = f"""{_F}, best AS (SELECT read_id, locus, rc FROM (SELECT *, row_number() OVER (PARTITION BY read_id, locus ORDER BY llhd DESC, rc, allele_id) AS r FROM value) WHERE r = 1),
one AS (SELECT v.* FROM value v JOIN best b ON v.read_id = b.read_id AND v.locus = b.locus AND v.rc = b.rc)"""


@query("hm1_build_emissions", f"SELECT locus, CAST(max(length(seq)) AS INT) AS n_columns, count(DISTINCT seq) AS sequences, count(*) AS alleles FROM ({_ALLELES}) GROUP BY locus")
def hm1(spark, sf):
    e = score.build_emissions(alleles(spark, sf))
    return e.groupBy("locus", "n_columns").agg(F.sum(F.size("alleles")).alias("sequences"), F.sum(F.expr("aggregate(alleles, 0, (n, a) -> n + size(a.ids))")).alias("alleles"))


_T = "SELECT DISTINCT length(text) AS read_length, 3 * length(text) + 5 AS columns FROM documents WHERE length(text) > 0"


@query("hm2_transitions", f"""WITH t AS ({_T}), x AS (SELECT read_length, columns, true AS prealigned, 1.0 AS stay, 1 / (2.0 * greatest(columns - read_length, 1)) AS g FROM t
UNION ALL SELECT read_length, columns, false, 1 - 1 / (2.0 * read_length), 1 / (2.0 * read_length) FROM t)
SELECT read_length, columns, prealigned, round(0.998 * stay, 12) AS mm, round(0.001 * stay, 12) AS mi, round(0.001 * stay, 12) AS md, round(0.9 * stay, 12) AS im, round(0.1 * stay, 12) AS ii, CAST(0.9 AS DOUBLE) AS dm, CAST(0.1 AS DOUBLE) AS dd,
round(g, 12) AS me, round(g, 12) AS ie, round(0.999 / columns, 12) AS sm, round(0.001 / columns, 12) AS si FROM x""")
def hm2(spark, sf):
    sizes = derive(spark, sf, text(_T, "documents"), "documents")
    return kernel.transition_table(sizes.select(F.col("read_length").cast("long"), F.col("columns").cast("long"))).select(
        "read_length", "columns", "prealigned", *[F.round(c, 12).alias(c) for c in kernel.NAMES])


@query("hm3_forward_score", f"{_F} SELECT read_id, locus, allele_id, rc, round(llhd, 6) AS llhd, pos FROM value")
def hm3(spark, sf):
    return _scores(spark, sf).select("read_id", "locus", "allele_id", "rc", F.round("llhd", 6).alias("llhd"), "pos")


@query("jn17_reads_x_alleles", f"WITH a AS ({_ALLELES}) SELECT read_id, rc, locus, count(*) AS alleles FROM ({_READS}) r, (VALUES (false), (true)) AS o(rc), a GROUP BY read_id, rc, locus")
def jn17(spark, sf):
    return score.reads_x_alleles(_scores(spark, sf)).select("read_id", "rc", "locus", "alleles")


@query("hm4_best_orientation_scores", f"{_BEST} SELECT read_id, locus, allele_id, rc, round(llhd, 6) AS llhd, pos FROM one")
def hm4(spark, sf):
    return score.best_orientation_scores(reads(spark, sf), score.build_emissions(alleles(spark, sf))).select("read_id", "locus", "allele_id", "rc", F.round("llhd", 6).alias("llhd"), "pos")


# The second half of a read begins its search in the column in which the gene's best allele has the first half's likeliest end.
_SPLIT = f"""WITH RECURSIVE a AS ({_ALLELES}), g AS (SELECT locus, CAST(max(length(seq)) AS DOUBLE) AS g FROM a GROUP BY locus),
al AS (SELECT allele_id, a.locus, unnest(range(1, length(seq) + 1)) AS k, unnest(string_split(seq, '')) AS ch, g FROM a JOIN g ON a.locus = g.locus),
o AS (SELECT read_id, false AS rc, seq FROM ({_READS}) UNION ALL SELECT read_id, true, reverse(translate(seq, 'ACGT', 'TGCA')) FROM ({_READS})),
rl AS (SELECT read_id, rc, CAST(x AS INT) AS i, substr(seq, CAST(x AS INT), 1) AS b, pow(10, -((read_id * 31 + (CASE WHEN rc THEN 12 - x ELSE x - 1 END) * 17) % 31 + 10) / 10.0) AS e FROM (SELECT *, unnest(range(1, 13)) AS x FROM o)),
f0(read_id, rc, allele_id, i, k, m, s, d) AS (
  SELECT read_id, rc, allele_id, 1, k, CASE WHEN b = ch THEN 1 - e ELSE e / 3 END * 0.999 / g, 0.25 * 0.001 / g, CAST(0 AS DOUBLE) FROM rl, al WHERE i = 1
  UNION ALL
  {{step}}),
v0 AS (SELECT read_id, rc, allele_id, locus, log10(sum(v)) AS llhd, CAST(arg_max(k, v) - 1 AS BIGINT) AS pos, max(g) AS g FROM (
  SELECT f.*, locus, g, (m + s) / (2 * greatest(g - 6, 1)) AS v FROM f0 f JOIN al ON f.allele_id = al.allele_id AND f.k = al.k WHERE i = 6) GROUP BY read_id, rc, allele_id, locus),
st AS (SELECT v.read_id, v.rc, v.locus, min(pos) AS start, max(g) - min(pos) AS rest FROM v0 v JOIN (SELECT read_id, rc, locus, max(llhd) AS top FROM v0 GROUP BY read_id, rc, locus) t
  ON v.read_id = t.read_id AND v.rc = t.rc AND v.locus = t.locus WHERE llhd >= top - 5e-10 GROUP BY v.read_id, v.rc, v.locus),
f1(read_id, rc, allele_id, i, k, m, s, d) AS (
  SELECT rl.read_id, rl.rc, allele_id, 7, k, CASE WHEN b = ch THEN 1 - e ELSE e / 3 END * 0.999 / rest, 0.25 * 0.001 / rest, CAST(0 AS DOUBLE) FROM rl JOIN st ON rl.read_id = st.read_id AND rl.rc = st.rc JOIN al ON al.locus = st.locus AND k > start WHERE i = 7 AND rest > 6
  UNION ALL
  {{step}}),
v1 AS (SELECT read_id, rc, allele_id, log10(sum((m + s) / (2 * greatest(rest - 6, 1)))) - log10(0.999 / max(rest) / (2 * greatest(max(rest) - 6, 1))) AS llhd FROM (
  SELECT f.*, rest FROM f1 f JOIN a ON f.allele_id = a.allele_id JOIN st ON f.read_id = st.read_id AND f.rc = st.rc AND a.locus = st.locus WHERE i = 12) GROUP BY read_id, rc, allele_id)
SELECT v0.read_id, locus, v0.allele_id, v0.rc, round(v0.llhd + v1.llhd, 6) AS llhd, st.rest <= 6 AS at_end FROM v0 JOIN st USING (read_id, rc, locus) LEFT JOIN v1 ON v0.read_id = v1.read_id AND v0.rc = v1.rc AND v0.allele_id = v1.allele_id
WHERE st.rest <= 6 OR v1.llhd > -290"""
_STEP = """SELECT read_id, rc, allele_id, i, k, m, s, coalesce(0.001 * pow(10, 1 - k) * sum(m * pow(10, k)) OVER (PARTITION BY read_id, rc, allele_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) FROM (
    SELECT f.read_id, f.rc, f.allele_id, rl.i, f.k, CASE WHEN b = ch THEN 1 - e ELSE e / 3 END * coalesce(lag(0.998 * m + 0.9 * s + 0.9 * d) OVER (PARTITION BY f.read_id, f.rc, f.allele_id ORDER BY f.k), 0) AS m, 0.25 * (0.001 * m + 0.1 * s) AS s
    FROM {f} f JOIN rl ON f.read_id = rl.read_id AND f.rc = rl.rc AND rl.i = f.i + 1 JOIN al ON f.allele_id = al.allele_id AND f.k = al.k{until})"""
_SPLIT = _SPLIT.replace("{step}", _STEP.format(f="f0", until=" WHERE rl.i <= 6"), 1).replace("{step}", _STEP.format(f="f1", until=""), 1)


@query("hm5_forward_score_split", _SPLIT)
def hm5(spark, sf):
    rows = _scores(spark, sf, parts=2)
    at_end = F.col("filter_reason").isNotNull()
    # an allele that ends before the second half begins has no likelihood
    return rows.where(at_end | (F.col("llhd") > -290)).select("read_id", "locus", "allele_id", "rc", F.when(~at_end, F.round("llhd", 6)).alias("llhd"), at_end.alias("at_end"))


# The best cell over a gene's alleles after each letter, and the chance of an ungapped path with three mismatches.
_LIMITS = """top AS (SELECT f.read_id, f.rc, al.locus, f.i, log10(max(m)) AS best FROM f JOIN al ON f.allele_id = al.allele_id AND f.k = al.k GROUP BY f.read_id, f.rc, al.locus, f.i),
ranked AS (SELECT a.read_id, a.rc, a.i, b.e, row_number() OVER (PARTITION BY a.read_id, a.rc, a.i ORDER BY b.e) AS r FROM rl a JOIN rl b ON a.read_id = b.read_id AND a.rc = b.rc AND b.i <= a.i),
bound AS (SELECT read_id, rc, i, sum(CASE WHEN r <= 3 THEN log10(e / 3) ELSE log10(1 - e) END) AS bound FROM ranked GROUP BY read_id, rc, i),
failed AS (SELECT DISTINCT t.read_id, t.rc, t.locus FROM top t JOIN bound b ON t.read_id = b.read_id AND t.rc = b.rc AND t.i = b.i JOIN g ON t.locus = g.locus
  WHERE best < bound + log10(0.999 / g) + (t.i - 1) * log10(0.998)),
every AS (SELECT DISTINCT read_id, rc, locus FROM value)"""


@query("flt10_max_mismatch_filter", f"""{_F}, {_LIMITS}
SELECT e.read_id, e.locus, e.rc, CASE WHEN f.read_id IS NOT NULL THEN 'mismatches' END AS filter_reason FROM every e LEFT JOIN failed f ON e.read_id = f.read_id AND e.rc = f.rc AND e.locus = f.locus""")
def flt10(spark, sf):
    return _scores(spark, sf, allowed_mismatches=3).groupBy("read_id", "locus", "rc").agg(F.max("filter_reason").alias("filter_reason"))


# Passes in order: genes by name, in each the regular orientation first. A pass is filtered when its best match falls below the
# threshold in a row before the last; the threshold is the highest median match of the passes before that were not filtered.
_PAST = """low AS (SELECT read_id, rc, locus, min(best) AS low FROM top WHERE i < 12 GROUP BY read_id, rc, locus),
best_column AS (SELECT read_id, rc, locus, arg_max(k, (top, -k)) AS k FROM (SELECT f.read_id, f.rc, locus, f.k, max(m) AS top FROM f JOIN al ON f.allele_id = al.allele_id AND f.k = al.k WHERE i = 12 GROUP BY f.read_id, f.rc, locus, f.k) GROUP BY read_id, rc, locus),
counted AS (SELECT locus, count(*) AS n FROM a GROUP BY locus),
at_best AS (SELECT b.read_id, b.rc, b.locus, coalesce(log10(m), CAST('-inf' AS DOUBLE)) AS m, row_number() OVER (PARTITION BY b.read_id, b.rc, b.locus ORDER BY coalesce(m, 0)) AS r
  FROM best_column b JOIN a ON a.locus = b.locus LEFT JOIN f ON f.read_id = b.read_id AND f.rc = b.rc AND f.allele_id = a.allele_id AND f.k = b.k AND f.i = 12),
pass AS (SELECT l.read_id, l.rc, l.locus, low, m AS median, row_number() OVER (PARTITION BY l.read_id ORDER BY l.locus, l.rc) AS p, {failed} AS failed
  FROM low l JOIN at_best x ON x.read_id = l.read_id AND x.rc = l.rc AND x.locus = l.locus JOIN counted c ON c.locus = l.locus AND x.r = greatest(c.n // 2, 1)),
thr(read_id, p, t) AS (SELECT DISTINCT read_id, CAST(1 AS BIGINT), CAST('-inf' AS DOUBLE) FROM pass UNION ALL
  SELECT t.read_id, t.p + 1, CASE WHEN s.failed OR s.low < t.t THEN t.t ELSE greatest(t.t, s.median) END FROM thr t JOIN pass s ON t.read_id = s.read_id AND t.p = s.p),
past AS (SELECT s.read_id, s.locus, s.rc FROM pass s JOIN thr t ON s.read_id = t.read_id AND s.p = t.p WHERE s.low < t.t)"""
_NOT = "false"
_FAILED = "EXISTS (SELECT 1 FROM failed q WHERE q.read_id = l.read_id AND q.rc = l.rc AND q.locus = l.locus)"


@query("flt11_past_threshold_filter", f"""{_F}, {_LIMITS}, {_PAST.format(failed=_NOT)}
SELECT v.read_id, v.locus, v.allele_id, v.rc, CASE WHEN p.read_id IS NOT NULL THEN 'threshold' END AS filter_reason, CASE WHEN p.read_id IS NULL THEN round(llhd, 6) END AS llhd
FROM value v LEFT JOIN past p ON v.read_id = p.read_id AND v.locus = p.locus AND v.rc = p.rc""")
def flt11(spark, sf):
    s = score.past_threshold_scores(reads(spark, sf), score.build_emissions(alleles(spark, sf)))
    return s.select("read_id", "locus", "allele_id", "rc", "filter_reason", F.when(F.col("filter_reason").isNull(), F.round("llhd", 6)).alias("llhd"))


@query("flt12_join_filters", f"""{_F}, {_LIMITS}, {_PAST.format(failed=_FAILED)}
SELECT e.read_id, e.locus, e.rc, f.read_id IS NULL AND p.read_id IS NULL AS passed FROM every e LEFT JOIN failed f ON e.read_id = f.read_id AND e.rc = f.rc AND e.locus = f.locus
LEFT JOIN past p ON e.read_id = p.read_id AND e.locus = p.locus AND e.rc = p.rc""")
def flt12(spark, sf):
    s = score.past_threshold_scores(reads(spark, sf), score.build_emissions(alleles(spark, sf)), allowed_mismatches=3)
    return s.groupBy("read_id", "locus", "rc").agg((F.max("filter_reason").isNull()).alias("passed"))


_CELLS = "SELECT l_orderkey AS read_id, l_suppkey % 5 AS allele_id, l_linenumber AS pos, max(-round(l_extendedprice) / 10000) AS llhd FROM lineitem GROUP BY l_orderkey, l_suppkey % 5, l_linenumber"


@query("agg7_final_emission", f"""WITH c AS ({_CELLS}), m AS (SELECT *, max(llhd) OVER (PARTITION BY read_id, allele_id) AS m FROM c)
SELECT read_id, allele_id, round(m + log10(sum(pow(10, llhd - m))), 6) AS llhd, min(CASE WHEN llhd = m THEN pos END) AS pos FROM m GROUP BY read_id, allele_id, m""")
def agg7(spark, sf):
    return final_emission(derive(spark, sf, text(_CELLS, "lineitem"), "lineitem")).select("read_id", "allele_id", F.round("llhd", 6).alias("llhd"), "pos")


# Typing: each read's best gene, sums over pairs, the coverage of the fifty best ranks, and the posterior.
_TYPED = f"""{_BEST}, gene AS (SELECT read_id, locus FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY llhd DESC, locus, allele_id) AS r FROM one) WHERE r = 1),
s AS (SELECT o.read_id, o.locus, o.allele_id, llhd, pos FROM one o JOIN gene ON o.read_id = gene.read_id AND o.locus = gene.locus),
p AS (SELECT x.read_id, x.locus, x.allele_id AS i, y.allele_id AS j, CASE WHEN abs(x.llhd - y.llhd) < 1e-6 OR x.llhd > y.llhd THEN x.llhd ELSE y.llhd END AS llhd,
  CASE WHEN abs(x.llhd - y.llhd) < 1e-6 OR x.llhd > y.llhd THEN x.pos ELSE y.pos END AS pos, CASE WHEN abs(x.llhd - y.llhd) < 1e-6 THEN 1 WHEN x.llhd > y.llhd THEN 2 ELSE 0 END AS w1
  FROM s x JOIN s y ON x.read_id = y.read_id AND x.locus = y.locus AND x.allele_id <= y.allele_id),
z AS (SELECT locus, i, j, sum(llhd) AS z FROM p GROUP BY locus, i, j), t AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY locus ORDER BY round(z, 6) DESC) AS r FROM z) WHERE r <= 50),
w AS (SELECT p.locus, p.i, p.j, side, pos, sum(CASE side WHEN 1 THEN w1 ELSE 2 - w1 END) AS w FROM p JOIN t ON p.locus = t.locus AND p.i = t.i AND p.j = t.j, (VALUES (1), (2)) AS v(side)
  WHERE CASE side WHEN 1 THEN w1 ELSE 2 - w1 END > 0 GROUP BY p.locus, p.i, p.j, side, pos),
cs AS (SELECT locus, i, j, side, sum(w) AS n, sum(lgamma(w + 1.0) / ln(10.0)) AS fw FROM w GROUP BY locus, i, j, side),
c AS (SELECT locus, i, j, sum(lgamma(n + 1.0) / ln(10.0) - n * log10(300.0) - fw) AS c FROM cs GROUP BY locus, i, j),
u AS (SELECT t.locus, t.i, t.j, t.z, c.c, max(t.z + c.c) OVER (PARTITION BY t.locus) AS top, (SELECT count(*) FROM z WHERE z.locus = t.locus) - count(*) OVER (PARTITION BY t.locus) AS cut FROM t JOIN c ON t.locus = c.locus AND t.i = c.i AND t.j = c.j),
post AS (SELECT locus, i, j, z, c, pow(10.0, z + c - top) / (sum(pow(10.0, z + c - top)) OVER (PARTITION BY locus) + cut * min(pow(10.0, z + c - top)) OVER (PARTITION BY locus)) AS prob FROM u)"""


@query("hm9_type_multi_locus", f"{_TYPED} SELECT locus, i, j, round(z, 4) AS z, round(c, 4) AS c, round(prob, 6) AS prob FROM post")
def hm9(spark, sf):
    t = score.type_reads(reads(spark, sf), score.build_emissions(alleles(spark, sf)), 300)
    return t["posterior"].select("locus", "i", "j", F.round("z", 4).alias("z"), F.round("c", 4).alias("c"), F.round("prob", 6).alias("prob"))


@query("hm8_type_single_locus", f"{_BEST} SELECT locus, allele_id, round(sum(llhd), 4) AS llhd, count(*) AS reads FROM one GROUP BY locus, allele_id")
def hm8(spark, sf):
    t = score.type_reads(reads(spark, sf), score.build_emissions(alleles(spark, sf)), 300, multi_locus=False)
    return t["alleles"].select("locus", "allele_id", F.round("llhd", 4).alias("llhd"), "reads")


@query("hm9_type_many_samples", f"{_BEST} SELECT concat('s', read_id % 4) AS sample, locus, allele_id, round(sum(llhd), 4) AS llhd, count(*) AS reads FROM one GROUP BY 1, 2, 3")
def hm9s(spark, sf):
    r = reads(spark, sf).withColumn("sample", F.concat(F.lit("s"), F.col("read_id") % 4))
    return score.type_reads(r, score.build_emissions(alleles(spark, sf)), 300, multi_locus=False)["alleles"].select("sample", "locus", "allele_id", F.round("llhd", 4).alias("llhd"), "reads")


@query("agg2_pair_sums_blocked", f"""{_F}, s AS (SELECT * FROM value WHERE NOT rc)
SELECT x.locus, x.allele_id AS i, y.allele_id AS j, round(sum(greatest(x.llhd, y.llhd)), 4) AS z FROM s x JOIN s y ON x.read_id = y.read_id AND x.locus = y.locus AND x.allele_id <= y.allele_id GROUP BY x.locus, x.allele_id, y.allele_id""")
def agg2b(spark, sf):
    s = score.forward_scores(reads(spark, sf).withColumn("rc", F.lit(False)), score.build_emissions(alleles(spark, sf)))
    return pair_sums_blocked(saved(s), lane_bytes=1 << 18).select("locus", "i", "j", F.round("z", 4).alias("z"))


# Scoring, filtering, choice of orientation and gene, and typing over whole texts. The recurrence is too long for SQL here; a test
# holds it against a plain one, and typing against the long form.
@query("hm9_type_stretches")
def hm9_stretches(spark, sf):
    return score.type_reads(stretches(spark, sf), score.build_emissions(whole_alleles(spark, sf)), 400, allowed_mismatches=12)["posterior"]


# The best path to each cell, as rows: a delete's from the matches before it, the sum of its steps being the same however it is split.
_VITERBI = f"""WITH RECURSIVE target AS (SELECT * FROM ({_ALLELES}) ORDER BY length(seq) DESC, allele_id LIMIT 1), g AS (SELECT CAST(length(seq) AS DOUBLE) AS g FROM target),
al AS (SELECT unnest(range(1, length(seq) + 1)) AS k, unnest(string_split(seq, '')) AS ch FROM target),
o AS (SELECT read_id, false AS rc, seq FROM ({_READS}) UNION ALL SELECT read_id, true, reverse(translate(seq, 'ACGT', 'TGCA')) FROM ({_READS})),
rl AS (SELECT read_id, rc, CAST(x AS INT) AS i, substr(seq, CAST(x AS INT), 1) AS b, pow(10, -((read_id * 31 + (CASE WHEN rc THEN 12 - x ELSE x - 1 END) * 17) % 31 + 10) / 10.0) AS e FROM (SELECT *, unnest(range(1, 13)) AS x FROM o)),
f(read_id, rc, i, k, m, s, d) AS (
  SELECT read_id, rc, 1, k, log10(CASE WHEN b = ch THEN 1 - e ELSE e / 3 END) + log10(0.999 / g), log10(0.25 * 0.001 / g), CAST(-1e9 AS DOUBLE) FROM rl, al, g WHERE i = 1
  UNION ALL
  SELECT read_id, rc, i, k, m, s, coalesce(max(m + k) OVER (PARTITION BY read_id, rc ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3 - (k - 1), -1e9) FROM (
    SELECT f.read_id, f.rc, rl.i, f.k, log10(CASE WHEN b = ch THEN 1 - e ELSE e / 3 END)
      + coalesce(lag(greatest(m + log10(0.998), s + log10(0.9), d + log10(0.9))) OVER (PARTITION BY f.read_id, f.rc ORDER BY f.k), -1e9) AS m, log10(0.25) + greatest(m - 3, s - 1) AS s
    FROM f JOIN rl ON f.read_id = rl.read_id AND f.rc = rl.rc AND rl.i = f.i + 1 JOIN al ON f.k = al.k))"""


@query("hm6_viterbi_align", f"""{_VITERBI} SELECT read_id, round(max(greatest(m, s)) + log10(1 / (2 * greatest(max(g) - 12, 1))), 6) AS llhd, true AS whole_read, true AS within_allele
FROM f, g WHERE i = 12 GROUP BY read_id""")
def hm6(spark, sf):
    longest = alleles(spark, sf).orderBy(F.desc(F.length("seq")), "allele_id").first()
    a = score.viterbi_align(score.oriented(reads(spark, sf)), longest["allele_id"], longest["seq"], len(longest["seq"])).join(
        score.oriented(reads(spark, sf)).select("read_id", "rc", "seq"), ["read_id", "rc"])
    plain = lambda c: F.regexp_replace(c, "-", "")
    inside = plain("allele_text") == F.substring(F.lit(longest["seq"]), F.col("start") + 1, F.col("stop") - F.col("start") + 1)
    return a.select("read_id", F.round("llhd", 6).alias("llhd"), (plain("read_text") == F.col("seq")).alias("whole_read"), inside.alias("within_allele"))


@query("hm7_viterbi_report", f"""{_VITERBI}, v AS (SELECT read_id, rc, max(greatest(m, s)) AS llhd FROM f WHERE i = 12 GROUP BY read_id, rc),
st AS (SELECT read_id // 2 AS pair, rc <> (read_id % 2 = 1) AS strand, sum(llhd) AS llhd FROM v GROUP BY 1, 2),
b AS (SELECT pair, strand FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(llhd, 9) DESC, strand) AS r FROM st) WHERE r = 1)
SELECT b.pair AS read_id, count(*) AS mates, string_agg(seq, ' ' ORDER BY seq) AS reads, count(*) > 1 AS has_distance FROM o JOIN b ON o.read_id // 2 = b.pair AND (o.rc <> (o.read_id % 2 = 1)) = b.strand GROUP BY b.pair""")
def hm7(spark, sf):
    longest = alleles(spark, sf).orderBy(F.desc(F.length("seq")), "allele_id").first()
    mates = reads(spark, sf).withColumn("mate", (F.col("read_id") % 2 + 1).cast("int")).withColumn("read_id", F.expr("read_id div 2"))
    r = score.viterbi_report(score.viterbi_align(score.oriented(mates), longest["allele_id"], longest["seq"], len(longest["seq"])))
    texts = F.transform(F.split("report", "\n\n"), lambda m: F.regexp_replace(F.split(m, "\n")[1], "-", ""))
    return r.select("read_id", F.size(texts).cast("long").alias("mates"), F.array_join(F.array_sort(texts), " ").alias("reads"), F.col("inner_distance").isNotNull().alias("has_distance"))


@query("ud1_fold", """WITH s AS (SELECT user_id, event_id, sum(value - 1) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events), n AS (SELECT user_id, arg_max(s, event_id) AS last, min(s) AS low FROM s GROUP BY user_id)
SELECT user_id, round(last - least(low, 0), 6) AS state FROM n""")
def ud1(spark, sf):
    import pandas as pd

    from ..operators.user import fold

    rows = derive(spark, sf, "SELECT user_id, event_id, value FROM {events}", "events")
    return fold(rows, ["user_id"], lambda s, r: max(0.0, s + r.value - 1.0), lambda: 0.0,
                lambda k, s: pd.DataFrame({"user_id": [k[0]], "state": [round(float(s), 6)]}), "user_id long, state double", order="event_id")


@query("ud5_worker", "SELECT event_type, CAST(sum(length(props)) AS BIGINT) AS letters, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY event_type")
def ud5(spark, sf):
    from ..operators.user import Worker

    rows = derive(spark, sf, "SELECT event_type, props FROM {events} WHERE props IS NOT NULL", "events")
    worker = Worker(lambda f: f.assign(letters=f["props"].str.len())[["event_type", "letters"]], "event_type string, letters long", ("event_type",),
                    (F.sum("letters").alias("letters"), F.count("*").alias("n")))
    return worker.run(rows)


_WORK = "SELECT user_id % 10 AS lane, count(*) AS n, CAST(sum(length(event_type) * event_id) AS BIGINT) AS letters, CAST(max(length(event_type)) AS BIGINT) AS longest FROM events GROUP BY user_id % 10"


@query("ud2_map_then_combine", _WORK)
def ud2(spark, sf):
    from ..operators.user import map_then_combine

    rows = derive(spark, sf, "SELECT user_id, event_id, event_type FROM {events}", "events")

    def work(frame):
        size = frame["event_type"].str.len().astype("int64")
        return frame.assign(lane=frame["user_id"] % 10, w=size * frame["event_id"], size=size)[["lane", "w", "size"]]

    return map_then_combine(rows, work, "lane long, w long, size long", ["lane"], [F.count("*").alias("n"), F.sum("w").alias("letters"), F.max("size").alias("longest")])
