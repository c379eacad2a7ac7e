"""Queries over allele names and other scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import values as V
from .registry import NAMES, derive, names, query, text

_GOOD = r"regexp_full_match(raw, '[A-Z0-9]+\*[0-9]+(:[0-9]+){0,3}[NLSCAQ]?') AND raw NOT LIKE 'Q*%' AND raw NOT LIKE '%:00%' AND raw NOT LIKE '%*00%'"
_LOCI = ", ".join(f"'{x}'" for x in N.LOCI)


@query("sc1_parse_allele", f"""
WITH n AS ({NAMES})
SELECT allele_id, raw, CASE WHEN ok THEN split_part(raw, '*', 1) END AS locus, CASE WHEN ok THEN f1 END AS f1, CASE WHEN ok THEN f2 END AS f2,
  CASE WHEN ok THEN f3 END AS f3, CASE WHEN ok THEN f4 END AS f4, CASE WHEN ok THEN suffix END AS suffix
FROM (SELECT *, {_GOOD} AND raw = allele AS ok FROM n)""")
def sc1(spark, sf):
    got = names(spark, sf).withColumn("p", N.parse_allele(F.col("raw")))
    return got.select("allele_id", "raw", *[F.col(f"p.{c}").alias(c) for c in ("locus", "f1", "f2", "f3", "f4", "suffix")])


@query("sc2_parse_resolution", f"""
WITH n AS ({NAMES})
SELECT allele_id, split_part(allele, '*', 2) AS txt, f1, f2, f3, f4, suffix FROM n""")
def sc2(spark, sf):
    n = names(spark, sf).select("allele_id", F.split_part("allele", F.lit("*"), F.lit(2)).alias("txt"))
    return n.withColumn("p", N.parse_resolution(F.col("txt"))).select("allele_id", "txt", "p.*")


@query("sc3_trim_suffix", f"""
WITH n AS ({NAMES})
SELECT allele_id, CASE WHEN suffix IS NULL AND raw NOT LIKE '%R' THEN raw WHEN raw LIKE '%R' THEN NULL WHEN raw <> allele THEN raw
  ELSE left(raw, length(raw) - 1) END AS rest, CASE WHEN raw = allele THEN suffix END AS suffix FROM n""")
def sc3(spark, sf):
    return names(spark, sf).withColumn("t", N.trim_suffix(F.col("raw"))).select("allele_id", "t.rest", "t.suffix")


@query("sc4_format_allele", f"WITH n AS ({NAMES}) SELECT allele_id, allele AS formatted, split_part(allele, '*', 2) AS bare FROM n")
def sc4(spark, sf):
    p = F.struct("f1", "f2", "f3", "f4", "suffix")
    return names(spark, sf).withColumn("p", p).select(
        "allele_id", N.format_allele(F.col("p"), F.col("locus")).alias("formatted"), N.format_allele(F.col("p")).alias("bare"))


@query("sc5_reduce_two", f"WITH n AS ({NAMES}) SELECT locus, f1, f2, count(*) AS alleles FROM n GROUP BY locus, f1, f2")
def sc5(spark, sf):
    p = N.reduce_two(F.struct("f1", "f2", "f3", "f4"))
    return names(spark, sf).withColumn("two", p).groupBy("locus", "two").agg(F.count("*").alias("alleles")).select(
        "locus", "two.f1", "two.f2", "alleles")


_PAIRS = f"""
WITH n AS ({NAMES}) SELECT a.allele_id AS a_id, b.allele_id AS b_id, a.f1 AS a1, a.f2 AS a2, a.f3 AS a3, a.f4 AS a4,
  b.f1 AS b1, b.f2 AS b2, b.f3 AS b3, b.f4 AS b4 FROM n a JOIN n b ON a.locus = b.locus AND b.allele_id = a.allele_id + 4"""


def _pairs(spark, sf):
    n = names(spark, sf).withColumn("p", F.struct("f1", "f2", "f3", "f4"))
    b = n.select(F.col("allele_id").alias("b_id"), "locus", F.col("p").alias("b"))
    return n.select(F.col("allele_id").alias("a_id"), "locus", F.col("p").alias("a")).join(
        b.withColumn("a_id", F.col("b_id") - 4), ["a_id", "locus"])


@query("sc6_two_matches_full", f"""
WITH p AS ({_PAIRS}) SELECT a_id, b_id, CASE WHEN a3 = 0 AND a4 = 0 THEN a1 = b1 AND a2 = b2 END AS matches FROM p""")
def sc6(spark, sf):
    return _pairs(spark, sf).select("a_id", "b_id", N.two_matches_full(F.col("a"), F.col("b")).alias("matches"))


@query("sc7_name_distance", f"""
WITH p AS ({_PAIRS}) SELECT a_id, b_id, abs(a1 - b1) AS d1, abs(a2 - b2) AS d2, abs(a3 - b3) AS d3, abs(a4 - b4) AS d4 FROM p""")
def sc7(spark, sf):
    d = _pairs(spark, sf).withColumn("d", N.name_distance(F.col("a"), F.col("b")))
    return d.select("a_id", "b_id", *[F.col(f"d.f{i}").alias(f"d{i}") for i in range(1, 5)])


@query("sc8_compare_distance", f"""
WITH p AS ({_PAIRS}) SELECT a_id, b_id, row(abs(a1 - b1), abs(a2 - b2), abs(a3 - b3), abs(a4 - b4)) < row(1, 1, 1, 1) AS nearer FROM p""")
def sc8(spark, sf):
    one = F.struct(*[F.lit(1).alias(f) for f in N.FIELDS])
    return _pairs(spark, sf).select("a_id", "b_id", (N.name_distance(F.col("a"), F.col("b")) < one).alias("nearer"))


@query("sc9_diploid", f"""
WITH p AS ({_PAIRS}), d AS (SELECT *, row(a1, a2, a3, a4) <= row(b1, b2, b3, b4) AS le FROM p)
SELECT a_id, b_id, CASE WHEN le THEN a1 ELSE b1 END AS low1, CASE WHEN le THEN a2 ELSE b2 END AS low2,
  CASE WHEN le THEN b1 ELSE a1 END AS up1, CASE WHEN le THEN b2 ELSE a2 END AS up2 FROM d""")
def sc9(spark, sf):
    d = _pairs(spark, sf).withColumn("d", N.diploid(F.col("a"), F.col("b")))
    return d.select("a_id", "b_id", F.col("d.lower.f1").alias("low1"), F.col("d.lower.f2").alias("low2"),
                    F.col("d.upper.f1").alias("up1"), F.col("d.upper.f2").alias("up2"))


_DIPLOIDS = f"""
WITH n AS ({NAMES}), x AS (SELECT a.allele_id AS id, row(a.f1, a.f2) AS a, row(b.f1, b.f2) AS b, row(c.f1, c.f2) AS c, row(d.f1, d.f2) AS d
  FROM n a JOIN n b ON b.allele_id = a.allele_id + 4 JOIN n c ON c.allele_id = a.allele_id + 8 JOIN n d ON d.allele_id = a.allele_id + 12),
s AS (SELECT id, least(a, b) AS la, greatest(a, b) AS ua, least(c, d) AS lc, greatest(c, d) AS uc FROM x)"""


def _diploids(spark, sf):
    n = names(spark, sf).select("allele_id", F.struct("f1", "f2", F.lit(0).alias("f3"), F.lit(0).alias("f4")).alias("p"))
    at = lambda k, c: n.select((F.col("allele_id") - k).alias("id"), F.col("p").alias(c))
    x = at(0, "a").join(at(4, "b"), "id").join(at(8, "c"), "id").join(at(12, "d"), "id")
    return x.select("id", N.diploid(F.col("a"), F.col("b")).alias("one"), N.diploid(F.col("c"), F.col("d")).alias("two"))


@query("sc10_diploid_match", f"{_DIPLOIDS} SELECT id, la = lc AND ua = uc AS both_match, la = lc OR ua = uc AS one_matches FROM s")
def sc10(spark, sf):
    return _diploids(spark, sf).select("id", N.diploid_match(F.col("one"), F.col("two")).alias("both_match"),
                                       N.diploid_match(F.col("one"), F.col("two"), both=False).alias("one_matches"))


@query("sc11_diploid_distance", f"""{_DIPLOIDS},
e AS (SELECT id, row(abs(la[1] - lc[1]), abs(la[2] - lc[2])) AS s1, row(abs(ua[1] - uc[1]), abs(ua[2] - uc[2])) AS s2,
  row(abs(la[1] - uc[1]), abs(la[2] - uc[2])) AS c1, row(abs(ua[1] - lc[1]), abs(ua[2] - lc[2])) AS c2 FROM s),
f AS (SELECT id, row(least(s1, s2), greatest(s1, s2)) AS st, row(least(c1, c2), greatest(c1, c2)) AS cr FROM e)
SELECT id, CAST(CASE WHEN cr < st THEN 1 ELSE 0 END AS INT) AS crossed, least(st, cr)[1][1] AS near1, least(st, cr)[1][2] AS near2,
  least(st, cr)[2][1] AS far1, least(st, cr)[2][2] AS far2 FROM f""")
def sc11(spark, sf):
    d = _diploids(spark, sf).withColumn("d", N.diploid_distance(F.col("one"), F.col("two"), 2))
    return d.select("id", F.col("d.crossed"), F.col("d.near.f1").alias("near1"), F.col("d.near.f2").alias("near2"),
                    F.col("d.far.f1").alias("far1"), F.col("d.far.f2").alias("far2"))


@query("sc12_parse_locus", f"""
WITH n AS ({NAMES}) SELECT allele_id, CASE WHEN split_part(raw, '*', 1) IN ({_LOCI}) THEN split_part(raw, '*', 1) END AS gene FROM n""")
def sc12(spark, sf):
    return names(spark, sf).select("allele_id", N.parse_locus(F.split_part("raw", F.lit("*"), F.lit(1))).alias("gene"))


@query("sc13_locus_group", f"WITH n AS ({NAMES}) SELECT allele_id, locus IN ('A', 'B', 'C') AS class_one FROM n")
def sc13(spark, sf):
    return names(spark, sf).select("allele_id", N.locus_in_group(F.col("locus"), "ClassI").alias("class_one"))


#: Sequences, and reads of 100 letters, from the documents' letters.
SEQUENCES = """
SELECT doc_id, lang, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq
FROM documents WHERE text IS NOT NULL"""


def sequences(spark, sf):
    return derive(spark, sf, text(SEQUENCES.replace(", 'g')", ")"), "documents"), "documents")


#: All stretches of 200 letters, as two reads each; the last of a text is filled up.
_SHORT = f"""WITH s AS (SELECT doc_id, k, substr(seq, CAST(200 * k + 1 AS INT), 100) AS seq, substr(seq, CAST(200 * k + 101 AS INT), 100) AS other
  FROM (SELECT doc_id, seq, unnest(range(length(seq) // 200)) AS k FROM (SELECT doc_id, rpad(seq, CAST((length(seq) + 199) // 200 * 200 AS INT), 'ACGT') AS seq FROM ({SEQUENCES}) x) z) y)"""


def _short(spark, sf):
    n = F.floor(F.length("seq") / 200)
    full = sequences(spark, sf).where("seq <> ''").withColumn("seq", F.expr("rpad(seq, cast((length(seq) + 199) div 200 * 200 AS int), 'ACGT')"))
    cut = full.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    at = lambda add: F.substring(F.col("seq"), (F.col("k") * 200 + add).cast("int"), F.lit(100))
    return cut.select("doc_id", "k", at(1).alias("seq"), at(101).alias("other"))


@query("sc14_complement", f"{_SHORT} SELECT doc_id, k, translate(seq, 'ACGT', 'TGCA') AS comp FROM s")
def sc14(spark, sf):
    return _short(spark, sf).select("doc_id", "k", V.complement(F.col("seq")).alias("comp"))


@query("sc15_reverse_complement", f"{_SHORT} SELECT doc_id, k, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM s")
def sc15(spark, sf):
    return _short(spark, sf).select("doc_id", "k", V.reverse_complement(F.col("seq")).alias("rc"))


_QUALITY = "(33 + ((doc_id * 31 + i * 17) % 41))"


def _with_quality(spark, sf):
    cells = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.char(33 + (F.col("doc_id") * 31 + i * 17) % 41))
    return _short(spark, sf).withColumn("qual", F.array_join(cells, ""))


@query("sc16_phred_prob", f"""{_SHORT}
SELECT doc_id, k, round(sum(pow(10.0, -({_QUALITY} - 33) / 10.0)), 6) AS expected_errors FROM s, range(100) r(i) GROUP BY doc_id, k""")
def sc16(spark, sf):
    p = F.aggregate(V.phred_prob(F.col("qual")), F.lit(0.0), lambda a, x: a + x)
    return _with_quality(spark, sf).select("doc_id", "k", F.round(p, 6).alias("expected_errors"))


@query("sc17_phred_log10", f"""{_SHORT}
SELECT doc_id, k, CAST(sum({_QUALITY} - 33) AS BIGINT) AS total_q, CAST(max({_QUALITY} - 33) AS BIGINT) AS best_q FROM s, range(100) r(i) GROUP BY doc_id, k""")
def sc17(spark, sf):
    q = F.transform(V.phred_log10(F.col("qual")), lambda x: F.round(x * -10).cast("long"))
    return _with_quality(spark, sf).withColumn("q", q).select(
        "doc_id", "k", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total_q"), F.array_max("q").alias("best_q"))


@query("sc18_phred_log_likelihood", f"""{_SHORT}
SELECT doc_id, k, round(sum(CASE WHEN substr(seq, i + 1, 1) = substr(other, i + 1, 1) THEN ln(1 - pow(10.0, -(3 + i % 30) / 10.0))
  ELSE ln(pow(10.0, -(3 + i % 30) / 10.0) / 3) END), 6) AS llhd FROM s, (SELECT CAST(range AS INT) AS i FROM range(100)) r GROUP BY doc_id, k""")
def sc18(spark, sf):
    errors = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.pow(F.lit(10.0), -(i % 30 + 3) / 10))
    return _short(spark, sf).select("doc_id", "k", F.round(V.phred_log_likelihood(F.col("seq"), F.col("other"), errors), 6).alias("llhd"))


_DIFF = "sum(CASE WHEN substr(seq, i + 1, 1) <> substr(other, i + 1, 1) THEN 1 ELSE 0 END)"


@query("sc19_mismatch_log_likelihood", f"""{_SHORT}
SELECT doc_id, k, round((100 - m) * ln(0.99) + m * ln(0.01 / 3), 6) AS llhd FROM
  (SELECT doc_id, k, {_DIFF} AS m FROM s, (SELECT CAST(range AS INT) AS i FROM range(100)) r GROUP BY doc_id, k)""")
def sc19(spark, sf):
    m = F.size(V.mismatch_indices(F.col("seq"), F.col("other")))
    return _short(spark, sf).select("doc_id", "k", F.round(V.mismatch_log_likelihood(F.length("seq"), m), 6).alias("llhd"))


@query("sc20_mismatch_indices", f"""{_SHORT}
SELECT doc_id, k, CAST({_DIFF} AS BIGINT) AS mismatches, CAST(sum(CASE WHEN substr(seq, i + 1, 1) <> substr(other, i + 1, 1) THEN i ELSE 0 END) AS BIGINT) AS index_sum
FROM s, (SELECT CAST(range AS INT) AS i FROM range(100)) r GROUP BY doc_id, k""")
def sc20(spark, sf):
    at = V.mismatch_indices(F.col("seq"), F.col("other"))
    return _short(spark, sf).withColumn("at", at).select("doc_id", "k", F.size("at").cast("long").alias("mismatches"),
                                                         F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + x).alias("index_sum"))


@query("sc21_levenshtein", f"{_SHORT} SELECT doc_id, k, CAST(levenshtein(seq, other) AS INT) AS edits FROM s")
def sc21(spark, sf):
    return _short(spark, sf).select("doc_id", "k", F.levenshtein("seq", "other").alias("edits"))


@query("sc22_valid_letter", """
WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag AS ch FROM lineitem)
SELECT l_orderkey, l_linenumber, regexp_full_match(ch, '[ACGTN]') AS dna, regexp_full_match(ch, '[ACDEFGHIKLMNPQRSTVWY]') AS protein FROM c""")
def sc22(spark, sf):
    c = derive(spark, sf, "SELECT l_orderkey, l_linenumber, l_returnflag AS ch FROM {lineitem}", "lineitem")
    return c.select("l_orderkey", "l_linenumber", V.valid_letter(F.col("ch"), "cdna").alias("dna"), V.valid_letter(F.col("ch"), "protein").alias("protein"))


_LOGS = "SELECT l_orderkey, l_linenumber, -(l_quantity / 10) AS a, -(l_discount * 10 + 0.05) AS b FROM lineitem"


def _logs(spark, sf):
    return derive(spark, sf, text(_LOGS, "lineitem"), "lineitem")


@query("sc23_log10_ring", f"""
SELECT l_orderkey, l_linenumber, round(log10(pow(10, a) + pow(10, b)), 6) AS plus, round(a + b, 6) AS times, round(a - b, 6) AS over,
  round(3 * a, 6) AS cubed, round(log10(1 - pow(10, b)), 6) AS one_minus, round(a - log10(3), 6) AS third FROM ({_LOGS})""")
def sc23(spark, sf):
    a, b = F.col("a"), F.col("b")
    r = lambda c, n: F.round(c, 6).alias(n)
    return _logs(spark, sf).select("l_orderkey", "l_linenumber", r(V.log10_add(a, b), "plus"), r(a + b, "times"), r(a - b, "over"), r(3 * a, "cubed"),
                                   r(V.log10_one_minus(b), "one_minus"), r(a - F.log10(F.lit(3.0)), "third"))


@query("sc24_ln_ring", f"SELECT l_orderkey, l_linenumber, round(ln(exp(a) + exp(b)), 6) AS plus, round(a + b, 6) AS times, round(exp(a) * exp(b), 6) AS plain FROM ({_LOGS})")
def sc24(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _logs(spark, sf).select("l_orderkey", "l_linenumber", F.round(V.ln_add(a, b), 6).alias("plus"), F.round(a + b, 6).alias("times"),
                                   F.round(F.exp(a) * F.exp(b), 6).alias("plain"))


@query("sc25_close_enough", f"SELECT l_orderkey, l_linenumber, abs(a - b) < 0.5 AS near FROM ({_LOGS})")
def sc25(spark, sf):
    return _logs(spark, sf).select("l_orderkey", "l_linenumber", V.close_enough(F.col("a"), F.col("b"), 0.5).alias("near"))


@query("sc26_gap_aware_compare", f"""
SELECT l_orderkey, min(CASE WHEN l_linenumber = 2 THEN -1e9 ELSE a END) AS least_value, CAST(count(*) AS BIGINT) AS n FROM ({_LOGS}) GROUP BY l_orderkey""")
def sc26(spark, sf):
    gap = F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(F.col("a"))
    least = F.min(V.gap_aware(gap))
    return _logs(spark, sf).groupBy("l_orderkey").agg(F.greatest(least, F.lit(-1e9)).alias("least_value"), F.count("*").alias("n"))


@query("sc27_floor_precision", f"SELECT l_orderkey, l_linenumber, floor(a * 100) / 100.0 AS floored FROM ({_LOGS})")
def sc27(spark, sf):
    return _logs(spark, sf).select("l_orderkey", "l_linenumber", V.floor_precision(F.col("a"), 2).alias("floored"))


_KIND = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'UTR5' WHEN 1 THEN 'Exon' WHEN 2 THEN 'Intron' ELSE 'UTR3' END AS kind, CAST(p_partkey % 9 AS INT) AS n FROM part"


@query("sc28_region_label", f"""
SELECT id, CASE kind WHEN 'Exon' THEN concat('Exon ', n) WHEN 'Intron' THEN concat('Intron ', n) ELSE kind END AS label,
  CASE kind WHEN 'Exon' THEN concat('X', n) WHEN 'Intron' THEN concat('I', n) WHEN 'UTR5' THEN 'U5' ELSE 'U3' END AS short_label FROM ({_KIND})""")
def sc28(spark, sf):
    k = derive(spark, sf, text(_KIND, "part"), "part")
    return k.select("id", V.region_label(F.col("kind"), F.col("n")).alias("label"), V.region_label(F.col("kind"), F.col("n"), short=True).alias("short_label"))


@query("sc29_short_seq", f"""
WITH s AS (SELECT doc_id, seq FROM ({SEQUENCES}) x)
SELECT doc_id, CASE WHEN length(seq) > 10 THEN concat(left(seq, 4), '...', right(seq, 3)) ELSE seq END AS shown FROM s""")
def sc29(spark, sf):
    return sequences(spark, sf).select("doc_id", V.short_seq(F.col("seq")).alias("shown"))


@query("sc30_safe_file_name", f"WITH n AS ({NAMES}) SELECT allele_id, replace(replace(raw, '*', 's'), ':', 'c') AS file_name FROM n")
def sc30(spark, sf):
    return names(spark, sf).select("allele_id", N.safe_file_name(F.col("raw")).alias("file_name"))


@query("sc31_pair_index", """
WITH p AS (SELECT p_partkey AS n, p_partkey // 3 AS i, p_partkey // 2 AS j FROM part WHERE p_partkey > 3)
SELECT n, i, j, i * n - i * (i - 1) // 2 + j - i AS k, i AS back_i, j AS back_j FROM p""")
def sc31(spark, sf):
    p = derive(spark, sf, "SELECT p_partkey AS n, p_partkey div 3 AS i, p_partkey div 2 AS j FROM {part} WHERE p_partkey > 3", "part")
    p = p.withColumn("k", V.pair_index(F.col("i"), F.col("j"), F.col("n"))).withColumn("b", V.pair_of_index(F.col("k"), F.col("n")))
    return p.select("n", "i", "j", "k", F.col("b.i").alias("back_i"), F.col("b.j").alias("back_j"))


@query("sc32_alteration_text", f"""
WITH n AS ({NAMES}) SELECT allele_id, concat(allele, ' nearest (d: ', f1, '.000000) positions: [[X', f2, ':', CASE WHEN f3 = 0 THEN 'full' ELSE 'partial' END, ':', f1, ',',
  f1 + 10, ')]') AS txt FROM n""")
def sc32(spark, sf):
    seg = F.array(F.struct((F.col("f3") == 0).alias("full"), F.concat(F.lit("X"), "f2").alias("region"), F.col("f1").alias("start"), (F.col("f1") + 10).alias("end")))
    return names(spark, sf).select("allele_id", V.alteration_text(F.col("allele"), F.lit("nearest"), F.col("f1").cast("double"), seg).alias("txt"))


@query("flt1_select_by_regex", f"WITH n AS ({NAMES}) SELECT allele_id, allele FROM n WHERE regexp_matches(allele, 'A\\*0[12]')")
def flt1(spark, sf):
    from ..operators.select import select_by_regex

    return select_by_regex(names(spark, sf), r"A\*0[12]").select("allele_id", "allele")


@query("flt2_select_specific", f"WITH n AS ({NAMES}) SELECT allele_id, allele FROM n WHERE allele IN ('A*05:05', 'B*02:02:01:01')")
def flt2(spark, sf):
    from ..operators.select import select_specific

    return select_specific(names(spark, sf), ["A*05:05", "B*02:02:01:01"]).select("allele_id", "allele")


@query("flt3_select_number", f"""
WITH n AS ({NAMES}) SELECT locus, allele_id FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY f1, f2, f3, f4, allele, allele_id) AS r FROM n) WHERE r <= 5""")
def flt3(spark, sf):
    from ..operators.select import select_number

    return select_number(names(spark, sf), 5, "allele_id").select("locus", "allele_id")


@query("flt4_drop_suffixed", f"WITH n AS ({NAMES}) SELECT allele_id, allele FROM n WHERE suffix IS NULL")
def flt4(spark, sf):
    from ..operators.select import drop_suffixed

    return drop_suffixed(names(spark, sf)).select("allele_id", "allele")


@query("flt5_apply_selectors", f"""
WITH n AS ({NAMES}) SELECT allele_id, allele FROM n WHERE suffix IS NULL AND (regexp_matches(allele, '^B') OR allele = 'A*05:05')""")
def flt5(spark, sf):
    from ..operators.select import apply_selectors

    return apply_selectors(names(spark, sf), regexes=["^B"], specific=["A*05:05"]).select("allele_id", "allele")


@query("flt6_drop_splice_variants", f"WITH n AS ({NAMES}) SELECT allele_id FROM n WHERE allele NOT IN ({', '.join(repr(x) for v in N.SPLICE_VARIANTS.values() for x in v)})")
def flt6(spark, sf):
    from ..operators.select import drop_splice_variants

    return drop_splice_variants(names(spark, sf)).select("allele_id")


@query("flt15_locus_supported", f"WITH n AS ({NAMES}) SELECT allele_id, locus IN ('A', 'B', 'C') AS supported FROM n")
def flt15(spark, sf):
    return names(spark, sf).select("allele_id", N.locus_supported(F.col("locus")).alias("supported"))


@query("srt1_nomenclature_order", f"""
WITH n AS ({NAMES}) SELECT locus, allele_id, row_number() OVER (PARTITION BY locus ORDER BY f1, f2, f3, f4, allele_id) AS place FROM n""")
def srt1(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("locus").orderBy(N.order_key(F.struct("f1", "f2", "f3", "f4")), "allele_id")
    return names(spark, sf).select("locus", "allele_id", F.row_number().over(w).alias("place"))


_SETS = f"""
WITH n AS ({NAMES}), whole AS (SELECT locus, list(DISTINCT allele ORDER BY allele) AS e FROM n GROUP BY locus),
s AS (SELECT w.locus, e, list_sort(list_filter(e, lambda x: regexp_matches(x, ':0[12]'))) AS a, list_sort(list_filter(e, lambda x: regexp_matches(x, '\\*0[1-3]'))) AS b FROM whole w)"""


def _sets(spark, sf):
    from ..operators.sets import allele_set

    n = names(spark, sf)
    return n.groupBy("locus").agg(allele_set("allele").alias("e"), allele_set("allele", F.col("allele").rlike(":0[12]")).alias("a"),
                                  allele_set("allele", F.col("allele").rlike(r"\*0[1-3]")).alias("b"))


_LISTED = "array_to_string({}, ';')"


@query("set1_union", f"{_SETS} SELECT locus, {_LISTED.format('list_sort(list_distinct(list_concat(a, b)))')} AS members FROM s")
def set1(spark, sf):
    from ..operators import sets as S

    return _sets(spark, sf).select("locus", S.listed(S.union(F.col("a"), F.col("b"))).alias("members"))


@query("set2_intersection", f"{_SETS} SELECT locus, {_LISTED.format('list_sort(list_intersect(a, b))')} AS members FROM s")
def set2(spark, sf):
    from ..operators import sets as S

    return _sets(spark, sf).select("locus", S.listed(S.intersection(F.col("a"), F.col("b"))).alias("members"))


@query("set3_difference", f"{_SETS} SELECT locus, {_LISTED.format('list_filter(a, lambda x: NOT list_contains(b, x))')} AS members FROM s")
def set3(spark, sf):
    from ..operators import sets as S

    return _sets(spark, sf).select("locus", S.listed(S.difference(F.col("a"), F.col("b"))).alias("members"))


@query("set4_inter_diff", f"{_SETS} SELECT locus, CAST(len(list_intersect(a, b)) AS INT) AS shared, CAST(len(a) - len(list_intersect(a, b)) AS INT) AS rest, len(list_intersect(a, b)) = len(a) AS identical, len(list_intersect(a, b)) = 0 AS disjoint FROM s")
def set4(spark, sf):
    from ..operators import sets as S

    x = _sets(spark, sf).withColumn("x", S.inter_diff(F.col("a"), F.col("b")))
    return x.select("locus", F.size("x.inter").alias("shared"), F.size("x.diff").alias("rest"), "x.identical", "x.disjoint")


@query("set5_complement", f"{_SETS} SELECT locus, {_LISTED.format('list_filter(e, lambda x: NOT list_contains(a, x))')} AS members FROM s")
def set5(spark, sf):
    from ..operators import sets as S

    return _sets(spark, sf).select("locus", S.listed(S.difference(F.col("e"), F.col("a"))).alias("members"))


@query("set6_membership", f"{_SETS} SELECT locus, list_contains(a, 'A*01:01') AS has_it, CAST(len(a) AS INT) AS members, CAST(len(list_distinct(list_append(a, 'A*01:01'))) AS INT) AS with_it, CAST(len(list_filter(a, lambda x: x <> 'A*01:01')) AS INT) AS without_it FROM s")
def set6(spark, sf):
    from ..operators import sets as S

    one = F.lit("A*01:01")
    return _sets(spark, sf).select("locus", F.array_contains("a", one).alias("has_it"), F.size("a").alias("members"),
                                   F.size(S.with_member(F.col("a"), one)).alias("with_it"), F.size(S.without_member(F.col("a"), one)).alias("without_it"))


@query("set7_readable", f"""{_SETS} SELECT locus, left(CASE WHEN len(a) = len(e) THEN 'Everything' WHEN len(a) = 0 THEN 'Nothing'
  WHEN len(a) <= len(e) // 2 THEN array_to_string(a, ';') ELSE concat('C. of ', array_to_string(list_filter(e, lambda x: NOT list_contains(a, x)), ';')) END, 1000) AS shown FROM s""")
def set7(spark, sf):
    from ..operators import sets as S

    return _sets(spark, sf).select("locus", S.readable(F.col("a"), F.col("e")).alias("shown"))


@query("set8_map_algebra", f"""
WITH n AS ({NAMES}), m AS (SELECT locus, allele, min(allele_id) AS v FROM n GROUP BY locus, allele)
SELECT locus, v % 10 AS value, string_agg(allele, ';' ORDER BY allele) AS members FROM m GROUP BY locus, v % 10""")
def set8(spark, sf):
    from ..operators import sets as S

    values = names(spark, sf).groupBy("locus", "allele").agg(F.min("allele_id").alias("value"))
    return S.inverted(S.map_values(values, F.col("value") % 10)).select("locus", "value", S.listed(F.col("alleles")).alias("members"))
