"""Scoring and typing of reads against plain recurrences and against the long form."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtype.operators import kernel as K
from loomtype.operators import score as S
from loomtype.operators.pairs import pair_log_likelihood, pair_sums_blocked
from test_kernel import plain


def related(n, length, seed=1, changes=3):
    dice = random.Random(seed)
    base = "".join(dice.choice("ACGT") for _ in range(length))
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(dice.randrange(changes + 1)):
            own[dice.randrange(length)] = dice.choice("ACGT")
        out.append("".join(own))
    return out


def reads_of(spark, seqs, mates=False, sample=None):
    dice = random.Random(7)
    rows = [(i // 2 if mates else i, i % 2 + 1 if mates else 0, s, [dice.randrange(15, 40) for _ in s], sample) for i, s in enumerate(seqs)]
    frame = spark.createDataFrame(rows, "read_id long, mate int, seq string, q array<int>, sample string")
    return frame if sample else frame.drop("sample")


def emissions_of(spark, alleles):
    return S.build_emissions(spark.createDataFrame(alleles, "allele_id long, locus string, seq string"))


def test_a_trie_shares_cells_of_equal_beginnings_and_changes_no_score():
    alleles = related(40, 120, changes=2)
    matrix, lengths = K.encode(alleles)
    shared, apart = K.Alleles(matrix, lengths), K.Alleles(matrix, lengths, nodes=1)
    beginnings = len({a[: k + 1] for a in alleles for k in range(len(a))})
    assert shared.nodes == beginnings < 0.7 * apart.nodes and apart.nodes == sum(map(len, alleles))
    codes, errors = K.read_codes([alleles[0][30:60], alleles[1][:30]], [[30] * 30] * 2)
    t = K.transitions(30, 120)
    for start in (None, np.array([0, 25])):
        a, b = (K.forward_scores(codes, errors, x, t, start=start, median=True) for x in (shared, apart))
        assert np.allclose(a.value, b.value, atol=1e-10) and np.array_equal(a.pos, b.pos) and np.allclose(a.median, b.median)


def test_alleles_far_below_the_best_keep_their_likelihood():
    read = "ACGTTGCAAG" * 50
    alleles = [read, "T" * 500]
    t = K.transitions(len(read), 510)
    value, pos, _ = K.forward(read, [60] * len(read), *K.encode(alleles), t)
    alone, _, _ = K.forward(read, [60] * len(read), *K.encode(alleles[1:]), t)
    assert np.isfinite(value).all() and value[1] < value[0] - 600 and abs(value[1] - alone[0]) < 1e-6


def test_filters_look_at_all_alleles_of_a_gene(spark):
    dice = random.Random(3)
    alleles = [(i, "A", "".join(dice.choice("ACGT") for _ in range(24))) for i in range(600)]
    read = alleles[444][2][4:20]
    reads = reads_of(spark, [read, "".join(dice.choice("ACGT") for _ in range(16))]).withColumn("rc", F.lit(False))
    got = S.forward_scores(reads, emissions_of(spark, alleles), allowed_mismatches=1).groupBy("read_id", "filter_reason").count().collect()
    assert {(r["read_id"], r["filter_reason"], r["count"]) for r in got} == {(0, None, 600), (1, "mismatches", 600)}


def test_scores_of_stretches_are_those_of_the_plain_recurrence(spark):
    alleles = related(5, 90, 5, 6)
    seqs = [alleles[0][10:60], alleles[3][:50], alleles[2][70:] + "ACGT"]
    reads = reads_of(spark, seqs)
    table = {r["read_id"]: r for r in reads.collect()}
    got = S.forward_scores(S.oriented(reads), emissions_of(spark, [(i, "A", a) for i, a in enumerate(alleles)]))
    rows = got.collect()
    assert len(rows) == 30
    for r in rows:
        seq, q = table[r["read_id"]]["seq"], list(table[r["read_id"]]["q"])
        if r["rc"]:
            seq, q = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1], q[::-1]
        value, pos = plain(seq, q, alleles[r["allele_id"]], K.transitions(len(seq), 90))
        assert abs(value - r["llhd"]) < 1e-9 and pos == r["pos"]


def test_a_split_read_begins_its_next_part_where_the_last_ended():
    alleles = related(4, 60, 9, 2)
    read, q = alleles[0][12:42], [30] * 30
    got = K.split_scores(*K.read_codes([read], [q]), K.Alleles(*K.encode(alleles)), 60, 2)
    first = [plain(read[:15], q[:15], a, K.transitions(15, 60)) for a in alleles]
    best = max(v for v, _ in first)
    start = min(p for v, p in first if v >= best - 5e-10)
    assert start == 26
    t = K.transitions(15, 60 - start)
    for k, a in enumerate(alleles):
        value, pos = plain(read[15:], q[15:], a[start:], t)
        assert abs(first[k][0] + value - math.log10(t.sm * t.me) - got.value[0, k]) < 1e-9 and got.pos[0, k] == pos + start
    late = K.split_scores(*K.read_codes([alleles[0][-20:] + "ACGTACGTAC"], [q]), K.Alleles(*K.encode(alleles)), 60, 2)
    assert late.why[0] == "reference end" and not np.isfinite(late.value).any()


def test_the_threshold_runs_over_orientations_and_genes(spark):
    alleles = [(i, "A", a) for i, a in enumerate(related(6, 60, 2))] + [(10 + i, "B", a) for i, a in enumerate(related(7, 60, 8))]
    seqs = [alleles[0][2][10:40], alleles[8][2][5:35]]
    reads = reads_of(spark, seqs)
    got = {(r["read_id"], r["locus"], r["rc"]): r["filter_reason"] for r in S.past_threshold_scores(reads, emissions_of(spark, alleles)).collect()}
    for r in reads.collect():
        threshold = -np.inf
        for locus in "AB":
            own = K.Alleles(*K.encode([a for _, x, a in alleles if x == locus]))
            for rc in (False, True):
                seq, q = (r["seq"].translate(str.maketrans("ACGT", "TGCA"))[::-1], r["q"][::-1]) if rc else (r["seq"], r["q"])
                plainly = K.forward_scores(*K.read_codes([seq], [list(q)]), own, K.transitions(30, 60), median=True)
                passed = K.forward_scores(*K.read_codes([seq], [list(q)]), own, K.transitions(30, 60), thresholds=np.array([threshold])).why[0] == ""
                assert got[r["read_id"], locus, rc] == (None if passed else "threshold")
                threshold = max(threshold, plainly.median[0]) if passed else threshold
    assert got[0, "A", False] is None and got[0, "A", True] == got[0, "B", False] == "threshold" and got[1, "B", False] is None


@pytest.mark.parametrize("mates,multi_locus,report", [(False, True, 3), (True, True, 5), (True, False, None)])
def test_typing_by_vectors_is_typing_by_rows(spark, mates, multi_locus, report):
    alleles = [(i, "A", a) for i, a in enumerate(related(7, 70, 2))] + [(20 + i, "B", a) for i, a in enumerate(related(6, 70, 8))] + [(40, "A", related(7, 70, 2)[3])]
    dice = random.Random(4)
    seqs = []
    for _ in range(30):
        a, at = dice.choice(alleles)[2], dice.randrange(40)
        seqs.append(a[at : at + 25] if dice.random() < 0.6 else a[at : at + 25].translate(str.maketrans("ACGT", "TGCA"))[::-1])
    reads = reads_of(spark, seqs, mates, "s1").unionByName(reads_of(spark, seqs[::-1][:20], mates, "s2"))
    emissions = emissions_of(spark, alleles)
    rows = S.type_samples(S.forward_scores(S.oriented(reads), emissions), 80, report, multi_locus)
    vectors = S.type_reads(reads, emissions, 80, report, multi_locus)
    for name, key in (("posterior", ["sample", "locus", "i", "j"]), ("alleles", ["sample", "locus", "allele_id"]), ("assignment", ["sample", "read_id"])):
        a, b = ({tuple(r[k] for k in key): r for r in x[name].collect()} for x in (rows, vectors))
        assert a and a.keys() == b.keys()
        for k in a:
            assert all(x == pytest.approx(b[k][c], abs=1e-9) if isinstance(x, float) else x == b[k][c] for c, x in a[k].asDict().items())


def test_sums_of_blocks_keep_samples_apart_and_need_no_complete_scores(spark):
    dice = random.Random(6)
    rows = [(s, r, "A", a, -dice.random(), 1) for s in ("x", "y") for r in range(40) for a in range(0, 900, 3) if (r + a) % 7]
    scores = spark.createDataFrame(rows, "sample string, read_id long, locus string, allele_id long, llhd double, pos long")
    for lane_bytes in (1 << 26, 1 << 12):
        a, b = ({(r["sample"], r["i"], r["j"]): (r["z"], r["reads"]) for r in f(scores).collect()} for f in (pair_log_likelihood, lambda x: pair_sums_blocked(x, lane_bytes=lane_bytes)))
        assert a.keys() == b.keys() and all(x[1] == b[k][1] and abs(x[0] - b[k][0]) < 1e-9 for k, x in a.items())


def test_no_row_holds_a_read_and_a_pair(spark):
    vectors = spark.createDataFrame([(1, "A", [0.0, -1.0], [1, 2])], "read_id long, locus string, llhd array<double>, pos array<long>")
    from loomtype.operators.vectors import pair_sums

    plan = pair_sums(vectors, {"A": np.array([3, 5])})._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_mates_take_opposite_strands_together(spark):
    dice = random.Random(12)
    allele = "".join(dice.choice("ACGT") for _ in range(80))
    turned = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    one, two = allele[5:35], allele[40:70]  # both like the regular strand, the first a little less
    one = one[:10] + ("A" if one[10] != "A" else "C") + one[11:]
    rows = [(1, 1, one, [30] * 30), (1, 2, two, [30] * 30), (2, 1, allele[5:35], [30] * 30), (2, 2, turned(allele[40:70]), [30] * 30)]
    reads = spark.createDataFrame(rows, "read_id long, mate int, seq string, q array<int>")
    got = {(r["read_id"], r["mate"]): r["rc"] for r in S.viterbi_align(S.oriented(reads), 1, allele, 80).collect()}
    assert got == {(1, 1): True, (1, 2): False, (2, 1): False, (2, 2): True}


def test_a_typed_sample_goes_through_both_reports(spark, tmp_path):
    from loomtype.sources import reads as R
    from loomtype.sources import sinks as W

    alleles = [(i, "A", a) for i, a in enumerate(related(5, 60, 2))]
    seqs = [alleles[k % 3][2][k : k + 25] for k in range(20)]
    typed = S.type_reads(reads_of(spark, seqs, sample="s1"), emissions_of(spark, alleles), 60, 4)
    names = spark.createDataFrame([("A", i, f"A*0{i}") for i in range(5)], "locus string, allele_id long, allele string")
    altered = spark.createDataFrame([("A", "A*01", "A*00 imputed (d: 0.5) positions: [[2:full:1,9)]")], "locus string, allele string, text string")
    report = W.full_report(typed, names, alterations=altered)
    documents = W.typing_document(*report, "loomtype\nrun 1", reads_per_row=6)
    assert documents.count() > 1 and documents.where("size(per_reads) > 15").count() == 0
    W.write_typing_json(documents, str(tmp_path / "j"))
    reloaded = R.read_typing_json(spark, str(tmp_path / "j"))
    W.write_typing_tsv(*report, str(tmp_path / "a"), "loomtype\nrun 1")
    W.json_to_tsv(reloaded, str(tmp_path / "b"))
    for table in ("zygosity", "likelihood", "per_read"):
        one, two = (sorted(tuple(r) for r in W.read_typing_tsv(spark, str(tmp_path / x), table).collect()) if table != "likelihood" else
                    sorted((r["allele"], r["llhd"], r["imputation"] or "") for r in W.read_typing_tsv(spark, str(tmp_path / x), table).collect()) for x in "ab")
        assert one == two and one
    pair = W.read_typing_tsv(spark, str(tmp_path / "b"), "zygosity").orderBy("rank").first()
    assert float(pair["reads1"]) + float(pair["reads2"]) == 20 and pair["e1"].startswith("[") and "," in pair["e1"]
    weights = [float(x.split(",")[1]) for side in ("e1", "e2") for x in pair[side].strip("[]").split(";") if x]
    assert sum(weights) == 20
    assert {r["imputation"] for r in W.read_typing_tsv(spark, str(tmp_path / "b"), "likelihood").where("allele = 'A*01'").collect()} == {"A*00 imputed (d: 0.5) positions: [[2:full:1,9)]"}
    assert [r["value"] for r in spark.read.text(str(tmp_path / "b/header")).collect()] == ["loomtype", "run 1"]


def test_orientation_is_chosen_where_a_read_is_scored(spark):
    from loomtype.operators.pairs import best_orientation

    dice = random.Random(12)
    draw = lambda n: "".join(dice.choice("ACGT") for _ in range(n))
    genes = [(a, "AB"[a % 2], draw(30)) for a in range(6)]
    seqs = [genes[k % 6][2][3:15] if k % 3 else draw(12) for k in range(20)] + ["ACGTACGTACGT"]  # the last is its own reverse complement
    emissions = S.build_emissions(spark.createDataFrame(genes, "allele_id long, locus string, seq string"))
    reads = spark.createDataFrame([(k, 0, s, [30] * len(s)) for k, s in enumerate(seqs)], "read_id long, mate int, seq string, q array<int>")
    one = S.best_orientation_scores(reads, emissions, allowed_mismatches=2)
    two = best_orientation(S.forward_scores(S.oriented(reads), emissions, allowed_mismatches=2))
    key = lambda rows: sorted((r["read_id"], r["locus"], r["allele_id"], r["rc"], r["pos"], r["llhd"], r["filter_reason"]) for r in rows.collect())
    assert key(one) == key(two) and {r[-1] for r in key(one)} == {None, "mismatches"}
    assert "Exchange hash" not in one._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_gene_become_objects_once_a_batch(spark, monkeypatch):
    from loomtype.operators import vectors as V

    dice = random.Random(3)
    data = [(r, "AB"[r % 2], a, -dice.randrange(1, 9) / 4, dice.randrange(4)) for r in range(60) for a in dice.sample(range(5), 4)]
    scores = spark.createDataFrame(data, "read_id long, locus string, allele_id long, llhd double, pos long")
    vectors, ids = V.to_vectors(scores)
    top = pair_log_likelihood(scores).select("locus", "i", "j")
    monkeypatch.setattr(V, "READS", 7)
    from loomtype.operators.pairs import pair_emissions

    got = {tuple(r) for r in V.vector_emissions(vectors, top, ids).select("locus", "i", "j", "side", "pos", "weight").collect()}
    assert got == {tuple(r) for r in pair_emissions(scores, top).select("locus", "i", "j", "side", "pos", "weight").collect()}
    assert "MapInArrow" in V.vector_emissions(vectors, top, ids)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("allowed_mismatches", [None, 2])
def test_reads_are_scored_exactly_on_their_best_gene_only(monkeypatch, allowed_mismatches):
    """Reads of a gene, reads of none, reads that are filtered and equally good genes: the same choice as by all scores."""
    dice = random.Random(12)
    shared = "".join(dice.choice("ACGT") for _ in range(70))
    groups = [[*related(7, 70, 3), shared], [*related(6, 70, 8), shared], related(5, 70, 9)]
    genes = [S.Gene(name, 75, K.Alleles(*K.encode(sorted(set(own)))), np.arange(len(set(own))), np.arange(len(set(own)))) for name, own in zip("ABC", groups)]
    seqs = [dice.choice(dice.choice(groups))[at : at + 25] for at in [dice.randrange(40) for _ in range(60)]] + [shared[5:30]] + ["".join(dice.choice("ACGT") for _ in range(25)) for _ in range(10)]
    seqs = [s if dice.random() < 0.5 else s.translate(str.maketrans("ACGT", "TGCA"))[::-1] for s in seqs]
    mates = [[{"mate": 0, "seq": s, "q": [dice.randrange(15, 40) for _ in s]}] for s in seqs]
    mates += [[{**a[0], "mate": 1}, {**b[0], "mate": 2}] for a, b in zip(mates[:5], mates[5:10])]
    frame = pd.DataFrame({"mates": mates})
    cells = []
    scored = K.forward_scores
    monkeypatch.setattr(K, "forward_scores", lambda codes, *a, **k: (cells.append(len(codes)), scored(codes, *a, **k))[1])
    plain = {r: x for r, *x in S._best_gene(frame, genes, True, True, allowed_mismatches)}
    most, again = sum(cells), []
    cells.clear()
    got = {r: x for r, *x in S._best_gene(frame, genes, True, True, allowed_mismatches, again)}
    assert got.keys() == plain.keys() and (allowed_mismatches or len(got) == len(frame))
    for r, (locus, sums, pos) in plain.items():
        assert got[r][0] == locus and np.abs(got[r][1] - sums).max() < 1e-9 and (got[r][2] == pos).all()
    assert allowed_mismatches or sum(cells) < most / 2


def test_reads_of_one_length_come_to_few_tasks(spark):
    rows = [(i, [(0, "A" * (i % 20 + 1))]) for i in range(2000)]
    dealt = S._by_length(spark.createDataFrame(rows, "read_id long, mates array<struct<mate:int,seq:string>>"), 8)
    got = dealt.select(F.spark_partition_id().alias("p"), F.length(F.get("mates", F.lit(0))["seq"]).alias("n")).groupBy("p", "n").count().collect()
    assert sum(r["count"] for r in got) == 2000 and len({r["p"] for r in got}) == 8 and len(got) <= 8 + 20
