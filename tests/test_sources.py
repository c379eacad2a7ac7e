"""Files in, files out."""

import pytest
from pyspark.sql import functions as F

from loomtype.functions.values import pair_index, pair_of_index
from loomtype.operators import msa
from loomtype.sources import reads as R
from loomtype.sources import sinks as K


def test_fastq_round_trip(spark, tmp_path):
    text = "@a/1 x\nACGT\n+\n@III\n@b\nAC\n+\nIII\n@c\nGGGT\n+c\nIIII\n"
    (tmp_path / "s1_1.fastq").write_text(text)
    good, bad = R.read_fastq(spark, str(tmp_path / "s1_1.fastq"), mate=1)
    rows = {r["name"]: r for r in good.collect()}
    assert set(rows) == {"a", "c"} and bad.count() == 1
    assert rows["a"]["q"] == [31, 40, 40, 40] and rows["a"]["sample"] == "s1"
    K.write_fastq_subset(good, spark.createDataFrame([("c",)], "name string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).where("value LIKE '@%'").count() == 1


def test_fasta_round_trip(spark, tmp_path):
    seqs = spark.createDataFrame([("A", "A*01:01", 1, 1, 0, 0, "ACGTACGTAC"), ("A", "A*02:01", 2, 1, 0, 0, "AC")],
                                 "locus string, allele string, f1 int, f2 int, f3 int, f4 int, seq string")
    K.write_fasta(seqs.coalesce(1), str(tmp_path / "f"), width=4)
    back = {r["description"]: r["sequence"] for r in R.read_fasta(spark, str(tmp_path / "f")).collect()}
    assert back == {"A*01:01 length: 10": "ACGTACGTAC", "A*02:01 length: 2": "AC"}


ALIGNMENT = """# file: A_nuc.txt
# date: 2018-01-01
# version: IPD-IMGT/HLA 3.33.0

 cDNA              -2
                   |
 A*01:01           ACGT.A|CGG TT
 A*02:01           ---A.-|*** --
 A*03:01           ----G-|--. -C

 cDNA              12
 A*01:01           GG
 A*02:01           -*
 A*03:01           -T
Please see the notes
 A*09:01           ACGT
"""


def test_alignment_rules(spark, tmp_path):
    (tmp_path / "A_nuc.txt").write_text(ALIGNMENT)
    streams, files = R.read_alignments(spark, str(tmp_path / "A_nuc.txt"))
    assert files.first()["release"] == "3.33.0" and files.first()["align_date"] == "2018-01-01"
    got = {r["allele"]: r for r in streams.collect()}
    assert set(got) == {"A*01:01", "A*02:01", "A*03:01"} and got["A*01:01"]["is_ref"] and got["A*01:01"]["start_pos"] == -2
    positions = msa.parse_streams(streams)
    resolved = msa.resolve_to_reference(positions)
    seqs = {r["allele"]: r["seq"] for r in msa.allele_sequences(resolved, boundary="|").collect()}
    assert seqs == {"A*01:01": "ACGTA|CGGTTGG", "A*02:01": "ACGAA|TTG", "A*03:01": "ACGTGA|CGTCGT"}
    filled, alterations = msa.impute_missing(resolved, msa.reference_distances(streams))
    seqs = {r["allele"]: r["seq"] for r in msa.allele_sequences(filled).collect()}
    assert seqs["A*02:01"] == "ACGAACGGTTGG"
    assert {(r["start"], r["end"], r["full"]) for r in alterations.collect()} == {(4, 7, False), (10, 11, False)}


def test_wrong_letter_is_an_error(spark):
    bad = spark.createDataFrame([("A", "nuc", "A*01:01", True, 1, "AC?T")], "locus string, source string, allele string, is_ref boolean, start_pos int, stream string")
    with pytest.raises(Exception, match="wrong letter"):
        msa.parse_streams(bad).collect()


def test_genomic_regions(spark):
    gen = spark.createDataFrame([("A", "gen", "A*01:01", True, -2, "AC|GT|AA|CC|GG")], "locus string, source string, allele string, is_ref boolean, start_pos int, stream string")
    rows = msa.parse_streams(gen).select("region_ix", "region_kind", "region_n").distinct().orderBy("region_ix").collect()
    assert [(r[1], r[2]) for r in rows] == [("UTR5", 0), ("Exon", 1), ("Intron", 1), ("Exon", 2), ("UTR3", 0)]


def test_merge_keeps_exons_and_introns(spark):
    ddl = "locus string, source string, allele string, is_ref boolean, start_pos int, stream string"
    gen = msa.resolve_to_reference(msa.parse_streams(spark.createDataFrame([("A", "gen", "A*01", True, -1, "AC|GT|AA|CC|GG"), ("A", "gen", "A*02", False, -1, "--|--|-T|--|--")], ddl)))
    nuc = msa.resolve_to_reference(msa.parse_streams(spark.createDataFrame([("A", "nuc", "A*01", True, 1, "G.T|CC"), ("A", "nuc", "A*02", False, 1, "-A-|--"), ("A", "nuc", "A*03", False, 1, "-.A|-T")], ddl)))
    merged = msa.merge_gen_nuc(gen, nuc)
    seqs = {r["allele"]: r["seq"] for r in msa.allele_sequences(merged).collect()}
    assert seqs == {"A*01": "ACGTAACCGG", "A*02": "ACGATATCCGG"}
    near = spark.createDataFrame([("A", "A*03", "A*01", 1)], "locus string, target string, candidate string, rank int")
    seqs = {r["allele"]: r["seq"] for r in msa.allele_sequences(msa.merge_nearest_donor(merged, nuc, near, msa.merge_segments(gen, nuc))).collect()}
    assert seqs["A*03"] == "ACGAAACTGG"


def test_exons_that_begin_unknown_stay_in_place_and_own_ends_are_kept(spark):
    ddl = "locus string, source string, allele string, is_ref boolean, start_pos int, stream string"
    parsed = lambda rows: msa.resolve_to_reference(msa.parse_streams(spark.createDataFrame(rows, ddl)))
    gen = parsed([("A", "gen", "A*01", True, -1, "TT|ACGTAC|GG|CCTT|AA")])
    nuc = parsed([("A", "nuc", "A*01", True, 1, "ACGTAC|CCTT.."), ("A", "nuc", "A*02", False, 1, "**GTAC|CCTTGA"), ("A", "nuc", "A*03", False, 1, "AC*TA*|*-..**")])
    segments = msa.merge_segments(gen, nuc)
    merged = msa.merge_gen_nuc(gen, nuc, segments)
    near = spark.createDataFrame([("A", "A*02", "A*01", 1), ("A", "A*03", "A*01", 1)], "locus string, target string, candidate string, rank int")
    rows = msa.merge_nearest_donor(merged, nuc, near, segments)
    seqs = {r["allele"]: r["seq"] for r in msa.allele_sequences(rows, boundary="|").collect()}
    assert seqs == {"A*01": "TT|ACGTAC|GG|CCTT|AA", "A*02": "TT|ACGTAC|GG|CCTTGA|AA", "A*03": "TT|ACTTAC|GG|CC|AA".replace("ACTTAC", "ACGTAC")}
    assert rows.groupBy("allele", "pos").count().where("count > 1").count() == 0
    assert {(r["region_ix"], r["length"], r["shift"] + r["start"]) for r in segments.collect()} == {(0, 2, 0), (1, 6, 2), (2, 2, 8), (3, 6, 10), (4, 2, 16)}


def test_nearest_name_ties_go_up(spark):
    def nearest(numbers):
        c = spark.createDataFrame([("A", f"A*{n:02d}", n, 1, 0, 0) for n in numbers], "locus string, allele string, f1 int, f2 int, f3 int, f4 int")
        t = spark.createDataFrame([("A", "A*03x", 3, 1, 0, 0)], c.schema)
        return msa.trie_nearest(t, c).first()["candidate"]

    assert [nearest(x) for x in ([1, 2, 3, 4], [1, 2, 4, 5], [1, 4, 5], [1, 2, 5])] == ["A*03", "A*04", "A*04", "A*02"]


def test_pair_index_is_a_bijection(spark):
    for diagonal in (True, False):
        n = 37
        pairs = [(i, j, n) for i in range(n) for j in range(i if diagonal else i + 1, n)]
        df = spark.createDataFrame(pairs, "i long, j long, n long").withColumn("k", pair_index(F.col("i"), F.col("j"), F.col("n"), diagonal))
        rows = df.withColumn("b", pair_of_index(F.col("k"), F.col("n"), diagonal)).collect()
        assert [r["k"] for r in rows] == list(range(len(pairs))) and all(r["b"]["i"] == r["i"] and r["b"]["j"] == r["j"] for r in rows)


def test_run_times_and_truth(spark, tmp_path):
    (tmp_path / "s7.txt").write_text("real\t1m2.5s\nuser\t0m3s\nsys\t0m0.25s\n")
    assert R.read_run_times(spark, str(tmp_path / "s7.txt")).first().asDict() == {"sample": "s7", "real": 62.5, "user": 3.0, "sys": 0.25}
    (tmp_path / "t.csv").write_text("x,A*01:01,,,s1\nx,A*02:01,,,s1\n")
    assert R.read_truth_csv(spark, str(tmp_path / "t.csv")).groupBy("sample", "locus").count().first()["count"] == 2


def test_result_json_and_tsv(spark, tmp_path):
    post = spark.createDataFrame([("s 1+", "A", "A*01", "A*02", -1.0, -2.0, 0.75), ("s 1+", "A", "A*01", "A*01", -2.0, -2.0, 0.25), ("t", "A", "A*03", "A*03", -2.0, -2.0, 1.0)],
                                 "sample string, locus string, allele1 string, allele2 string, z double, c double, prob double")
    alleles = spark.createDataFrame([("s 1+", "A", "A*01", -1.0)], "sample string, locus string, allele string, llhd double")
    reads = spark.createDataFrame([("s 1+", "r1", "A", "A*01")], "sample string, name string, locus string, allele string")
    K.write_typing_json(K.typing_document(post, alleles, reads, "h"), str(tmp_path / "j"))
    back = {r["sample"]: r for r in R.read_typing_json(spark, str(tmp_path / "j")).collect()}
    assert set(back) == {"s 1+", "t"} and [z["prob"] for z in back["s 1+"]["per_loci"][0]["zygosity"]] == [0.75, 0.25] and back["t"]["per_reads"] is None
    K.json_to_tsv(R.read_typing_json(spark, str(tmp_path / "j")), str(tmp_path / "tsv"))
    assert K.read_typing_tsv(spark, str(tmp_path / "tsv"), "zygosity").count() == 3


def test_reference_table_is_rebuilt_on_a_new_date(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([("A", "A*01")], "locus string, allele string")

    path = str(tmp_path / "ref")
    for date in ("2018", "2018", "2019", None):
        assert K.materialize_reference(spark, path, date, build).count() == 1
    assert len(built) == 2


def test_reference_is_rebuilt_from_itself(spark, tmp_path):
    path = str(tmp_path / "ref")
    K.materialize_reference(spark, path, "2018", lambda: spark.createDataFrame([("A", 1)], "locus string, n int"))
    again = K.materialize_reference(spark, path, "2019", lambda: spark.read.parquet(path).drop("align_date").withColumn("n", F.col("n") + 1))
    assert [tuple(r) for r in again.select("locus", "n").collect()] == [("A", 2)]


def test_references_that_differ_are_not_merged(spark):
    ddl = "locus string, source string, allele string, is_ref boolean, start_pos int, stream string"
    gen = msa.resolve_to_reference(msa.parse_streams(spark.createDataFrame([("A", "gen", "A*01", True, -1, "AC|GT|AA|CC|GG")], ddl)))
    nuc = msa.resolve_to_reference(msa.parse_streams(spark.createDataFrame([("A", "nuc", "A*01", True, 1, "GA|CC")], ddl)))
    with pytest.raises(Exception, match="references differ in exon 1 of A"):
        msa.merge_gen_nuc(gen, nuc).collect()


def test_runs_keep_the_last_letter(spark):
    from loomtype.operators import graph

    ddl = "locus string, source string, allele string, is_ref boolean, start_pos int, stream string"
    rows = msa.resolve_to_reference(msa.parse_streams(spark.createDataFrame([("A", "nuc", "A*01", True, 1, "ACGT"), ("B", "nuc", "B*01", True, 1, "ACGT"), ("B", "nuc", "B*02", False, 1, "-T--")], ddl)))
    runs = sorted((r["locus"], r["src"], r["letters"]) for r in graph.join_same_paths(graph.allele_graph(rows)).collect())
    assert runs == [("A", 1, "ACGT"), ("B", 1, "AC"), ("B", 1, "AT"), ("B", 3, "GT")]


def test_boundaries_group_reads(spark):
    from loomtype.operators.compare import group_by_boundary

    reads = spark.createDataFrame([("A", 5), ("A", 10), ("A", 1), ("A", 99), ("B", 7)], "locus string, pos int")
    marks = spark.createDataFrame([("A", 2, "x"), ("A", 10, "y"), ("A", 10, "z")], "locus string, pos int, region string")
    assert sorted(tuple(r) for r in group_by_boundary(reads, marks).collect()) == [("A", 5, "x"), ("A", 10, "z"), ("A", 99, "z")]


@pytest.mark.parametrize("suffix", ["", ".gz"])
def test_records_are_cut_where_files_are_split(spark, tmp_path, suffix):
    import gzip

    expected = set()
    for f, n in enumerate((400, 1, 37)):
        text = ""
        for i in range(n):
            seq = "ACGTN" * (1 + (i * 7 + f) % 9)
            qual = ("@" + "+I5@" * 40)[: len(seq)]
            text += f"@f{f}r{i}/1 x\n{seq}\n+\n{qual}\n"
            expected.add((f"s{f}", i, f"f{f}r{i}", seq, qual))
        raw = text.encode() if f else text.encode()[:-1]  # no line end behind the last line
        (tmp_path / f"s{f}_1.fastq{suffix}").write_bytes(gzip.compress(raw) if suffix else raw)
    (tmp_path / f"t_1.fastq{suffix}").write_bytes(gzip.compress(b"@cut\nACGT\n") if suffix else b"@cut\nACGT\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "701b")
    try:
        reads, bad = R.read_fastq(spark, str(tmp_path))
        got = {(r["sample"], r["read_id"], r["name"], r["seq"], r["qual"]) for r in reads.collect()}
        assert got == expected and [(r["record"], r["head"], r["seq"], r["qual"]) for r in bad.collect()] == [(0, "@cut", "ACGT", None)]
        placed = R.read_fastq_all(spark, str(tmp_path)).orderBy("place").collect()
        assert [(r["sample"], r["read_id"], r["place"]) for r in placed] == [(s, i, p) for p, (s, i, *_) in enumerate(sorted(expected))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_reads_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r\nAC\n+\nII\n")
    reads, _ = R.read_fastq(spark, str(tmp_path / "a.fastq"))
    plan = reads._jdf.queryExecution().executedPlan().toString()
    # the one scan of the lines lies below no exchange; others read the table of parts
    scan = plan.index("FileScan text")
    assert plan.count("FileScan text") == 1 and "Exchange" not in plan[:scan].replace("BroadcastExchange", "").split("Union")[1]


def test_alignments_among_others_in_one_text(spark, tmp_path):
    bodies = {f"A{i}_nuc.txt": ALIGNMENT.replace("A*", f"A{i}*") * (1 + i % 2) for i in range(30)}
    for k in range(2):
        (tmp_path / f"t{k}.txt").write_text("".join(f"{R.MEMBER.format(n)}\n{b}" for n, b in list(bodies.items())[k::2]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "301b")
    try:
        lines = R.member_lines(spark, str(tmp_path))
        got = {(r["file"], r["line_no"], r["text"]) for r in lines.collect()}
        assert got == {(n, i, t) for n, b in bodies.items() for i, t in enumerate(b.removesuffix("\n").split("\n"))}
        streams, files = msa.parse_lines(lines)
        # the lines are read once more for the streams, and only an allele's chunks are shuffled
        plan = streams._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan text") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
        rows = {(r["locus"], r["allele"][-5:-3]): (r["is_ref"], r["start_pos"], r["stream"]) for r in streams.collect()}
        assert len(rows) == 90 and {k[1]: v for k, v in rows.items()} == {"01": (True, -2, "ACGT.A|CGGTTGG"), "02": (False, -2, "---A.-|***---*"), "03": (False, -2, "----G-|--.-C-T")}
        assert {tuple(r)[1:] for r in files.collect()} == {("nuc", "3.33.0", "2018-01-01")} and files.count() == 30
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_notes_behind_the_end_are_not_read(spark):
    lines = [" cDNA  1", " A*01  AC", "Please see", " cDNA and other notes", " A*02 GG"]
    rows = spark.createDataFrame([("A_nuc.txt", i, t) for i, t in enumerate(lines)] + [("B_nuc.txt", 0, "# date: 2019")], "file string, line_no long, text string")
    streams, files = msa.parse_lines(rows)
    assert [tuple(r) for r in streams.collect()] == [("A", "nuc", "A*01", True, 1, "AC")]
    assert sorted((r["locus"], r["align_date"]) for r in files.collect()) == [("A", None), ("B", "2019")]


def test_texts_of_alignments_do_not_grow_with_genes(spark, tmp_path):
    from loomtype.plans import q_files

    docs = [(i, "some letters " * 40, f"l{i % 2}") for i in range(0, 30000, 50)]  # 600 genes
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    lines = q_files._alignments(spark, str(tmp_path))
    assert len(lines.inputFiles()) <= 4 and lines.select("file").distinct().count() == 300


def test_a_gene_goes_on_in_the_next_part(spark, tmp_path):
    post = spark.createDataFrame([("s", "AB"[k % 2], f"x{k}", "y", -1.0 * k, -2.0, (k * 7 % 10) / 10) for k in range(23)], "sample string, locus string, allele1 string, allele2 string, z double, c double, prob double")
    alleles = spark.createDataFrame([("s", "AB"[k % 2], f"x{k}", -1.0 * k) for k in range(23)], "sample string, locus string, allele string, llhd double")
    reads = spark.createDataFrame([("s", "r", "A", "x0")], "sample string, name string, locus string, allele string")
    documents = K.typing_document(post, alleles, reads, "h", pairs_per_row=5)
    rows = documents.collect()
    assert sorted(r["part"] for r in rows) == list(range(5)) and max(sum(len(g[c] or []) for g in r["per_loci"]) for r in rows for c in ("zygosity", "per_allele")) == 5
    K.write_typing_json(documents, str(tmp_path / "j"))
    K.json_to_tsv(R.read_typing_json(spark, str(tmp_path / "j")), str(tmp_path / "b"))
    K.write_typing_tsv(post, alleles, reads, str(tmp_path / "a"))
    for table in ("zygosity", "likelihood"):
        one, two = (sorted(map(tuple, K.read_typing_tsv(spark, str(tmp_path / x), table).na.fill("").collect())) for x in "ab")
        assert one == two and len(one) == 23
    best = sorted(((r["locus"], -r["prob"], r["allele1"]) for r in post.collect()))
    ranks = {(r["locus"], int(r["rank"])): r["allele1"] for r in K.read_typing_tsv(spark, str(tmp_path / "b"), "zygosity").collect()}
    assert [ranks[g, k] for g, n in (("A", 12), ("B", 11)) for k in range(1, n + 1)] == [b[2] for b in best]


def test_emissions_of_a_pair_may_span_batches(spark):
    import random

    dice, found = random.Random(5), {}
    pairs = [(f"s{k % 2}", "A", f"x{k // 2 % 3}", f"y{k // 6}") for k in range(24)]
    for _ in range(150):
        found[(*dice.choice(pairs[:20]), dice.randrange(1, 3), dice.randrange(9))] = dice.randrange(1, 5)
    key = "sample string, locus string, allele1 string, allele2 string"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        joined = K.with_emissions(spark.createDataFrame(pairs, key), spark.createDataFrame([(*k, w) for k, w in found.items()], f"{key}, side int, pos int, weight int"))
        got = {tuple(r)[:4]: tuple([tuple(e) for e in r[c]] for c in ("emissions1", "emissions2")) for r in joined.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {p: tuple(sorted((k[5], w) for k, w in found.items() if k[:4] == p and k[4] == side) for side in (1, 2)) for p in pairs}
    assert "ObjectHashAggregate" not in joined._jdf.queryExecution().executedPlan().toString()
