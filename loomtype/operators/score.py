"""Distributed scoring of reads on alleles, and typing of samples.

Reads are dealt out to the tasks. The alleles, which don't grow with the reads, are sent to every task, in pieces of
whole genes of about ``ALLELE_BYTES``: filters look at all alleles of a gene.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import reverse_complement
from ..sources.shared import saved
from . import kernel
from .pairs import (allele_log_likelihood, assign_reads, best_locus, best_orientation, coverage_likelihood, of_sample, pair_emissions,
                    pair_log_likelihood, pair_posterior, rank_pairs, top_pairs)
from .spread import dealt, tasks
from .vectors import pair_sums, scores_of, vector_emissions

ALLELE_BYTES = 64 << 20
SCORES = "read_id long, locus string, allele_id long, rc boolean, mate int, llhd double, pos long, filter_reason string"
#: Sequences of a gene that travel in one row, and alleles on a side of a block of pairs.
BLOCK = 256
#: Bytes of scores of a batch of reads, and of the score vectors that are summed over pairs at a time.
BATCH_BYTES, LANE_BYTES = 32 << 20, 64 << 20


def oriented(reads: DataFrame, check_rc: bool = True) -> DataFrame:
    """Each read as it is, and its reverse complement with reversed qualities (``rc``)."""
    plain = reads.withColumn("rc", F.lit(False))
    if not check_rc:
        return plain
    return plain.unionByName(plain.withColumn("rc", F.lit(True)).withColumn("seq", reverse_complement(F.col("seq"))).withColumn("q", F.reverse("q")))


def build_emissions(sequences: DataFrame) -> DataFrame:
    """``locus, block, n_columns, alleles``: the gene's alleles in blocks of ``BLOCK``, equal sequences once.

    Alleles with the same sequence score alike, so they are scored once and told apart afterwards. ``n_columns`` is
    the number of alignment columns of the gene where the input has it, else its longest sequence.
    """
    columns = F.col("n_columns") if "n_columns" in sequences.columns else F.length("seq")
    distinct = sequences.withColumn("_n", columns).groupBy("locus", "seq").agg(F.array_sort(F.collect_set("allele_id")).alias("ids"), F.max("_n").alias("_n"))
    block = F.pmod(F.xxhash64("seq"), F.greatest(F.lit(1), F.ceil(F.col("_d") / BLOCK))).cast("int")
    sizes = distinct.groupBy("locus").agg(F.count("*").alias("_d"), F.max("_n").alias("n_columns"))
    return distinct.drop("_n").join(sizes, "locus").withColumn("block", block).groupBy("locus", "block", "n_columns").agg(
        F.collect_list(F.struct("seq", "ids")).alias("alleles"))


@dataclass
class Gene:
    """A gene's alleles as a task holds them: ``ids`` ascending, and which of the distinct sequences each has."""

    locus: str
    n_columns: int
    sequences: kernel.Alleles
    ids: np.ndarray
    row: np.ndarray


def _pieces(emissions: DataFrame) -> Iterator[list[tuple]]:
    """The genes, coded for the kernel, some whole ones a piece."""
    size = F.expr("aggregate(alleles, 0L, (n, a) -> n + length(a.seq) + 8 * size(a.ids))")
    sizes = emissions.select("locus", size.alias("n")).groupBy("locus").agg(F.sum("n").alias("n")).orderBy("locus").collect()
    groups: list[list[str]] = []
    used = ALLELE_BYTES
    for r in sizes:
        if used + r["n"] > ALLELE_BYTES:
            groups.append([])
            used = 0
        groups[-1].append(r["locus"])
        used += r["n"]
    for group in groups:
        of: dict[str, list] = {}
        columns = {}
        for r in emissions.where(F.col("locus").isin(group)).collect():
            of.setdefault(r["locus"], []).extend(r["alleles"])
            columns[r["locus"]] = r["n_columns"]
        coded = []
        for locus in group:
            alleles = sorted(of[locus], key=lambda a: a["seq"])
            ids = np.array([i for a in alleles for i in a["ids"]], np.int64)
            row = np.repeat(np.arange(len(alleles)), [len(a["ids"]) for a in alleles])
            order = np.argsort(ids)
            coded.append((locus, columns[locus], *kernel.encode([a["seq"] for a in alleles]), ids[order], row[order]))
        yield coded


class Genes:
    """All genes, sent to the tasks once; a worker makes the tries when it first needs them."""

    def __init__(self, emissions: DataFrame):
        context = emissions.sparkSession.sparkContext
        self.sent, self.ids = [], {}
        for piece in _pieces(emissions):
            self.ids |= {locus: ids for locus, _, _, _, ids, _ in piece}
            self.sent.append(context.broadcast(piece))

    def __iter__(self) -> Iterator[Gene]:
        """The genes in the order of their names."""
        for sent in self.sent:
            if not isinstance(sent.value[0], Gene):
                sent.value[:] = [Gene(locus, n, kernel.Alleles(matrix, lengths), ids, row) for locus, n, matrix, lengths, ids, row in sent.value]
            yield from sent.value


def _usable(reads: DataFrame, *columns: str) -> DataFrame:
    """Reads with letters and one quality a letter."""
    return reads.where("length(seq) > 0 AND size(q) = length(seq)").select(*columns, "seq", "q")


def _texts(codes: np.ndarray, texts: list) -> pa.Array:
    """Few texts (or None) that many rows have, without an object a row."""
    return pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int32)), pa.array(texts, pa.string())).dictionary_decode()


def _long(some: pd.DataFrame, of: list[str], gene: Gene, got: kernel.Scores, rc) -> pa.RecordBatch:
    """A row for each read and allele, as the columns of ``SCORES``."""
    n = len(gene.ids)
    who = np.repeat(np.arange(len(some)), n)
    reasons = sorted({w for w in got.why if w})
    why = np.array([reasons.index(w) if w else len(reasons) for w in got.why], np.int32)
    columns = {c: pa.array(some[c]).take(pa.array(who)) for c in of} | {
        "read_id": pa.array(some["read_id"].to_numpy(np.int64)[who]), "locus": _texts(np.zeros(len(who)), [gene.locus]), "allele_id": pa.array(np.tile(gene.ids, len(some))),
        "rc": pa.array(np.broadcast_to(np.asarray(rc, bool), len(some))[who]), "mate": pa.array(some["mate"].to_numpy(np.int32)[who]),
        "llhd": pa.array(got.value[:, gene.row].reshape(-1)), "pos": pa.array(got.pos[:, gene.row].reshape(-1)), "filter_reason": _texts(why[who], [*reasons, None])}
    return pa.RecordBatch.from_arrays([c.cast(pa.string()) if k in of else c for k, c in columns.items()], list(columns))


def _batches(frame: pd.DataFrame, gene_alleles: int) -> Iterator[pd.DataFrame]:
    """Reads of one length, as many as have scores of ``BATCH_BYTES`` on so many alleles."""
    step = max(1, BATCH_BYTES // (64 * max(gene_alleles, 1)))
    for _, same in frame.groupby(frame["seq"].str.len()):
        for at in range(0, len(same), step):
            yield same.iloc[at : at + step]


def forward_scores(reads: DataFrame, emissions: DataFrame, prealigned: bool = True, parts: int = 1, allowed_mismatches: int | None = None) -> DataFrame:
    """Score every (oriented) read ``read_id, mate, rc, seq, q`` on every allele of every gene.

    Reads of one length go through the kernel together. ``allowed_mismatches`` filters a read by all alleles of a gene.
    ``parts`` scores reads in so many parts. A ``sample`` is kept. Reads without letters or with other than one quality
    a letter are left out.
    """
    of = of_sample(reads)
    schema = ", ".join([*(f"{c} string" for c in of), SCORES])
    genes = Genes(emissions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in (batch.to_pandas() for batch in batches):
            for gene in genes:
                for some in _batches(frame, len(gene.ids)):
                    codes, errors = kernel.read_codes(some["seq"].tolist(), some["q"].tolist())
                    if parts > 1:
                        got = kernel.split_scores(codes, errors, gene.sequences, gene.n_columns, parts, prealigned, allowed_mismatches)
                    else:
                        t = kernel.transitions(codes.shape[1], gene.n_columns, prealigned)
                        got = kernel.forward_scores(codes, errors, gene.sequences, t, allowed_mismatches)
                    yield _long(some, of, gene, got, some["rc"])

    return _usable(dealt(reads), *of, "read_id", "mate", "rc").mapInArrow(run, schema)


_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def _turned(some: pd.DataFrame) -> tuple[list[str], list]:
    return [s.translate(_COMPLEMENT)[::-1] for s in some["seq"]], [list(q)[::-1] for q in some["q"]]


def past_threshold_scores(reads: DataFrame, emissions: DataFrame, allowed_mismatches: int | None = None, prealigned: bool = True) -> DataFrame:
    """Scores of reads in both orientations, against the best that each read has reached so far.

    Genes are tried in the order of their names, in each the read as it is before its reverse complement. The threshold
    is the running maximum of the median match (``kernel.forward_scores``) of the passes that were not filtered; a pass
    whose best match falls below it in some row but the last is filtered. ``allowed_mismatches`` is a filter beside it.
    """
    of = of_sample(reads)
    schema = ", ".join([*(f"{c} string" for c in of), SCORES])
    genes = Genes(emissions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in (batch.to_pandas() for batch in batches):
            for some in _batches(frame, max([1, *(gene.sequences.matrix.size for gene in genes)])):
                both = [kernel.read_codes(some["seq"].tolist(), some["q"].tolist()), kernel.read_codes(*_turned(some))]
                threshold = np.full(len(some), -np.inf)
                for gene in genes:
                    t = kernel.transitions(both[0][0].shape[1], gene.n_columns, prealigned)
                    for rc, (codes, errors) in zip((False, True), both):
                        got = kernel.forward_scores(codes, errors, gene.sequences, t, allowed_mismatches, threshold, median=True, rows=gene.row)
                        threshold = np.maximum(threshold, got.median)
                        yield _long(some, of, gene, got, rc)

    return _usable(dealt(reads), *of, "read_id", "mate").mapInArrow(run, schema)


def best_orientation_scores(reads: DataFrame, emissions: DataFrame, prealigned: bool = True, allowed_mismatches: int | None = None) -> DataFrame:
    """``best_orientation`` of the ``forward_scores`` of both orientations, each read chosen where it is scored.

    Of a read and gene the orientation with the best allele; the regular one wins ties, filtered ones lose. Rows of the
    other one are never made, and nothing is shuffled.
    """
    of = of_sample(reads)
    genes = Genes(emissions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in (batch.to_pandas() for batch in batches):
            for gene in genes:
                for some in _batches(frame, len(gene.ids)):
                    both = kernel.read_codes(some["seq"].tolist(), some["q"].tolist()), kernel.read_codes(*_turned(some))
                    t = kernel.transitions(both[0][0].shape[1], gene.n_columns, prealigned)
                    one, two = (kernel.forward_scores(*x, gene.sequences, t, allowed_mismatches) for x in both)
                    fine = one.why == "", two.why == ""
                    rc = np.where(fine[0] == fine[1], two.value.max(axis=1) > one.value.max(axis=1), fine[1])
                    pick = rc[:, None]
                    yield _long(some, of, gene, kernel.Scores(np.where(pick, two.value, one.value), np.where(pick, two.pos, one.pos), np.where(rc, two.why, one.why)), rc)

    return _usable(dealt(reads), *of, "read_id", "mate").mapInArrow(run, ", ".join([*(f"{c} string" for c in of), SCORES]))


def reads_x_alleles(scores: DataFrame) -> DataFrame:
    """How many alleles of each gene every oriented read met."""
    return scores.groupBy(*of_sample(scores), "read_id", "mate", "rc", "locus").agg(F.count("*").alias("alleles"))


def viterbi_align(reads: DataFrame, allele_id: int, allele: str, n_columns: int, prealigned: bool = True) -> DataFrame:
    """Best path of each oriented read on one allele: aligned texts, first and last column.

    Of a single read the better orientation is kept; of two mates those opposite orientations that have the higher
    likelihood together. The first mate's regular one is kept where both are alike.
    """
    schema = "read_id long, mate int, rc boolean, allele_id long, llhd double, start long, stop long, allele_text string, read_text string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                t = kernel.transitions(len(r.seq), n_columns, prealigned)
                rows.append((r.read_id, r.mate, r.rc, allele_id, *kernel.viterbi(r.seq, list(r.q), allele, t)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    aligned = _usable(dealt(reads), "read_id", "mate", "rc").mapInPandas(run, schema)
    # mates lie on opposite strands: what is chosen is the strand of the first one
    strand = F.col("rc") != (F.col("mate") == 2)
    both = aligned.withColumn("_s", strand).groupBy("read_id", "_s").agg(F.sum("llhd").alias("_l"), F.collect_list(F.struct(*[c.split()[0] for c in schema.split(", ")])).alias("_m"))
    best = both.groupBy("read_id").agg(F.max_by("_m", F.struct(F.round("_l", 9), ~F.col("_s"))).alias("_m"))
    return best.select(F.explode("_m").alias("b")).select("b.*")


def viterbi_report(aligned: DataFrame) -> DataFrame:
    """Mates side by side in the order of their starts, with the distance between them (negative: they overlap)."""
    mates = F.array_sort(F.collect_list(F.struct("start", "stop", "mate", "allele_text", "read_text")))
    both = aligned.groupBy("read_id").agg(mates.alias("m"))
    text = F.transform("m", lambda x: F.concat(x["allele_text"], F.lit("\n"), x["read_text"]))
    inner = F.when(F.size("m") > 1, F.get("m", F.lit(1))["start"] - F.get("m", F.lit(0))["stop"] - 1)
    return both.select("read_id", F.array_join(text, "\n\n").alias("report"), inner.alias("inner_distance"))


def second_mate_scores(scores: DataFrame) -> DataFrame:
    """Keep mate 2 only in the orientation opposite to mate 1's best; in both where mate 1 was filtered or is missing."""
    key = [*of_sample(scores), "read_id", "locus"]
    first = best_orientation(scores.where("mate <= 1")).where("filter_reason IS NULL").select(*key, F.col("rc").alias("_rc")).distinct()
    second = scores.where("mate = 2").join(first, key, "left").where("_rc IS NULL OR rc <> _rc").drop("_rc")
    return best_orientation(scores.where("mate <= 1")).unionByName(best_orientation(second))


def type_samples(scores: DataFrame, n_columns: int, report: int | None = 50, multi_locus: bool = True,
                 least: float | None = None) -> dict[str, DataFrame]:
    """From scored reads to the posterior: orientation, mates, best gene, sums, coverage, assignment.

    With a column ``sample``, many samples are typed at once, each by itself. The posterior reports the pairs of the
    ``report`` highest likelihoods, None: all; the others count in its norm. With ``least`` all pairs are evaluated,
    and those above it are reported. Scores and sums are kept as tables in the shared folder.
    """
    scores = saved(scores)  # the kernel's output feeds several branches below
    of = of_sample(scores)
    usable = second_mate_scores(scores).where("filter_reason IS NULL")
    merged = usable.groupBy(*of, "read_id", "locus", "allele_id").agg(F.sum("llhd").alias("llhd"), F.min("pos").alias("pos"))
    if multi_locus:
        merged = merged.join(best_locus(merged).select(*of, "read_id", "locus"), [*of, "read_id", "locus"], "left_semi")
    merged = saved(merged)
    pairs = saved(pair_log_likelihood(merged))
    top = pairs if report is None or least is not None else rank_pairs(pairs, report)
    posterior = pair_posterior(pairs.select(*of, "locus", "i", "j", "z"), coverage_likelihood(pair_emissions(merged, top), n_columns))
    if least is not None:
        posterior = top_pairs(posterior, least=least)
    return {"alleles": allele_log_likelihood(merged), "pairs": pairs, "posterior": posterior, "assignment": assign_reads(merged, posterior)}


#: Part of a batch's reads that may be scored again before rough values are given up in a task.
AGAIN = 0.5


def _hopeful(flat: pd.DataFrame, lengths: list, genes: Genes, prealigned: bool) -> list[np.ndarray]:
    """For each gene the rows (orientations) that may be a read's best of all genes, by rough values; all of reads with two mates."""
    limits = []
    for gene in genes:
        low, high = np.full((2, len(flat)), np.inf)
        for (codes, errors), at in lengths:
            low[at], high[at] = kernel.rough_tops(codes, errors, gene.sequences, kernel.transitions(codes.shape[1], gene.n_columns, prealigned))
        limits.append((low, high))
    reads = flat["read"].to_numpy()
    best = np.full(reads.max() + 1, -np.inf)
    for low, _ in limits:
        np.maximum.at(best, reads, low)
    paired = np.bincount(reads)[reads] > 2
    return [(high >= best[reads]) | paired for _, high in limits]


def _best_gene(frame: pd.DataFrame, genes: Genes, prealigned: bool, multi_locus: bool, allowed_mismatches: int | None,
               rough: list[float] | None = None) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """For each read (a row with its mates) its gene's scores over the gene's alleles; of every gene if not ``multi_locus``.

    As ``second_mate_scores`` and ``best_locus`` choose: the better orientation of a first mate, the opposite one of a
    second mate (the better one where the first was filtered), mates' likelihoods multiplied, the gene with the best allele.

    With ``rough`` (where the part of reads that it did not help is noted) a read's scores are computed for those genes
    and orientations only that may be its best by rough values, and for the others where one of these is filtered.
    """
    flat = pd.DataFrame([(i, m["mate"], bool(rc), s, q) for i, mates in enumerate(frame["mates"]) for m in mates
                         for rc, s, q in ((0, m["seq"], list(m["q"])), (1, m["seq"].translate(_COMPLEMENT)[::-1], list(m["q"])[::-1]))], columns=["read", "mate", "rc", "seq", "q"])
    best: dict[int, tuple] = {}
    mates: dict[int, list[tuple[int, int]]] = {}
    for at, (read, mate, rc) in enumerate(zip(flat["read"], flat["mate"], flat["rc"])):
        if not rc:
            mates.setdefault(read, []).append((mate, at))
    lengths = [(codes, same.index.to_numpy()) for _, same in flat.groupby(flat["seq"].str.len())
               for codes in (kernel.read_codes(same["seq"].tolist(), same["q"].tolist()),)]
    hopeful = _hopeful(flat, lengths, genes, prealigned) if rough is not None and multi_locus and len(flat) else None
    again = np.zeros(len(frame), bool)
    for k, gene in enumerate(genes):
        value, pos = np.full((len(flat), gene.sequences.count), -np.inf), np.zeros((len(flat), gene.sequences.count), np.int64)
        fine = np.zeros(len(flat), bool)
        for (codes, errors), at in lengths:
            if hopeful is not None:
                some = hopeful[k][at]
                codes, errors, at = codes[some], errors[some], at[some]
            if not len(at):
                continue
            got = kernel.forward_scores(codes, errors, gene.sequences, kernel.transitions(codes.shape[1], gene.n_columns, prealigned), allowed_mismatches)
            value[at], pos[at], fine[at] = got.value, got.pos, got.why == ""
        if hopeful is not None:
            again[flat["read"].to_numpy()[hopeful[k] & ~fine]] = True
        top = np.where(fine, value.max(axis=1), -np.inf)
        for read, own in mates.items():
            chosen, turned = [], None
            for mate, at in own:  # both orientations, the regular one first
                if mate == 2 and turned is not None:
                    one = at if turned else at + 1
                else:
                    one = at + 1 if (fine[at + 1], top[at + 1]) > (fine[at], top[at]) else at
                if fine[one]:
                    chosen.append(one)
                    turned = bool(one - at) if mate != 2 else turned
            if chosen:
                highest = value[chosen].sum(axis=0)
                if multi_locus and read in best and highest.max() <= best[read][1].max():
                    continue
                found = (gene.locus, highest[gene.row], pos[chosen].min(axis=0)[gene.row])
                if multi_locus:
                    best[read] = found
                else:
                    yield read, *found
    if hopeful is not None:
        again &= frame["mates"].str.len().to_numpy() == 1
        rough.append(again.mean())
    for read, (locus, sums, first) in best.items():
        if not again[read] or hopeful is None:
            yield read, locus, sums, first
    if hopeful is not None and again.any():
        own = np.flatnonzero(again)
        for read, *found in _best_gene(frame.iloc[own].reset_index(drop=True), genes, prealigned, multi_locus, allowed_mismatches):
            yield own[read], *found


def _by_length(rows: DataFrame, n: int) -> DataFrame:
    """Reads (rows with ``mates``) in ``n`` tasks by the length of their first mates: a task has few lengths, and those of one go through the kernel together."""
    return rows.repartitionByRange(n, F.length(F.get("mates", F.lit(0))["seq"]), F.xxhash64("read_id"))


def score_vectors(reads: DataFrame, genes: Genes, prealigned: bool = True, multi_locus: bool = True, allowed_mismatches: int | None = None) -> DataFrame:
    """``[sample,] read_id, locus, llhd, pos``: a row for each read and its best gene (or every gene), with its scores
    on the gene's alleles, ascending, as arrays. ``reads`` has a row for each mate: ``read_id, mate, seq, q``.
    """
    of = of_sample(reads)
    rows = _usable(reads, *of, "read_id", "mate").repartition(tasks(reads), *of, "read_id").groupBy(*of, "read_id").agg(F.sort_array(F.collect_list(F.struct("mate", "seq", "q"))).alias("mates"))
    rows = _by_length(rows, tasks(reads))
    alleles = max([1, *(len(ids) for ids in genes.ids.values())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, BATCH_BYTES // (64 * alleles))
        rough: list[float] | None = []
        for frame in frames:
            for at in range(0, len(frame), step):
                some = frame.iloc[at : at + step].reset_index(drop=True)
                got = list(_best_gene(some, genes, prealigned, multi_locus, allowed_mismatches, rough))
                rough = None if rough and rough[-1] > AGAIN else rough
                who = [g[0] for g in got]
                out = {c: some[c].to_numpy()[who] for c in [*of, "read_id"]} | {"locus": [g[1] for g in got], "llhd": [g[2] for g in got], "pos": [g[3] for g in got]}
                yield pd.DataFrame(out)

    return rows.mapInPandas(run, ", ".join([*(f"{c} string" for c in of), "read_id long, locus string, llhd array<double>, pos array<long>"]))


def type_reads(reads: DataFrame, emissions: DataFrame, n_columns: int, report: int | None = 50, multi_locus: bool = True, least: float | None = None,
               prealigned: bool = True, allowed_mismatches: int | None = None) -> dict[str, DataFrame]:
    """From reads to the posterior, as ``forward_scores`` of both orientations and ``type_samples`` give it.

    A read's scores stay one row: its vector over the alleles of its gene. Sums over pairs are matrices of blocks of
    alleles, summed in lanes of reads and added up; no row holds a read and a pair.
    """
    of = of_sample(reads)
    genes = Genes(emissions)
    vectors = saved(score_vectors(reads, genes, prealigned, multi_locus, allowed_mismatches))
    pairs = saved(pair_sums(vectors, genes.ids))
    top = pairs if report is None or least is not None else rank_pairs(pairs, report)
    emissions = saved(vector_emissions(vectors, top, genes.ids))
    coverage = saved(coverage_likelihood(emissions, n_columns))
    posterior = pair_posterior(pairs.select(*of, "locus", "i", "j", "z"), coverage)
    if least is not None:
        posterior = top_pairs(posterior, least=least)
    alleles = pairs.where("i = j").select(*of, "locus", F.col("i").alias("allele_id"), F.col("z").alias("llhd"), "reads")
    members = posterior.select(*of, "locus", F.explode(F.array("i", "j")).alias("allele_id")).distinct()
    kept = emissions.join(posterior.select(*of, "locus", "i", "j"), [*of, "locus", "i", "j"], "left_semi")
    return {"alleles": alleles, "pairs": pairs, "posterior": posterior, "emissions": kept, "assignment": assign_reads(scores_of(vectors, members, genes.ids), posterior)}
