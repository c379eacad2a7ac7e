"""Reading of FASTQ, FASTA, alignment texts, typing results, truth and timing files.

All files are read by Spark's own readers, so any file system that Spark knows will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import LOCUS_GROUPS
from ..functions.values import phred
from ..operators.msa import parse_lines
from .shared import saved


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, line_no, text`` of text files; line numbers count from 0 in each file.

    Files are split among tasks. A line's number is its part's start, from the counts of the parts before it, plus its
    place in the part, so nothing is read in one task.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text"))
    place = Window.partitionBy("file", "_block").orderBy("_id")
    counts = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("file", "_block", "_base")
    return lines.withColumn("_p", F.row_number().over(place) - 1).join(starts, ["file", "_block"]).select(
        "file", (F.col("_base") + F.col("_p")).alias("line_no"), "text")


#: The line before a file among others in one text, as ``head`` writes it.
MEMBER = "==> {} <=="


def member_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, line_no, text`` of texts that hold many files, each behind a line ``==> its name <==`` (``MEMBER``).

    For files too many and too small to lie in a folder each. A file is cut out by Spark's reader, as a row, whatever
    the parts in which tasks read the text; so numbers need no shuffle and no other scan. Empty lines at its end are left out.
    """
    members = spark.read.option("lineSep", "\n==> ").text(path).where("value <> ''").select(F.concat(F.regexp_replace("value", "^==> ", ""), F.lit("\n")).alias("v"))
    lines = F.posexplode_outer(F.split(F.regexp_replace(F.expr("substr(v, instr(v, ' <==\n') + 5)"), r"\n+\z", ""), "\n"))
    return members.select(F.substring_index("v", " <==\n", 1).alias("file"), lines.alias("line_no", "text"))


def _sample(file: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(file, r"([^/]+)$", 1), r"(_R?[12])?\.(fastq|fq)(\.gz)?$", "")


#: Parts of files whose first line numbers may be sent to all tasks (some tens of MB).
SENT_PARTS = 500_000


def records(spark: SparkSession, path: str | list[str], size: int = 4) -> DataFrame:
    """``file, record, lines``: every ``size`` lines of a file, as an array (the last may be shorter).

    Files are split among tasks by Spark's reader. A first pass counts each part's lines and keeps the few at its ends; so
    the second knows the number of a part's first line, and cuts the records in the task that reads them. Records that
    two parts share are made of the ends. No line is shuffled but these.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, head, tail = None, 0, [], []
        for batch in batches:
            for key, texts in _runs(batch):
                if key != part:
                    if part:
                        yield _ends_batch(part, n, head, tail)
                    part, n, head, tail = key, 0, [], []
                n += len(texts)
                head += texts[: size - 1 - len(head)].to_pylist()
                tail = (tail + texts[max(0, len(texts) - size + 1) :].to_pylist())[1 - size :]
        if part:
            yield _ends_batch(part, n, head, tail)

    parts = saved(lines.mapInArrow(ends, "file string, block long, n long, head array<string>, tail array<string>"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    lead = F.least(F.pmod(-F.col("base"), F.lit(size)), F.col("n")).cast("int")  # lines that belong to the record before
    over = F.pmod(F.col("n") - lead, F.lit(size)).cast("int")  # lines of a record that goes on
    leads = parts.where(lead > 0).select("file", F.floor(F.col("base") / size).alias("record"), (F.col("base") % size).alias("first"), F.slice("head", F.lit(1), lead).alias("lines"))
    overs = parts.where(over > 0).select("file", F.floor((F.col("base") + F.col("n")) / size).alias("record"), F.lit(0).alias("first"), F.slice("tail", -over, over).alias("lines"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "lines")))
    shared = leads.unionByName(overs).groupBy("file", "record").agg(F.flatten(F.transform(ordered, lambda x: x["lines"])).alias("lines"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, left = None, 0, []
        for batch in batches:
            for key, texts, base in _runs(batch, "base"):
                if key != part:
                    part, at, left = key, base, []
                # the rest of a record that began in this part's batch before, or in the part before this one
                head = min((-at) % size, len(texts))
                left += texts[:head].to_pylist()
                at += head
                if head and at % size == 0:
                    if len(left) == size:
                        yield _record_batch(key[0], at // size - 1, pa.array(left, pa.string()), size)
                    left = []
                count = (len(texts) - head) // size
                if count:
                    yield _record_batch(key[0], at // size, texts[head : head + count * size], size)
                left += texts[head + count * size :].to_pylist()
                at += len(texts) - head

    if parts.limit(SENT_PARTS + 1).count() <= SENT_PARTS:
        parts = F.broadcast(parts.select("file", "block", "base"))
        return lines.join(parts, ["file", "block"]).select("file", "block", "base", "text").mapInArrow(whole, "file string, record long, lines array<string>").unionByName(shared)
    numbered = numbered_lines(spark, path)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return numbered.groupBy("file", F.floor(F.col("line_no") / size).alias("record")).agg(F.transform(ordered, lambda x: x["text"]).alias("lines"))


def _runs(batch: pa.RecordBatch, *more: str) -> Iterator[tuple]:
    """The lines of each part of a file in a batch: (file, block), lines, and the first of ``more``."""
    files, blocks = batch.column("file").to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
    edges = [0, *(np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), len(files)]
    for a, b in zip(edges[:-1], edges[1:]):
        if a < b:
            yield (files[a], int(blocks[a])), batch.column("text")[a:b], *(batch.column(c)[a].as_py() for c in more)


def _ends_batch(part: tuple, n: int, head: list, tail: list) -> pa.RecordBatch:
    strings = pa.list_(pa.string())
    return pa.RecordBatch.from_arrays([pa.array([part[0]]), pa.array([part[1]]), pa.array([n]), pa.array([head], strings), pa.array([tail], strings)], ["file", "block", "n", "head", "tail"])


def _record_batch(file: str, first: int, lines: pa.Array, size: int) -> pa.RecordBatch:
    n = len(lines) // size
    return pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(first + np.arange(n)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), lines)], ["file", "record", "lines"])


def read_fastq(spark: SparkSession, path: str | list[str], mate: int = 0, keep_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reads, malformed) of four-line FASTQ files.

    reads: ``sample, read_id, name, mate, seq, qual, q``. Records are lines 4k..4k+3 of a file (quality lines may
    begin with @, so lines are counted, never searched for). A record with a wrong shape goes to ``malformed``.
    """
    rows = records(spark, path).select("file", "record", *[F.get("lines", F.lit(k)).alias(c) for k, c in enumerate(("head", "seq", "plus", "qual"))])
    good = F.coalesce(F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual")) & (F.length("seq") > 0), F.lit(False))
    reads = rows.where(good).select(
        *(["file"] if keep_file else []), _sample(F.col("file")).alias("sample"), F.col("record").cast("long").alias("read_id"),
        F.regexp_replace(F.split(F.substring(F.col("head"), F.lit(2), F.length("head")), r"\s")[0], r"/[12]$", "").alias("name"),
        F.lit(mate).alias("mate"), F.upper("seq").alias("seq"), "qual", phred(F.col("qual")).alias("q"))
    return reads, rows.where(~good)


def read_fastq_all(spark: SparkSession, path: str | list[str], mate: int = 0, number_of_reads: int | None = None) -> DataFrame:
    """All good reads with ``place``, their number from 0 in the order of the files' names and of the records in them.

    Places are sums of the files' counts before, plus a read's place in its file, so no file is read in one task.
    ``number_of_reads`` keeps the first ones.
    """
    reads, _ = read_fastq(spark, path, mate, keep_file=True)
    lane = F.floor(F.col("read_id") / 4096)
    counts = reads.groupBy("file", lane.alias("_l")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("file", "_l").rowsBetween(Window.unboundedPreceding, -1)  # one row per 4096 records
    starts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("file", "_l", "_base")
    place = F.row_number().over(Window.partitionBy("file", "_l").orderBy("read_id")) - 1
    placed = reads.withColumn("_l", lane).withColumn("_p", place).join(starts, ["file", "_l"]).withColumn("place", F.col("_base") + F.col("_p"))
    if number_of_reads is not None:
        placed = placed.where(F.col("place") < number_of_reads)
    return placed.drop("_l", "_p", "_base", "file")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``description, sequence``; sequences over several lines are joined."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v"))
    split = F.split("v", "\n")
    body = F.array_join(F.transform(F.slice(split, F.lit(2), F.size(split)), lambda x: F.trim(x)), "")
    return records.where(F.trim("v") != "").select(F.trim(split[0]).alias("description"), body.alias("sequence"))


def read_alignments(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Streams and headers (see ``parse_lines``) of one or many alignment files."""
    return parse_lines(numbered_lines(spark, path))


def alignment_files(directory: str, group: str | None = None, loci: list[str] | None = None, kind: str = "gen") -> list[str]:
    """File names of a directory for a group of genes or a list of them: kind gen, nuc, prot, or merged (gen and nuc)."""
    genes = loci if loci is not None else LOCUS_GROUPS[group or "ClassI"]
    kinds = ("gen", "nuc") if kind == "merged" else (kind,)
    return [f"{directory.rstrip('/')}/{g}_{k}.txt" for g in genes for k in kinds]


def alignment_sources(genes: DataFrame, directory: str, group: str | None = None) -> DataFrame:
    """``locus, kind, file`` for a table of genes and kinds (``locus, kind``); merged ones need two files.

    With ``group`` only its genes; genes P and E have genomic files only, also where merged ones are asked for.
    """
    rows = genes.select("locus", "kind").distinct()
    if group is not None:
        rows = rows.where(F.col("locus").isin(list(LOCUS_GROUPS[group])))
    kinds = F.when((F.col("kind") == "merged") & F.col("locus").isin("P", "E"), F.array(F.lit("gen"))).when(
        F.col("kind") == "merged", F.array(F.lit("gen"), F.lit("nuc"))).otherwise(F.array("kind"))
    file = F.concat(F.lit(directory.rstrip("/") + "/"), "locus", F.lit("_"), "_k", F.lit(".txt"))
    return rows.withColumn("_k", F.explode(kinds)).select("locus", "kind", file.alias("file"))


def pair_mates(one: DataFrame, two: DataFrame, keep_singles: bool = True, key: Column | None = None) -> DataFrame:
    """Join both mates by name (or a key expression) whatever their order; singles are kept or dropped."""
    key = F.col("name") if key is None else key
    side = lambda df, n: df.select(key.alias("key"), F.struct("read_id", "name", "seq", "qual").alias(f"r{n}"))
    rows = side(one, 1).join(side(two, 2), "key", "full_outer" if keep_singles else "inner")
    kind = F.when(F.col("r1").isNotNull() & F.col("r2").isNotNull(), "paired").when(F.col("r1").isNotNull(), "single1").otherwise("single2")
    return rows.withColumn("kind", kind)


def read_from_pair(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.where(F.col("key") == name).withColumn("q1", phred(F.col("r1.qual"))).withColumn("q2", phred(F.col("r2.qual")))


_EMISSIONS = "array<struct<pos: long, weight: long>>"
RESULT = (
    f"header string, per_loci array<struct<locus: string, first_pair: bigint, zygosity: array<struct<allele1: string, allele2: string, z: double, c: double, prob: double, read1_emissions: {_EMISSIONS}, "
    f"read2_emissions: {_EMISSIONS}>>, per_allele: array<struct<allele: string, llhd: double, alters: array<string>>>>>, per_reads array<struct<name: string, locus: string, allele: string>>")


def read_typing_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Finished results, one document a file; ``sample`` from a folder ``sample=...``, else from the file's name."""
    rows = spark.read.schema(RESULT).option("multiLine", True).json(path)
    return rows.select("header", "per_loci", "per_reads", _sample_of(r"([^/]+)\.json$").alias("sample"))


def _sample_of(file_name: str) -> Column:
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    folder = F.regexp_extract(path, r"/sample=([^/]+)/", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_extract(path, file_name, 1))


def read_truth_csv(spark: SparkSession, path: str) -> DataFrame:
    """``sample, locus, allele`` from a table whose column 1 is the allele and column 4 the sample (from 0)."""
    rows = spark.read.csv(path)
    allele = F.trim(rows[rows.columns[1]])
    return rows.select(F.trim(rows[rows.columns[4]]).alias("sample"), F.split_part(allele, F.lit("*"), F.lit(1)).alias("locus"), allele.alias("allele"))


def read_run_times(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``sample, real, user, sys`` in seconds from files of lines such as ``real 1m2.5s``; a file or a folder ``sample=...`` each."""
    rows = spark.read.text(path).select(_sample_of(r"([^/]+?)(?:\.[^/.]*)?$").alias("sample"), "value")
    pattern = r"^(real|user|sys)\s+(\d+)m([0-9.]+)s"
    parts = rows.select("sample", F.regexp_extract("value", pattern, 1).alias("kind"), (
        F.regexp_extract("value", pattern, 2).try_cast("double") * 60 + F.regexp_extract("value", pattern, 3).try_cast("double")).alias("seconds"))
    return parts.where("kind <> ''").groupBy("sample").pivot("kind", ["real", "user", "sys"]).agg(F.first("seconds"))
