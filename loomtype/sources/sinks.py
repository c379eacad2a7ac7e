"""Writing of results, sequences and reads, and of reference tables that are rebuilt when their source changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.spread import sent
from ..operators.windows import ranked
from .shared import discard


def write_fasta(sequences: DataFrame, path: str, width: int = 60) -> None:
    """``>allele alters length: n`` and the sequence in lines of ``width``, in the order of names.

    Needs ``allele, f1..f4, seq``; ``alters`` is used where there is one.
    """
    alters = F.col("alters") if "alters" in sequences.columns else F.lit("")
    head = F.concat(F.lit(">"), F.col("allele"), F.when(alters != "", F.concat(F.lit(" "), alters)).otherwise(""), F.lit(" length: "), F.length("seq").cast("string"))
    wrapped = F.regexp_replace(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), "\n$", "")
    sequences.orderBy("locus", "f1", "f2", "f3", "f4", "allele").select(F.concat(head, F.lit("\n"), wrapped).alias("value")).write.text(path)


def write_fastq_subset(reads: DataFrame, wanted: DataFrame, path: str) -> None:
    """The reads with wanted names as FASTQ, one folder a mate; files follow each other in the reads' order."""
    kept = reads.join(wanted.select("name").distinct(), "name", "left_semi")
    record = F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"))
    ordered = kept.repartitionByRange("mate", "read_id").sortWithinPartitions("mate", "read_id")
    ordered.select("mate", record.alias("value")).write.partitionBy("mate").text(path)


_PAIR = ["locus", "allele1", "allele2"]
_EMISSIONS = "array<struct<pos: bigint, weight: bigint>>"


def _of(rows: DataFrame) -> list[str]:
    return ["sample"] if "sample" in rows.columns else []


def with_emissions(posterior: DataFrame, emissions: DataFrame) -> DataFrame:
    """The posterior's pairs with what each side's reads gave them: ``emissions1`` and ``emissions2``, by position.

    ``emissions`` has ``[sample,] locus, allele1, allele2, side, pos, weight``; weights count half reads.
    """
    key = [*_of(posterior), *_PAIR]
    rows = emissions.select(*key, "side", F.col("pos").cast("long").alias("pos"), F.col("weight").cast("long").alias("weight"))
    of_side = T.ArrayType(T.StructType().add("pos", "long").add("weight", "long"))
    fields = T.StructType([emissions.schema[c] for c in key]).add("emissions1", of_side).add("emissions2", of_side)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[pa.RecordBatch] = []  # of the pair that may go on
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if last and len(_pair_starts(pa.Table.from_batches([last[-1][-1:], batch[:1]]), key)) == 2:
                yield _pair_lists(last, key)
                last = []
            end = int(_pair_starts(pa.Table.from_batches([batch]), key)[-1])
            if end:
                yield _pair_lists([*last, batch[:end]], key)
                last = []
            last.append(batch[end:])
        if last:
            yield _pair_lists(last, key)

    # a hash comes first where rows are sorted: texts that begin alike are long to compare
    hashed = F.xxhash64(*key)
    both = rows.repartition(*key).sortWithinPartitions(hashed, *key, "side", "pos", "weight").mapInArrow(lists, fields)
    none = F.array().cast(_EMISSIONS)
    joined = posterior.withColumn("_h", hashed).join(both.withColumn("_h", hashed), ["_h", *key], "left").drop("_h")
    return joined.withColumns({c: F.coalesce(c, none) for c in ("emissions1", "emissions2")})


def _pair_starts(rows: pa.Table, key: list[str]) -> np.ndarray:
    """Where a pair begins among sorted rows."""
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for c in key:
        column = rows.column(c).combine_chunks()
        new[1:] |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _pair_lists(batches: list[pa.RecordBatch], key: list[str]) -> pa.RecordBatch:
    """A row for each pair, with both sides' emissions as arrays."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    starts, side = _pair_starts(rows, key), rows.column("side").to_numpy()
    columns = [rows.column(c).take(pa.array(starts)).combine_chunks() for c in key]
    for k in (1, 2):
        ends = np.append(0, np.cumsum(np.add.reduceat(side == k, starts, dtype=np.int32), dtype=np.int32))
        of = rows.select(["pos", "weight"]).filter(pa.array(side == k)).combine_chunks()
        values = pa.StructArray.from_arrays([pa.concat_arrays(of.column(c).chunks) if of.column(c).num_chunks else pa.array([], pa.int64()) for c in ("pos", "weight")], ["pos", "weight"])
        columns.append(pa.ListArray.from_arrays(pa.array(ends), values))
    return pa.RecordBatch.from_arrays(columns, [*key, "emissions1", "emissions2"])


def with_alterations(alleles: DataFrame, alterations: DataFrame) -> DataFrame:
    """Alleles with the texts of what was done to their sequences (``locus, allele, text``): ``alters``."""
    texts = alterations.groupBy("locus", "allele").agg(F.array_sort(F.collect_list("text")).alias("alters"))
    return alleles.join(texts, ["locus", "allele"], "left").withColumn("alters", F.coalesce("alters", F.array().cast("array<string>")))


def full_report(typed: dict[str, DataFrame], names: DataFrame, read_names: DataFrame | None = None, alterations: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(posterior, alleles, reads) for the writers below, of what ``type_reads`` gives.

    ``names``: ``locus, allele_id, allele``; ``read_names``: ``[sample,] read_id, name``, else reads are called by number.
    """
    of = _of(typed["posterior"])
    name = lambda old, new: names.select("locus", F.col("allele_id").alias(old), F.col("allele").alias(new))
    named = lambda rows: rows.join(name("i", "allele1"), ["locus", "i"]).join(name("j", "allele2"), ["locus", "j"]).drop("i", "j")
    posterior = with_emissions(named(typed["posterior"]), named(typed["emissions"]))
    alleles = typed["alleles"].join(name("allele_id", "allele"), ["locus", "allele_id"]).select(*of, "locus", "allele", "llhd")
    if alterations is not None:
        alleles = with_alterations(alleles, alterations)
    reads = typed["assignment"].join(name("allele_id", "allele"), ["locus", "allele_id"])
    if read_names is None:
        reads = reads.withColumn("name", F.col("read_id").cast("string"))
    else:
        reads = reads.join(read_names.select(*of, "read_id", "name"), [*of, "read_id"])
    return posterior, alleles, reads.select(*of, "name", "locus", "allele")


def _complete(posterior: DataFrame, alleles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """With empty lists where a table has no emissions or alterations."""
    for c in ("emissions1", "emissions2"):
        if c not in posterior.columns:
            posterior = posterior.withColumn(c, F.array().cast(_EMISSIONS))
    return posterior, alleles if "alters" in alleles.columns else alleles.withColumn("alters", F.array().cast("array<string>"))


def _in_parts(rows: DataFrame, order: list, rows_per_part: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_place`` in their sample's gene and ``part``, of which each has so many rows of a sample; and what they are read from."""
    placed, stored = ranked(rows, ["sample", "locus"], order, "_place")
    before = Window.partitionBy("sample").orderBy("locus").rowsBetween(Window.unboundedPreceding, -1)
    genes = stored.groupBy("sample", "locus").agg(F.count("*").alias("_n"))
    starts = genes.select("sample", "locus", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(sent(starts), ["sample", "locus"]).withColumn("part", F.floor((F.col("_start") + F.col("_place")) / rows_per_part).cast("int")).drop("_start"), stored


def typing_document(posterior: DataFrame, alleles: DataFrame, reads: DataFrame, header: str, reads_per_row: int = 100_000, pairs_per_row: int = 20_000) -> DataFrame:
    """Nested results of each sample: ``sample, part, header, per_loci, per_reads``.

    The genes' pairs with both sides' emissions, and their alleles with alterations, come from best to worst; those that
    do not fit into a row of ``pairs_per_row`` go on in the next part, where ``first_pair`` is the number of the gene's
    pairs before. The reads' alleles are dealt to as many parts as keep about ``reads_per_row`` in one. So no row and no
    window holds all of a sample or gene. Pairs and alleles are stored in their order: ``stored`` of the result, for ``discard``.
    """
    posterior, alleles = _complete(posterior, alleles)
    pair = F.struct("_place", "allele1", "allele2", "z", "c", "prob", F.col("emissions1").alias("read1_emissions"), F.col("emissions2").alias("read2_emissions"))
    one = F.struct("_place", "allele", "llhd", "alters")
    drop = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x.dropFields("_place"))
    key = ["sample", "part", "locus"]
    pairs, stored = _in_parts(posterior, [F.desc("prob"), "allele1", "allele2"], pairs_per_row)
    ones, also = _in_parts(alleles, [F.desc("llhd"), "allele"], pairs_per_row)
    zygosity = pairs.groupBy(*key).agg(F.nullif(F.min("_place"), F.lit(0)).alias("first_pair"), drop(pair).alias("zygosity"))
    loci = zygosity.join(ones.groupBy(*key).agg(drop(one).alias("per_allele")), key, "full_outer")
    per_loci = loci.groupBy("sample", "part").agg(F.array_sort(F.collect_list(F.struct("locus", "first_pair", "zygosity", "per_allele"))).alias("per_loci"))
    counts = reads.groupBy("sample").agg(F.ceil(F.count("*") / reads_per_row).alias("_parts"))
    dealt = reads.join(counts, "sample").withColumn("part", F.pmod(F.xxhash64("name"), "_parts").cast("int"))
    per_reads = dealt.groupBy("sample", "part").agg(F.array_sort(F.collect_list(F.struct("name", "locus", "allele"))).alias("per_reads"))
    documents = per_loci.join(per_reads, ["sample", "part"], "full_outer").select("sample", "part", F.lit(header).alias("header"), "per_loci", "per_reads")
    documents.stored = [stored, also]
    return documents


def write_typing_json(documents: DataFrame, path: str) -> None:
    """A folder ``sample=...`` with a file for each part of a sample's document."""
    documents.repartition("sample", "part").write.partitionBy("sample", "part").json(path)


def _emission_text(emissions: str):
    """``[position,reads;...]``, as reads count half for each side."""
    return F.concat(F.lit("["), F.array_join(F.transform(emissions, lambda e: F.format_string("%d,%.6f", e["pos"], e["weight"] / 2)), ";"), F.lit("]"))


def write_typing_tsv(posterior: DataFrame, alleles: DataFrame, reads: DataFrame, path: str, header: str | None = None) -> None:
    """Three tables, tab separated: zygosity, likelihood and per_read; a column ``sample`` comes first where there is one.

    A pair has both likelihoods, its probability, the number of reads of each side and where they lie (``e1``, ``e2``); an
    allele has what was imputed. ``header``: lines about the run, written beside them. ``rank``, a pair's from 1 in its gene,
    is used where the posterior has it.
    """
    posterior, alleles = _complete(posterior, alleles)
    of = _of(posterior)
    stored = None
    if "rank" not in posterior.columns:
        posterior, stored = ranked(posterior, [*of, "locus"], [F.desc("prob"), "allele1", "allele2"], "rank")
        posterior = posterior.withColumn("rank", F.col("rank") + 1)
    reads_of = lambda c: F.format_string("%.1f", F.aggregate(c, F.lit(0).cast("long"), lambda n, e: n + e["weight"]) / 2)
    zygosity = posterior.select(
        *of, "locus", "rank", "allele1", "allele2", F.format_string("%.6f", "z").alias("z"), F.format_string("%.6f", "c").alias("c"), F.format_string("%.6f", "prob").alias("prob"),
        reads_of("emissions1").alias("reads1"), reads_of("emissions2").alias("reads2"), _emission_text("emissions1").alias("e1"), _emission_text("emissions2").alias("e2"))
    likelihood = alleles.orderBy(*of, "locus", F.desc("llhd"), "allele").select(*of, "locus", "allele", F.format_string("%.6f", "llhd").alias("llhd"), F.array_join("alters", ";").alias("imputation"))
    for name, table in (("zygosity", zygosity), ("likelihood", likelihood), ("per_read", reads.select(*of, "name", "locus", "allele"))):
        table.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(f"{path}/{name}")
    if stored is not None:
        discard(stored)
    if header is not None:
        posterior.sparkSession.createDataFrame([(line,) for line in header.split("\n")], "value string").coalesce(1).write.text(f"{path}/header")


def read_typing_tsv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the three tables that ``write_typing_tsv`` wrote, as texts."""
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(f"{path}/{name}")


def json_to_tsv(documents: DataFrame, path: str) -> None:
    """Flatten reloaded results (``read_typing_json``) into the three tables, and their header."""
    loci = documents.select("sample", F.explode("per_loci").alias("l"))
    zygosity = loci.select("sample", "l.locus", F.coalesce("l.first_pair", F.lit(0)).alias("_before"), F.posexplode("l.zygosity").alias("_p", "z"))
    zygosity = zygosity.select("sample", "locus", (F.col("_before") + F.col("_p") + 1).alias("rank"), "z.*")
    zygosity = zygosity.withColumnsRenamed({"read1_emissions": "emissions1", "read2_emissions": "emissions2"})
    alleles = loci.select("sample", F.col("l.locus").alias("locus"), F.explode("l.per_allele").alias("a")).select("sample", "locus", "a.*")
    first = documents.select("header").first()
    write_typing_tsv(zygosity, alleles, documents.select("sample", F.explode("per_reads").alias("r")).select("sample", "r.*"), path, first["header"] if first else None)


def materialize_reference(spark: SparkSession, path: str, align_date: str | None, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table kept at ``path`` by gene: built when it is missing or its alignment date is another.

    Without a date, because the source is missing, the stored table is used as it is.
    """
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    exists = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    if exists:
        stored = spark.read.parquet(path)
        if align_date is None or stored.where(F.col("align_date") != align_date).isEmpty():
            return stored.drop("align_date")
    elif align_date is None:
        raise FileNotFoundError(f"neither a source nor a stored table at {path}")
    # written beside the old one, which ``build`` may be reading, and then put into its place
    fresh = f"{path.rstrip('/')}.new"
    build().withColumn("align_date", F.lit(align_date)).write.mode("overwrite").partitionBy("locus").parquet(fresh)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if exists:
        files.delete(place, True)
    if not files.rename(jvm.org.apache.hadoop.fs.Path(fresh), place):
        raise OSError(f"cannot put {fresh} into place")
    return spark.read.parquet(path).drop("align_date")
