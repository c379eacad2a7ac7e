"""Reads as a stream: pairing of mates, running sums, stopping rules.

A stream has no end, so a watermark stands for it: a mate that did not come within ``wait`` leaves as a single.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pairs import pair_posterior
from ..sources.reads import read_fastq
from ..sources.shared import discard, new_path, saved

FASTQ_READS = T.StructType([T.StructField("sample", T.StringType()), T.StructField("read_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("mate", T.IntegerType()),
                            T.StructField("seq", T.StringType()), T.StructField("qual", T.StringType()), T.StructField("q", T.ArrayType(T.IntegerType()))])


def stream_reads(spark: SparkSession, path: str, schema: T.StructType, per_batch: int = 1) -> DataFrame:
    """A folder of parquet files as a stream, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def stream_fastq(spark: SparkSession, folder: str, per_batch: int = 8) -> DataFrame:
    """The FASTQ files of a folder as a stream of their paths, at most ``per_batch`` a batch, by the times they came.

    The checkpoint keeps which files were taken; their content is not read here. ``fastq_reads`` makes reads of a batch.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).load(folder).select("path")


def fastq_reads(batch: DataFrame, mate: int = 0) -> DataFrame:
    """The good reads of a batch of ``stream_fastq``; big files are split among tasks, records whole (``read_fastq``)."""
    paths = sorted(r["path"] for r in batch.select("path").collect())  # some files a batch
    if not paths:
        return batch.sparkSession.createDataFrame([], FASTQ_READS)
    return read_fastq(batch.sparkSession, paths, mate)[0].select(*FASTQ_READS.names)


def stream_pair_mates(one: DataFrame, two: DataFrame, time: str = "ts", wait: str = "10 minutes") -> DataFrame:
    """Stream-stream outer join of mates by ``key``; unmatched mates leave as singles when the watermark passes them."""
    a = one.select(F.col("key").alias("key1"), F.col(time).alias("t1"), F.col("value").alias("value1")).withWatermark("t1", wait)
    b = two.select(F.col("key").alias("key2"), F.col(time).alias("t2"), F.col("value").alias("value2")).withWatermark("t2", wait)
    near = F.expr(f"key1 = key2 AND t2 BETWEEN t1 - INTERVAL {wait} AND t1 + INTERVAL {wait}")
    return a.join(b, near, "full_outer").withColumn("key", F.coalesce("key1", "key2"))


def stream_accumulate(scores: DataFrame) -> DataFrame:
    """Running log-likelihood sums of alleles; write in update or complete mode."""
    return scores.groupBy("locus", "allele_id").agg(F.sum("llhd").alias("llhd"), F.count("*").alias("reads"))


def stream_pairs(pair_scores: DataFrame) -> DataFrame:
    """Running sums of pairs from per-read pair rows (``allele_pairs`` within a batch)."""
    return pair_scores.groupBy("locus", "i", "j").agg(F.sum("llhd").alias("z"), F.count("*").alias("reads"))


def stream_posterior(pair_scores: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """The posterior of the running pair sums of a stream, after all that is there, as a table in the shared folder.

    ``pair_scores`` has ``locus, i, j, llhd`` a read; each batch writes the posterior of the sums so far as an epoch of
    its own, so what is read is whole whenever the query stops. ``coverage`` (locus, i, j, c) is added where it is given.
    """
    def posterior(sums: DataFrame) -> DataFrame:
        return pair_posterior(sums.select("locus", "i", "j", "z"), coverage)

    return run_available(stream_pairs(pair_scores), "complete", posterior)


class StopAfter:
    """A ``foreachBatch`` function that passes reads on until ``n`` were taken or all ``names`` were seen.

    What a batch gives counts only when ``write`` has returned, by the batch's number: a batch that is run again counts
    once, and a query may be stopped as soon as ``done`` without losing rows. Batches after that are not read at all.
    """

    def __init__(self, write, n: int | None = None, names: set[str] | None = None):
        self.write, self.n, self.names = write, n, None if names is None else set(names)
        self.taken: dict[int, int] = {}
        self.found: dict[int, set[str]] = {}

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        taken = sum(k for e, k in self.taken.items() if e != epoch)
        left = None if self.names is None else self.names - set().union(*(x for e, x in self.found.items() if e != epoch))
        if taken == self.n or left == set():
            return
        if left is not None:
            batch = batch.where(F.col("name").isin(sorted(left)))
        if self.n is not None:
            batch = batch.orderBy("read_id").limit(self.n - taken)
        rows = saved(batch)
        try:
            count = rows.count()
            names = set() if left is None else {r["name"] for r in rows.select("name").distinct().collect()}
            self.write(rows, epoch)
        finally:
            discard(rows)
        self.taken[epoch], self.found[epoch] = count, names

    @property
    def done(self) -> bool:
        return (self.n is not None and sum(self.taken.values()) >= self.n) or (self.names is not None and self.names <= set().union(*self.found.values()))


def read_lengths(reads: DataFrame) -> DataFrame:
    """Read lengths in use: the model depends on them, and reads are scored by their own."""
    return reads.groupBy(F.length("seq").alias("read_length")).count()


def run_available(source: DataFrame, mode: str = "complete", then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Process all that is there into a table in the shared folder: of complete results the last, of others all.

    ``then`` is applied to each batch before it is written.
    """
    spark = source.sparkSession
    path, epochs, schema = new_path(spark, "stream"), [], source.schema

    def write(batch: DataFrame, epoch: int) -> None:
        nonlocal schema
        made = batch if then is None else then(batch)
        made.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        schema = made.schema
        epochs.append(epoch)

    query = source.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    if not epochs:
        return spark.createDataFrame([], schema)
    if mode == "complete":
        return spark.read.schema(schema).parquet(f"{path}/epoch={max(epochs)}")
    return spark.read.schema(schema).parquet(*[f"{path}/epoch={e}" for e in sorted(set(epochs))])


def run_until(source: DataFrame, n: int | None = None, names: set[str] | None = None, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The reads of a stream until ``n`` were taken or all ``names`` were seen, as a table in the shared folder.

    ``then`` makes the reads of a batch (``fastq_reads`` of files); batches after the end are not made.
    """
    spark = source.sparkSession
    path, epochs, schema = new_path(spark, "stream"), set(), source.schema

    def write(batch: DataFrame, epoch: int) -> None:
        nonlocal schema
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        schema = batch.schema
        epochs.add(epoch)

    stop = StopAfter(write, n, names)

    def take(batch: DataFrame, epoch: int) -> None:
        if not stop.done:
            stop(batch if then is None else then(batch), epoch)

    query = source.writeStream.foreachBatch(take).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start()
    while not query.awaitTermination(1):
        if stop.done:  # all that counts is written; later batches write nothing
            query.stop()
    if not epochs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/epoch={e}" for e in sorted(epochs)])
