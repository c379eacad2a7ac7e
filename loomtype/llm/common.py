"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard as discard
from ..sources.shared import saved as saved

WORD = r"[^\x20\x09-\x0D]+"


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Let Arrow batches have ``size`` bytes, where the session has no limit of its own below that.

    Texts are long: batches of Spark's default size are held several times over by an executor and its workers.
    """
    if int(spark.conf.get(BATCH_BYTES).rstrip("b")) > size:
        spark.conf.set(BATCH_BYTES, f"{size}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lanes(n_rows: int, per_lane: int = 20_000) -> int:
    """Number of hash lanes that keeps each near ``per_lane`` rows at any input size."""
    return max(64, -(-n_rows // per_lane))


def spread(*cols: Column | str, lanes: int) -> Column:
    """A lane from 0 to ``lanes`` - 1 that depends on the values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(lanes)).cast("int")


def give_back() -> None:
    """Return what a task has freed to the system, where the C library can; Python workers live on and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
