"""Sharding by proportional stratified interleaving, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lanes


def _text_key(col: Column) -> Column:
    """A non-null key, so that null sources form one stratum of their own."""
    return F.coalesce(F.concat(F.lit("s"), col.cast("string")), F.lit("n"))


def interleave_shards(docs: DataFrame, n_shards: int = 24, seed: int = 0, id_col: str = "doc_id",
                      text_col: str = "text", source_col: str = "source", per_lane: int = 20_000) -> DataFrame:
    """Deal all rows into ``n_shards`` shards whose row counts differ by one at most.

    Rows are shuffled within each source by a seeded hash and ranked; the row of rank r among n gets the
    fractional rank (2r - 1) / 2n. All rows are then laid out by fractional rank and cut into equal runs, so every
    shard holds each source in the proportion of the whole.

    Both rankings are prefix sums: rows fall into lanes by hash (or by fractional rank), lanes are counted, and a
    row's rank is its lane's start plus its place in the lane. A lane holds about ``per_lane`` rows however large
    one source is.

    Returns ``doc_id, size, text_crc32, source, shard, slot``: size is the text's UTF-8 bytes plus 8, slot the place
    in the shard. Null texts count as no bytes (crc32 0); null ids and sources are kept, null sources as a stratum
    of their own; repeated rows each get a slot (which of two equal rows comes first is open); equal texts are
    spread like all other rows; an empty table gives no rows. Other columns are dropped.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.col(source_col).alias("source"),
        _text_key(F.col(source_col)).alias("_stratum"),
    )
    total = docs.count()
    n = lanes(total, per_lane)
    mixed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_crc32"), F.col("size"))
    rows = rows.withColumn("_mix", F.shiftrightunsigned(mixed, 33)).withColumn(
        "_lane", F.shiftright(F.col("_mix") * F.lit(n).cast("long"), 31).cast("int"))

    before = Window.partitionBy("_stratum").orderBy("_lane")
    in_stratum = rows.groupBy("_stratum", "_lane").agg(F.count("*").alias("_n")).select(
        "_stratum", "_lane",
        (F.sum("_n").over(before) - F.col("_n")).alias("_start"),
        F.sum("_n").over(Window.partitionBy("_stratum")).alias("_of"))
    lane = Window.partitionBy("_stratum", "_lane").orderBy("_mix", "doc_id", "text_crc32", "size")
    ranked = rows.join(in_stratum, ["_stratum", "_lane"]).withColumn(
        "_fraction", (2 * (F.col("_start") + F.row_number().over(lane)) - 1) / (2 * F.col("_of"))).withColumn(
        "_run", F.floor(F.col("_fraction") * n).cast("int")).drop("_lane", "_mix", "_start", "_of")

    runs = ranked.groupBy("_run").agg(F.count("*").alias("_n")).select(
        "_run", (F.sum("_n").over(Window.orderBy("_run")) - F.col("_n")).alias("_start"))
    run = Window.partitionBy("_run").orderBy("_fraction", "_stratum")
    place = F.col("_start") + F.row_number().over(run) - 1
    return ranked.join(runs, "_run").withColumn("_place", place).withColumn(
        "shard", F.floor(F.col("_place") * n_shards / F.lit(max(total, 1))).cast("int") if total * n_shards < 2**52
        else F.expr(f"cast(_place * {n_shards} div {total} as int)")).select(
        "doc_id", "size", "text_crc32", "source", "shard",
        (F.col("_place") - F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")).alias("slot"))
