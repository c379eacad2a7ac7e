"""Streams stop when they should, and a folder of files gives what a batch gives."""

import time

import pytest
from pyspark.sql import functions as F

from loomtype.streaming import reads as ST


def test_stop_after_n_and_when_all_names_were_seen(spark, tmp_path):
    rows = spark.range(12).select(F.col("id").alias("read_id"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("name"))
    for k in range(3):
        rows.where(f"read_id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for options, expected in (({"n": 5}, 5), ({"names": {"r1", "r11"}}, 2)):
        got = []
        stop = ST.StopAfter(lambda batch, epoch: got.extend(r["name"] for r in batch.collect()), **options)
        query = ST.stream_reads(spark, str(tmp_path / "in"), rows.schema).writeStream.foreachBatch(stop).trigger(availableNow=True).start()
        query.awaitTermination()
        assert len(got) == expected and stop.done


def test_unmatched_mates_leave_as_singles(spark, tmp_path):
    ddl = "key long, ts timestamp, value string"
    one = [(1, "2020-01-01 00:00:00", "a1"), (2, "2020-01-01 00:00:01", "a2"), (9, "2020-01-01 02:00:00", "late")]
    two = [(1, "2020-01-01 00:00:03", "b1"), (3, "2020-01-01 00:00:02", "b3"), (8, "2020-01-01 02:00:00", "late")]
    for name, data in (("one", one), ("two", two)):
        for i, part in enumerate((data[:2], data[2:], [(90 + i, "2020-01-01 05:00:00", "end") for i in range(1)])):
            frame = spark.createDataFrame(part, "key long, t string, value string").select("key", F.to_timestamp("t").alias("ts"), "value")
            frame.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    schema = spark.createDataFrame([], ddl).schema
    a, b = (ST.stream_reads(spark, str(tmp_path / n), schema) for n in ("one", "two"))
    got = {(r["key"], r["value1"], r["value2"]) for r in ST.run_available(ST.stream_pair_mates(a, b).select("key", "value1", "value2"), "append").collect()}
    assert {(1, "a1", "b1"), (2, "a2", None), (3, None, "b3")} <= got


def test_a_slow_writer_loses_nothing_when_the_query_is_stopped(spark, tmp_path, monkeypatch):
    rows = spark.range(20).select(F.col("id").alias("read_id"), F.concat(F.lit("r"), (F.col("id") % 2).cast("string")).alias("name"))
    for k in range(4):
        rows.where(f"read_id div 5 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    own = ST.StopAfter.__init__

    def slow(self, write, *options):
        def late(batch, epoch):
            time.sleep(2.5)
            write(batch, epoch)
            time.sleep(1.5)

        own(self, late, *options)

    monkeypatch.setattr(ST.StopAfter, "__init__", slow)
    stream = lambda: ST.stream_reads(spark, str(tmp_path / "in"), rows.schema)
    assert ST.run_until(stream(), n=7).count() == 7
    assert ST.run_until(stream(), names={"r1"}).where("name = 'r1'").count() >= 2


def test_a_batch_that_runs_again_counts_once(spark):
    rows = spark.range(4).select(F.col("id").alias("read_id"), F.lit("a").alias("name"))
    seen = []
    stop = ST.StopAfter(lambda batch, epoch: seen.append(batch.count()), n=6)
    stop(rows, 0)
    stop(rows, 0)
    assert not stop.done
    stop(rows, 1)
    stop(rows, 2)
    assert stop.done and seen == [4, 4, 2]


def test_a_writer_that_fails_counts_nothing(spark):
    def fail(batch, epoch):
        raise OSError("full")

    stop = ST.StopAfter(fail, names={"a"})
    with pytest.raises(OSError):
        stop(spark.range(4).select(F.col("id").alias("read_id"), F.lit("a").alias("name")), 0)
    assert not stop.done


def _fastq(folder, name, numbers):
    """A FASTQ file whose quality lines begin with @; a record of seven has a quality too few."""
    folder.mkdir(exist_ok=True)
    text = "".join(f"@r{k}/1 x\nACGTAC\n+\n@IIIII\n" if k % 7 else f"@r{k}/1 x\nACGTAC\n+\n@IIII\n" for k in numbers)
    (folder / name).write_text(text)


def test_fastq_files_are_streamed_record_by_record(spark, tmp_path):
    for k in range(4):
        _fastq(tmp_path / "in", f"s{k}_1.fastq", range(1 + 50 * k, 51 + 50 * k))
    (tmp_path / "in" / "empty_1.fastq").write_text("")
    good = {f"r{k}" for k in range(1, 201) if k % 7}
    got = ST.run_available(ST.stream_fastq(spark, str(tmp_path / "in"), 2), "append", ST.fastq_reads)
    assert got.count() == len(good) and {r["name"] for r in got.collect()} == good
    assert {r["sample"] for r in got.select("sample").distinct().collect()} == {"s0", "s1", "s2", "s3"}
    assert got.columns == ST.FASTQ_READS.names
    some = ST.run_until(ST.stream_fastq(spark, str(tmp_path / "in"), 1), n=60, then=ST.fastq_reads)
    assert some.count() == 60 and {r["name"] for r in some.collect()} <= good
    named = ST.run_until(ST.stream_fastq(spark, str(tmp_path / "in"), 1), names={"r3", "r150"}, then=ST.fastq_reads)
    assert sorted(r["name"] for r in named.collect()) == ["r150", "r3"]


def test_a_folder_without_records_streams_none(spark, tmp_path):
    _fastq(tmp_path / "in", "only.fastq", [])
    got = ST.run_available(ST.stream_fastq(spark, str(tmp_path / "in")), "append", ST.fastq_reads)
    assert got.count() == 0
