"""Queries over reads, mates and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import select as S
from ..sources.reads import pair_mates, read_from_pair
from ..streaming import reads as ST
from .registry import derive, query, text

_EVENTS = "SELECT event_id AS read_id, concat('r', CAST(event_id // 2 AS STRING)) AS name, event_id % 2 + 1 AS mate, CAST(user_id AS STRING) AS seq, event_type AS qual FROM events"
_MATES = f"WITH e AS ({_EVENTS}), one AS (SELECT * FROM e WHERE mate = 1 AND read_id % 5 <> 0), two AS (SELECT * FROM e WHERE mate = 2 AND read_id % 7 <> 0)"


def _mates(spark, sf):
    e = derive(spark, sf, text(_EVENTS.replace("//", "div"), "events"), "events")
    return e.where("mate = 1 AND read_id % 5 <> 0"), e.where("mate = 2 AND read_id % 7 <> 0")


_KIND = "CASE WHEN one.name IS NULL THEN 'single2' WHEN two.name IS NULL THEN 'single1' ELSE 'paired' END"


@query("jn1_pair_mates", f"{_MATES} SELECT coalesce(one.name, two.name) AS key, {_KIND} AS kind, one.seq AS seq1, two.seq AS seq2 FROM one FULL OUTER JOIN two ON one.name = two.name")
def jn1(spark, sf):
    return pair_mates(*_mates(spark, sf)).select("key", "kind", F.col("r1.seq").alias("seq1"), F.col("r2.seq").alias("seq2"))


@query("jn2_drop_singles", f"{_MATES} SELECT one.name AS key, one.read_id AS id1, two.read_id AS id2 FROM one JOIN two ON one.name = two.name")
def jn2(spark, sf):
    return pair_mates(*_mates(spark, sf), keep_singles=False).select("key", F.col("r1.read_id").alias("id1"), F.col("r2.read_id").alias("id2"))


@query("jn3_read_from_pair", f"{_MATES} SELECT one.name AS key, one.seq AS seq1, two.seq AS seq2, CAST(length(one.qual) AS INT) AS qualities FROM one JOIN two ON one.name = two.name WHERE one.name = 'r11'")
def jn3(spark, sf):
    r = read_from_pair(pair_mates(*_mates(spark, sf), keep_singles=False), "r11")
    return r.select("key", F.col("r1.seq").alias("seq1"), F.col("r2.seq").alias("seq2"), F.size("q1").alias("qualities"))


@query("ud6_custom_mate_key", f"{_MATES} SELECT one.seq AS key, count(*) AS pairs FROM one JOIN two ON one.seq = two.seq GROUP BY one.seq")
def ud6(spark, sf):
    return pair_mates(*_mates(spark, sf), keep_singles=False, key=F.col("seq")).groupBy("key").agg(F.count("*").alias("pairs"))


@query("flt7_limit_reads", f"WITH e AS ({_EVENTS}) SELECT read_id, name FROM e ORDER BY read_id LIMIT 25")
def flt7(spark, sf):
    e = derive(spark, sf, text(_EVENTS.replace("//", "div"), "events"), "events")
    return S.limit_reads(e, 25).select("read_id", "name")


@query("flt8_specific_reads", f"WITH e AS ({_EVENTS}) SELECT name, min(read_id) AS read_id FROM e WHERE name IN (SELECT DISTINCT concat('r', CAST(user_id AS STRING)) FROM events) GROUP BY name")
def flt8(spark, sf):
    e = derive(spark, sf, text(_EVENTS.replace("//", "div"), "events"), "events")
    wanted = derive(spark, sf, "SELECT concat('r', CAST(user_id AS STRING)) AS name FROM {events}", "events")
    return S.specific_reads(e, wanted).select("name", "read_id")


@query("flt9_drop_unparsed_quality", "SELECT event_type, count(*) AS reads FROM events WHERE length(event_type) = length(CAST(user_id AS STRING)) + 3 GROUP BY event_type")
def flt9(spark, sf):
    e = derive(spark, sf, "SELECT event_id AS read_id, event_type AS qual, concat('ACG', CAST(user_id AS STRING)) AS seq FROM {events}", "events")
    return S.split_by_quality(e)[0].groupBy(F.col("qual").alias("event_type")).agg(F.count("*").alias("reads"))


_STREAMED = "SELECT event_type AS locus, user_id % 20 AS allele_id, CAST(round(value * 100) AS BIGINT) AS llhd, event_id FROM events"


def _stream(spark, sf):
    # a pattern, so that a table of one file can be streamed like a folder
    rows = ST.stream_reads(spark, f"{sf}/event[s].parquet", spark.read.parquet(f"{sf}/events.parquet").schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).select(F.col("event_type").alias("locus"), (F.col("user_id") % 20).alias("allele_id"), F.round(F.col("value") * 100).cast("long").alias("llhd"), "event_id", "ts", "user_id")


@query("st1_stream_reads", "SELECT event_type AS locus, count(*) AS reads FROM events GROUP BY event_type")
def st1(spark, sf):
    return ST.run_available(_stream(spark, sf).groupBy("locus").agg(F.count("*").alias("reads")))


@query("st3_stream_accumulate", f"SELECT locus, allele_id, CAST(sum(llhd) AS BIGINT) AS llhd, count(*) AS reads FROM ({_STREAMED}) GROUP BY locus, allele_id")
def st3(spark, sf):
    return ST.run_available(ST.stream_accumulate(_stream(spark, sf)))


# Pairs of alleles next to each other, with likelihoods in whole hundred-thousandths.
_PAIRED = "SELECT event_type AS locus, user_id % 20 AS i, user_id % 20 + event_id % 3 AS j, CAST(round(value * 100) AS BIGINT) AS llhd FROM events"


@query("st3_stream_posterior", f"""WITH z AS (SELECT locus, i, j, sum(llhd) / 100000.0 AS z FROM ({_PAIRED}) GROUP BY locus, i, j), m AS (SELECT *, pow(10.0, z - max(z) OVER (PARTITION BY locus)) AS p FROM z)
SELECT locus, i, j, round(z, 5) AS z, round(p / sum(p) OVER (PARTITION BY locus), 6) AS prob FROM m""")
def st3b(spark, sf):
    rows = _stream(spark, sf)
    # as the table above, of a stream's columns; user_id is there whole
    pairs = rows.select("locus", (F.col("user_id") % 20).alias("i"), (F.col("user_id") % 20 + F.col("event_id") % 3).alias("j"), (F.col("llhd") / 100000).alias("llhd"))
    return ST.stream_posterior(pairs).select("locus", "i", "j", F.round("z", 5).alias("z"), F.round("prob", 6).alias("prob"))


# Singles leave when the watermark, ten minutes behind the slower side, has passed them by ten minutes more.
@query("st2_stream_pair_mates", """WITH e AS (SELECT event_id // 2 AS key, ts, CAST(round(value * 100) AS BIGINT) AS v, event_id % 2 AS side FROM events),
w AS (SELECT least(max(ts) FILTER (side = 0), max(ts) FILTER (side = 1)) - INTERVAL 20 MINUTE AS past FROM e),
j AS (SELECT coalesce(a.key, b.key) AS key, a.v AS value1, b.v AS value2, a.ts AS t1, b.ts AS t2 FROM (SELECT * FROM e WHERE side = 0) a
  FULL OUTER JOIN (SELECT * FROM e WHERE side = 1) b ON a.key = b.key AND b.ts BETWEEN a.ts - INTERVAL 10 MINUTE AND a.ts + INTERVAL 10 MINUTE)
SELECT key, value1, value2 FROM j, w WHERE t1 IS NOT NULL AND t2 IS NOT NULL OR coalesce(t1, t2) < past""")
def st2(spark, sf):
    rows = _stream(spark, sf).select(F.floor(F.col("event_id") / 2).alias("key"), "ts", F.col("llhd").alias("value"), "event_id")
    paired = ST.stream_pair_mates(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"))
    return ST.run_available(paired.select("key", "value1", "value2"), "append")


@query("st4_stream_stop", "SELECT event_id AS read_id, event_type AS name FROM events ORDER BY event_id LIMIT 40")
def st4(spark, sf):
    rows = _stream(spark, sf).select(F.col("event_id").alias("read_id"), F.col("locus").alias("name"))
    return ST.run_until(rows, n=40)


@query("st4_stream_names", "SELECT event_id AS read_id, event_type AS name FROM events WHERE event_type IN (SELECT min(event_type) FROM events)")
def st4b(spark, sf):
    first = spark.read.parquet(f"{sf}/events.parquet").agg(F.min("event_type")).first()[0]
    rows = _stream(spark, sf).select(F.col("event_id").alias("read_id"), F.col("locus").alias("name"))
    return ST.run_until(rows, names={first})


@query("st5_first_read_setup", "SELECT length(text) AS read_length, count(*) AS count FROM documents WHERE text IS NOT NULL GROUP BY 1")
def st5(spark, sf):
    return ST.read_lengths(derive(spark, sf, "SELECT text AS seq FROM {documents} WHERE text IS NOT NULL", "documents")).select(F.col("read_length").cast("long"), "count")


@query("jn29_best_offset_mismatches", """
WITH b AS (SELECT item_id AS id, text FROM benchmark WHERE text IS NOT NULL), p AS (SELECT a.id AS a_id, c.id AS b_id, CASE WHEN length(a.text) <= length(c.text) THEN a.text ELSE c.text END AS s,
  CASE WHEN length(a.text) <= length(c.text) THEN c.text ELSE a.text END AS l FROM b a JOIN b c ON c.id % 10 = a.id % 10 AND c.id > a.id),
o AS (SELECT *, unnest(range(length(l) - length(s) + 1)) AS o FROM p), m AS (SELECT a_id, b_id, o, length(l) - length(s) AS extra, list_sum([CASE WHEN x[1] <> x[2] THEN 1 ELSE 0 END for x in list_zip(string_split(s, ''), string_split(substr(l, CAST(o + 1 AS INT), length(s)), ''))]) AS d FROM o)
SELECT a_id, b_id, CAST(min(d) + any_value(extra) AS BIGINT) AS mismatches FROM m GROUP BY a_id, b_id""")
def jn29(spark, sf):
    from ..operators.similar import best_offset_mismatches

    b = derive(spark, sf, "SELECT item_id AS id, text AS seq FROM {benchmark} WHERE text IS NOT NULL", "benchmark")
    pairs = b.select((F.col("id") % 10).alias("key"), F.col("id").alias("a_id"), F.col("seq").alias("a")).join(
        b.select((F.col("id") % 10).alias("key"), F.col("id").alias("b_id"), F.col("seq").alias("b")), "key").where("a_id < b_id")
    return best_offset_mismatches(pairs, ["a_id", "b_id"], "a", "b")


@query("jn28_cross_locus_similarity", """
WITH b AS (SELECT item_id AS id, item_id % 4 AS locus, text FROM benchmark WHERE text IS NOT NULL), x AS (SELECT DISTINCT id, locus, unnest(string_split(text, ' ')) AS w FROM b), k AS (SELECT DISTINCT locus, w FROM x)
SELECT a.locus AS locus1, c.locus AS locus2, CAST(min(levenshtein(a.w, c.w)) AS INT) AS nearest FROM k a JOIN k c ON a.locus < c.locus AND length(a.w) = length(c.w) GROUP BY a.locus, c.locus""")
def jn28(spark, sf):
    from ..operators.similar import cross_locus_similarity

    b = derive(spark, sf, "SELECT item_id % 4 AS locus, text FROM {benchmark} WHERE text IS NOT NULL", "benchmark")
    words = b.select("locus", F.explode(F.split("text", " ")).alias("seq")).distinct().withColumn("exon", F.length("seq"))
    return cross_locus_similarity(words).groupBy("locus1", "locus2").agg(F.min("nearest").alias("nearest"))
