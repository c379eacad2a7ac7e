"""Mixing sources to target weights with fixed-length blocks, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, lanes, saved

P = 2**31 - 1
ROUNDS = 12


def rounds(seed: int) -> list[tuple[int, int, int]]:
    """Constants of each round, from a multiplicative generator modulo the prime P."""
    z, out = seed + 123_456_789, []
    for _ in range(ROUNDS):
        row = []
        for _ in range(3):
            z = z * 48271 % P
            row.append(z)
        out.append((row[0], row[1], row[2]))
    return out


def permuted(x: str, n: str, key: str, seed: int) -> Column:
    """The image of ``x`` under the pseudorandom permutation of 0..n-1 that ``key`` selects.

    Swap-or-not (Hoang, Morris, Rogaway 2012) permutes 0..n-1 for any n; it needs no table and no power of two. In each
    round a number and its partner change places or not, by one bit hashed from the larger of both. The rounds are
    folded over an array, so that the expression stays small.
    """
    turns = ", ".join(f"named_struct('a', {a}L, 'c', {c}L, 'k', {k}L)" for a, c, k in rounds(seed))
    partner = f"((({key} + r.k) % {P} * 48271 + r.k) % {P} % {n} + {n} - v) % {n}"
    hashed = f"((greatest(v, p) % {P} * r.a + r.c) % {P})"
    turn = f"transform(array({partner}), p -> CASE WHEN ({hashed} * {hashed} + greatest(v, p)) % {P} DIV 32768 % 2 = 1 THEN p ELSE v END)[0]"
    # never null, so that no join evaluates it once more to filter by that
    return F.coalesce(F.expr(f"aggregate(array({turns}), {x}, (v, r) -> {turn})"), F.lit(0).cast("long"))


LANE = f"((coalesce(doc_id, 0) % {P} + {P}) % {P} * 48271 + size * 69621) % {P} % {{n}}"


def source_plan(sized: DataFrame, weights: tuple[float, ...], cap: float, block: int) -> DataFrame:
    """One row per source: size, target, number of blocks and of slots, and where its slots begin.

    Sources in code-point order (null last) take the weights in turn and share the total size; what a source cannot
    take (more than ``cap`` times its size) is shared again. The level is found in one pass over the sources sorted
    by the level at which each would be full.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.expr(f"(_i - 1) % {len(weights)} + 1"))
    per = per.withColumn("_i", F.row_number().over(order)).withColumn("_w", weight)
    full = Window.orderBy("_full", "_i").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("_full", "_i").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn(
        "_full", F.col("_cap") / F.col("_w")).withColumn(
        "_level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(full), F.lit(0.0)))
        / F.sum("_w").over(rest))
    fits = F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_i", "_level"))
    per = per.withColumn("_level", F.min(fits).over(everything)["_level"])
    per = per.withColumn("target", F.expr("least(_cap, coalesce(_level * _w, _cap))"))
    per = per.withColumn("blocks", F.expr(f"(source_size + {block - 1}) DIV {block}"))
    per = per.withColumn("slots", F.expr(
        f"CASE WHEN source_size > 0 THEN cast(least(floor(target * blocks / source_size + 0.5), {cap} * blocks) AS bigint) ELSE 0 END"))
    upto = Window.orderBy("_i")
    return per.select("source", "_i", "source_size", "target", "blocks", "slots",
                      (F.sum("slots").over(upto) - F.col("slots")).alias("first_slot"),
                      F.sum("slots").over(everything).alias("all_slots"))


class Mix:
    """The plan, drawn counts, slots and documents of one mix; see ``mix_sources``."""

    def __init__(self, docs: DataFrame, plan: DataFrame, draw: DataFrame, slots: DataFrame, placed: DataFrame, block: int):
        self.docs, self.plan, self.draw, self.slots, self.placed, self.block = docs, plan, draw, slots, placed, block

    def shard_counts(self) -> DataFrame:
        """The drawn number of slots of each source in each output shard."""
        return self.draw.join(self.plan.select("_i", "source"), "_i").select("shard", "source", F.col("n").alias("count"))

    def block_uses(self) -> DataFrame:
        return self.slots.groupBy("_i", "block").agg(
            F.count("*").alias("uses"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))

    def pieces(self) -> DataFrame:
        """A row for each document and block that it reaches into: its words there, the times and the shards where they are used."""
        cut = self.placed.where("size > 0").select("_i", "_lane", "_row", "begin", "size").withColumn("block", F.explode(F.expr(
            f"sequence(begin DIV {self.block}, (begin + size - 1) DIV {self.block})"))).withColumn(
            "first", F.expr(f"greatest(block * {self.block} - begin, 0L)")).withColumn(
            "words", F.expr(f"least((block + 1) * {self.block} - begin, size) - first"))
        # The planner takes the slots for as small as the plan they are exploded from, and would broadcast them.
        return cut.join(self.block_uses().hint("merge"), ["_i", "block"])

    def taken(self) -> DataFrame:
        """Per document: ``doc_id, source, size, source_size, target, taken``, and the first and last output shard that takes from it."""
        used = self.pieces().groupBy("_i", "_lane", "_row").agg(
            F.sum(F.col("words") * F.col("uses")).alias("_t"), F.min("first_shard").alias("first_shard"), F.max("last_shard").alias("last_shard"))
        return self.placed.join(used, ["_i", "_lane", "_row"], "left").select(
            "doc_id", "source", "size", "source_size", "target", F.coalesce("_t", F.lit(0)).alias("taken"), "first_shard", "last_shard")

    def texts(self) -> DataFrame:
        """The mixed documents, with the input's columns: copy r keeps a document's words in blocks used r times or more.

        A copy that keeps every word is the text as it was; a partial copy joins its words by single spaces. Where
        there is a column ``n_chars``, it is the new text's length.
        """
        runs = self.pieces().withColumn("copy", F.explode(F.expr("sequence(1L, uses)"))).groupBy(
            "_i", "_lane", "_row", "copy").agg(
            F.array_sort(F.collect_list(F.struct("first", "words"))).alias("_runs"), F.sum("words").alias("_kept"))
        words = F.array(F.regexp_extract_all(F.col("_doc.text"), F.lit(WORD), F.lit(0)))
        cut = lambda w: F.flatten(F.transform("_runs", lambda r: F.slice(w, (r["first"] + 1).cast("int"), r["words"].cast("int"))))
        part = F.transform(words, lambda w: F.array_join(cut(w), " "))[0]
        text = F.when(F.col("_kept") == F.col("size"), F.col("_doc.text")).otherwise(part)
        mixed = self.placed.join(runs, ["_i", "_lane", "_row"]).select("_doc", text.alias("_text"))
        made = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
        return mixed.select(*[made.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in self.docs.columns])


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, block: int = 64,
                shard_slots: int = 4096, seed: int = 11, keep_text: bool = False) -> Mix:
    """Mix all documents so that each source's words come near its target.

    Each source's words, its documents laid end to end, are cut into blocks of ``block`` words (the last may be
    shorter). A source gets as many slots as its target asks for. The source counts of each output shard of
    ``shard_slots`` slots are drawn from ``seed``: a multinomial draw without replacement from all slots (by a
    pseudorandom permutation of them), so that counts sum to every source's slots and none overshoots its cap. A
    shard's slots of a source follow those of the shards before it; slot j of a source takes the block to which the
    source's own permutation sends j modulo its number of blocks, so no block, and no document, is used more than
    ``cap`` times. Documents meet the drawn slots by an equi-join on (source, block).

    Null texts and texts without words have size 0 and are never taken; null ids and sources are kept (null source
    last); repeated rows are rows of their own; an empty table gives no rows; other columns are dropped unless
    ``keep_text``, which keeps all of the input's columns for ``texts``.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = saved(docs.select("doc_id", "source", size.alias("size")))
    plan = saved(source_plan(sized, weights, cap, block))
    n = lanes(docs.count())
    rows = docs.select("doc_id", "source", size.alias("size"), F.struct("*").alias("_doc")) if keep_text else sized
    rows = rows.withColumn("_lane", F.expr(LANE.format(n=n)))
    keyed = rows.withColumn("_k", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    plan_k = plan.withColumn("_k", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    starts = keyed.groupBy("_k", "_lane").agg(F.sum("size").alias("_s")).join(plan_k, "_k").select(
        "_k", "_lane", "_i", "source_size", "target",
        (F.sum("_s").over(Window.partitionBy("_k").orderBy("_lane")) - F.col("_s")).alias("_start"))
    lane = Window.partitionBy("_k", "_lane").orderBy("doc_id", "size")
    placed = keyed.join(starts, ["_k", "_lane"]).withColumn("_row", F.row_number().over(lane)).withColumn(
        "begin", F.col("_start") + F.sum("size").over(lane.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    ).drop("_start", "_k")

    draw = saved(drawn_counts(plan, shard_slots, seed))
    few = draw.select("_i", F.expr("shard DIV 1024").alias("_l"), "n").groupBy("_i", "_l").agg(F.sum("n").alias("_s"))
    few = few.select("_i", "_l", (F.sum("_s").over(Window.partitionBy("_i").orderBy("_l")) - F.col("_s")).alias("_base"))
    along = Window.partitionBy("_i", "_l").orderBy("shard")
    starts = draw.withColumn("_l", F.expr("shard DIV 1024")).join(few, ["_i", "_l"]).join(plan.select("_i", "blocks"), "_i").select(
        "_i", "shard", "n", "blocks", (F.col("_base") + F.sum("n").over(along) - F.col("n")).alias("start"))
    slots = starts.repartition(_tasks(plan), "_i", "shard").withColumn("_j", F.explode(F.expr("sequence(start, start + n - 1)"))).select(
        "_i", "shard", permuted("(_j % blocks)", "blocks", "_i", seed + 1).alias("block"))
    return Mix(docs, plan, draw, slots, placed, block)


def _tasks(plan: DataFrame) -> int:
    """Tasks for work on single slots: about a million each."""
    slots = plan.agg(F.sum("slots")).first()[0] or 0
    return max(4 * plan.sparkSession.sparkContext.defaultParallelism, slots >> 20)


def drawn_counts(plan: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """``_i, shard, n``: how many slots of each source each output shard draws."""
    chunk = 4096
    slots = plan.where("slots > 0").withColumn(
        "_c", F.explode(F.expr(f"sequence(0L, (slots - 1) DIV {chunk})"))).repartition(_tasks(plan), "_i", "_c").withColumn(
        "_at", F.explode(F.expr(f"sequence(first_slot + _c * {chunk}, first_slot + least((_c + 1) * {chunk}, slots) - 1)")))
    place = permuted("_at", "all_slots", "0L", seed)
    return slots.select("_i", place.alias("_p")).withColumn("shard", F.expr(f"_p DIV {shard_slots}")).groupBy("_i", "shard").agg(F.count("*").alias("n"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 1 THEN 5.0 WHEN 2 THEN 2.0 ELSE 1.0 END AS w, source_size * 3.0 AS cap FROM g),
f AS (SELECT *, cap / w AS brim, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT level FROM f WHERE level <= brim ORDER BY brim, i LIMIT 1),
t AS (SELECT source, i, source_size, least(cap, coalesce((SELECT level FROM l) * w, cap)) AS target, (source_size + 63) // 64 AS blocks FROM f),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target * blocks / source_size + 0.5), 3 * blocks) AS BIGINT) ELSE 0 END AS slots FROM t),
total AS (SELECT CAST(sum(slots) AS BIGINT) AS n FROM plan),
z(seed, t, v) AS (SELECT s, 0, CAST(s + 123456789 AS BIGINT) FROM (VALUES (11), (12)) AS x(s) UNION ALL SELECT seed, t + 1, v * 48271 % 2147483647 FROM z WHERE t < 36),
turns AS (SELECT seed, (t - 1) // 3 AS r, max(CASE t % 3 WHEN 1 THEN v END) AS a, max(CASE t % 3 WHEN 2 THEN v END) AS c, max(CASE t % 3 WHEN 0 THEN v END) AS k
  FROM z WHERE t > 0 GROUP BY seed, (t - 1) // 3),
own AS (SELECT i, blocks, unnest(range(slots)) AS j, sum(slots) OVER (ORDER BY i) - slots AS before FROM plan WHERE slots > 0),
shuffled(i, spot, x, r) AS (SELECT i, CAST(before + j AS BIGINT), CAST(before + j AS BIGINT), 0 FROM own UNION ALL
  SELECT i, spot, CASE WHEN (h * h + big) % 2147483647 // 32768 % 2 = 1 THEN p ELSE x END, r + 1 FROM (
    SELECT *, (big % 2147483647 * a + c) % 2147483647 AS h FROM (SELECT *, greatest(x, p) AS big FROM (
      SELECT s.*, a, c, ((k % 2147483647 * 48271 + k) % 2147483647 % n + n - x) % n AS p FROM shuffled s JOIN turns ON turns.r = s.r AND seed = 11, total)))),
drawn AS (SELECT i, x // 4096 AS shard, count(*) AS n FROM shuffled WHERE r = 12 GROUP BY i, x // 4096),
numbered AS (SELECT i, shard, CAST(sum(n) OVER (PARTITION BY i ORDER BY shard) - n AS BIGINT) AS start, n FROM drawn),
slot AS (SELECT i, shard, blocks, (start + unnest(range(n))) % blocks AS x FROM numbered JOIN plan USING (i)),
moved(i, shard, n, x, r) AS (SELECT i, shard, blocks, CAST(x AS BIGINT), 0 FROM slot UNION ALL
  SELECT i, shard, n, CASE WHEN (h * h + big) % 2147483647 // 32768 % 2 = 1 THEN p ELSE x END, r + 1 FROM (
    SELECT *, (big % 2147483647 * a + c) % 2147483647 AS h FROM (SELECT *, greatest(x, p) AS big FROM (
      SELECT m.*, a, c, (((i + k) % 2147483647 * 48271 + k) % 2147483647 % n + n - x) % n AS p FROM moved m JOIN turns ON turns.r = m.r AND seed = 12)))),
uses AS (SELECT i, x AS block, count(*) AS uses, min(shard) AS first_shard, max(shard) AS last_shard FROM moved WHERE r = 12 GROUP BY i, x),
r AS (SELECT d.*, i, source_size, target, ((coalesce(doc_id, 0) % 2147483647 + 2147483647) % 2147483647 * 48271 + size * 69621) % 2147483647
  % (SELECT greatest(64, CAST(ceil(count(*) / 20000.0) AS BIGINT)) FROM documents) AS lane FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
b AS (SELECT *, sum(size) OVER w - size AS begin, row_number() OVER w AS row FROM r WINDOW w AS (PARTITION BY i ORDER BY lane, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)),
e AS (SELECT i, row, begin, size, unnest(range(CAST(begin // 64 AS BIGINT), CAST((begin + size - 1) // 64 + 1 AS BIGINT))) AS block FROM b WHERE size > 0),
k AS (SELECT e.i, e.row, sum((least((e.block + 1) * 64 - begin, size) - greatest(e.block * 64 - begin, 0)) * uses) AS taken, min(first_shard) AS first_shard, max(last_shard) AS last_shard
  FROM e JOIN uses ON e.i = uses.i AND e.block = uses.block GROUP BY e.i, e.row)
SELECT doc_id, source, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, first_shard, last_shard FROM b LEFT JOIN k ON b.i = k.i AND b.row = k.row"""


def oracle_sql() -> str:
    """DuckDB SQL for ``mix_sources(documents).taken()``, spelled out for its defaults."""
    return ORACLE
