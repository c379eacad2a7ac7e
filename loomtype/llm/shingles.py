"""Exact n-gram Jaccard join by vertical partitioning, and its connected components.

The join never compares all pairs of a group. Candidates come from prefixes under a global order of the shingles
(rare ones first): texts above the threshold share a shingle within the first part of both. For counting, all n-grams
are in the order of their hashes, which is cut into fragments: the overlap of each candidate pair is counted in every
fragment by itself, and the partial counts are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, saved, small_batches
from .textbytes import slices
from .wordcache import mixed, span_hashes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = np.random.default_rng(20).integers(1, 2**63, 64, np.uint64) | np.uint64(1)
SLICE = 500_000


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, lower-cased, and the number of words of each row."""
    filled = ~_GAP[data]
    first = filled.copy()
    first[1:] &= ~filled[:-1]
    inside = offsets[:-1][offsets[:-1] < len(data)]
    first[inside] = filled[inside]
    starts = np.flatnonzero(first)
    last = filled
    last[:-1] &= _GAP[data[1:]]
    edges = offsets[1:] - 1
    edges = edges[edges >= 0]
    last[edges] = ~_GAP[data[edges]]
    ends = np.flatnonzero(last) + 1
    low = np.zeros(len(data) + 8, np.uint8)
    np.take(_LOWER, data, out=low[: len(data)])
    return span_hashes(low, starts, ends), np.diff(np.searchsorted(starts, offsets))


def _windows(words: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n):
        total += words[k : k + len(total)] * _PLACE[k]
    return total


def _few(words: np.ndarray, n: int) -> np.uint64:
    """The one shingle of a text of fewer than ``n`` words."""
    return np.array([len(words)], np.uint64)[0] + (words * _PLACE[n : n + len(words)]).sum(dtype=np.uint64)


def _parts(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """One text in parts of about ``size`` bytes that cut no word."""
    at = 0
    while at < len(data):
        to = at + size
        while to < len(data):
            gaps = np.flatnonzero(_GAP[data[to : to + size]])
            to += size if not len(gaps) else 0
            if len(gaps):
                to += int(gaps[0])
                break
        yield data[at : min(to, len(data))]
        at = to


def _long_set(data: np.ndarray, n: int, size: int) -> np.ndarray:
    """All shingles of one long text, part by part with the last n - 1 words carried over."""
    n_words = 0
    for part in _parts(data, size):
        filled = ~_GAP[part]
        n_words += int(filled[0]) + int((filled[1:] & ~filled[:-1]).sum())
    out, at, carried = np.empty(max(n_words - n + 1, 1), np.uint64), 0, np.zeros(0, np.uint64)
    for part in _parts(data, size):
        words = np.concatenate([carried, word_hashes(part, np.array([0, len(part)]))[0]])
        carried = words[max(len(words) - n + 1, 0) :]
        got = _windows(words, n)
        out[at : at + len(got)] = got
        at += len(got)
    if n_words >= n:
        return out
    out[0] = _few(carried, n) if n_words else 0
    return out[: min(n_words, 1)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int, size: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each row in the order of their hashes, and where each row's begin (and the last end).

    A text of fewer words is one shingle, one without words none. A single row of more than ``size`` bytes is read in parts.
    """
    if len(offsets) == 2 and len(data) > size:
        hashes = _long_set(data, n, size)
        at = np.array([0, len(hashes)])
    else:
        words, counts = word_hashes(data, offsets)
        at = np.concatenate([[0], np.cumsum(np.where(counts >= n, counts - n + 1, counts > 0))])
        ends = np.cumsum(counts)
        whole = np.ones(len(words), bool)
        for k in range(1, n):  # a window must not reach beyond its row
            whole[np.maximum(ends - k, 0)[counts >= k]] = False
        hashes = np.empty(at[-1], np.uint64)
        spot = np.ones(len(hashes), bool)
        short = np.flatnonzero((counts > 0) & (counts < n))
        spot[at[short]] = False
        hashes[spot] = _windows(words, n)[whole[: max(len(words) - n + 1, 0)]]
        for i in short.tolist():
            hashes[at[i]] = _few(words[ends[i] - counts[i] : ends[i]], n)
    for block in range(0, len(hashes), size):
        hashes[block : block + size] = mixed(hashes[block : block + size])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a > 1:
            hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=new[1:])
    new[at[:-1][at[:-1] < len(hashes)]] = True
    if new.all():
        return hashes, at
    upto = np.concatenate([[0], np.cumsum(new)]) if len(at) > 2 else np.array([0, new.sum()])
    return hashes[new], upto[at] if len(at) > 2 else upto


def _classes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set: the sum of its members' hashes, hashed again with its size."""
    sizes = np.diff(at)
    total = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        total[some] = np.add.reduceat(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), at[:-1][some])
    return mixed(total * np.uint64(0x9E3779B97F4A7C15) + sizes.astype(np.uint64)).view(np.int64)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), [f.split()[0] for f in schema.split(", ")])


CLASSES = "doc_id long, n_shingles long, class long, first_part binary"


def shingle_classes(docs: DataFrame, n: int) -> DataFrame:
    """Per document: the size and a 64-bit digest of its shingle set; equal sets form a class (null: no shingles).

    Two different sets of one size share a digest with a chance of 2^-64. ``first_part`` has the shingles in the
    first quarter of the hashes, as 32-bit remainders; it is null where the task has seen the class before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                hashes, at = shingle_sets(data, offsets, n)
                classes = _classes(hashes, at)
                parts: list[bytes | None] = [None] * rows.num_rows
                for i in seen.fresh(classes, at):
                    own = hashes[at[i] : at[i + 1]]
                    parts[i] = np.unique(own[: np.searchsorted(own, np.uint64(1 << 62))].astype(np.uint32)).tobytes()
                yield _batch(CLASSES, rows.column("doc_id"), pa.array(np.diff(at), pa.int64()),
                             pa.array(classes, mask=np.diff(at) == 0), pa.array(parts, pa.binary()))

    return docs.select("doc_id", "text").mapInArrow(run, CLASSES)


class Seen:
    """The classes that a task has met, forgotten from time to time: copies are then handled again, to no effect."""

    def __init__(self, limit: int = 100_000):
        self.known: set[int] = set()
        self.limit = limit

    def fresh(self, classes: np.ndarray, at: np.ndarray, held: np.ndarray | None = None) -> list[int]:
        """Rows with shingles (and marked in ``held``) whose class is new."""
        wanted = np.diff(at) > 0 if held is None else held & (np.diff(at) > 0)
        out = []
        for i, c in zip(np.flatnonzero(wanted).tolist(), classes[wanted].tolist()):
            if c not in self.known:
                self.known.add(c)
                out.append(i)
        if len(self.known) > self.limit:
            self.known.clear()
        return out


COUNTS = "fragment int, once binary, more binary"
FREQUENT = "key long, n long"
#: About how many shingles a fragment of the counting holds, and a task gathers before it sends them.
FRAGMENT = 1 << 21


def frequent_shingles(docs: DataFrame, n: int, least: int, most: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles in at least ``least`` documents with their counts, over all documents.

    Counting is partitioned: a task counts the shingles of a few million of its texts' windows, as remainders of
    24 + ``bits`` bits, and sends them to 2^``bits`` ranges of the hash, so that a shingle which very many documents
    hold is one number per shipment. Counts only set the order of the shingles, so keys of fewer bits change no
    result; nor does keeping the ``most`` commonest, which bounds what each task gets.
    """

    def shipment(blocks: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(blocks)
        keys.sort()
        edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        counts = np.diff(np.append(edges, len(keys)))
        keys = keys[edges]
        out: dict[int, list[bytes | None]] = {}
        for place, rows in enumerate((counts == 1, counts > 1)):
            own, times = keys[rows], counts[rows].astype("<u4")
            part = (own >> np.uint64(24)).astype(np.int64)
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
            low = _three(own) if place == 0 else np.stack([own.astype("<u4") & np.uint32(0xFFFFFF), times], axis=1)
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(part)]):
                out.setdefault(int(part[a]), [None, None])[place] = low[a:b].tobytes()
        return _batch(COUNTS, pa.array(list(out), pa.int32()), *(pa.array([v[i] for v in out.values()], pa.binary()) for i in (0, 1)))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, held = [], 0
        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                blocks.append(shingle_sets(data, offsets, n)[0] >> np.uint64(40 - bits))
                held += len(blocks[-1])
                if held >= FRAGMENT:
                    yield shipment(blocks)
                    blocks, held = [], 0
        if held:
            yield shipment(blocks)

    def gather(key, table):
        keys, counts = [], []
        for once in table.column("once").to_pylist():
            if once:
                three = np.frombuffer(once, np.uint8).reshape(-1, 3).astype(np.uint32)
                keys.append(three[:, 0] | three[:, 1] << np.uint32(8) | three[:, 2] << np.uint32(16))
                counts.append(np.ones(len(three), np.uint32))
        for more in table.column("more").to_pylist():
            if more:
                pairs = np.frombuffer(more, "<u4").reshape(-1, 2)
                keys.append(pairs[:, 0])
                counts.append(pairs[:, 1])
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys)
        keys = keys[order]
        edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(counts[order].astype(np.int64), edges)
        keep = total >= least
        full = keys[edges[keep]].astype(np.int64) | (key[0].as_py() << 24)
        return pa.table({"key": pa.array(full), "n": pa.array(total[keep])})

    common = saved(docs.select("text").mapInArrow(scatter, COUNTS).groupBy("fragment").applyInArrow(gather, FREQUENT))
    level = F.floor(F.log2("n") * 4)
    kept, lowest = 0, None
    for row in common.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if kept + row["count"] > most:
            break
        kept, lowest = kept + row["count"], row["level"]
    if lowest is None:
        discard(common)
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    got = common.where(level >= lowest).toPandas().sort_values("key")
    discard(common)
    return got["key"].to_numpy(np.int64).view(np.uint64), np.minimum(got["n"], 2**31 - 1).to_numpy(np.int32)


def _three(keys: np.ndarray) -> np.ndarray:
    """The lowest three bytes of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3]


PREFIX = "sig long, class long, at long"


def prefix_rows(docs: DataFrame, n: int, percent: int, order, bits: int, least: int, most: int) -> DataFrame:
    """A row for each shingle in a document's prefix, which holds size - ceil(percent% of size) + 1 shingles.

    ``at`` packs the shingle's place and the set's size: place * 2^32 + size. Only shingles whose count in ``order``
    (0 if it is not there) is from ``least`` to ``most`` have rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = order.value
        seen = Seen()
        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                hashes, at = shingle_sets(data, offsets, n)
                classes = _classes(hashes, at)
                common = np.zeros(len(hashes), np.int32)
                if len(keys) and len(hashes):
                    short = hashes >> np.uint64(40 - bits)
                    where = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
                    hit = keys[where] == short
                    common[hit] = counts[where[hit]]
                out: list[list[np.ndarray]] = [[], [], []]
                for i in seen.fresh(classes, at):
                    a, b = int(at[i]), int(at[i + 1])
                    size = b - a
                    first = size - -(-size * percent // 100) + 1
                    own = common[a:b]
                    if own.any():
                        rank = np.argsort(own, kind="stable")[:first]
                    else:
                        rank = np.arange(first)
                    place = np.flatnonzero((own[rank] >= least) & (own[rank] <= most))
                    out[0].append(hashes[a + rank[place]])
                    out[1].append(np.full(len(place), classes[i]))
                    out[2].append(place << 32 | size)
                if out[0]:
                    sig, digest, place = (np.concatenate(c) for c in out)
                    yield _batch(PREFIX, pa.array(sig.view(np.int64)), pa.array(digest), pa.array(place))

    return docs.select("text").mapInArrow(run, PREFIX)


SEGMENTS = "class long, fragment int, segment array<long>"


def segments(docs: DataFrame, n: int, wanted, fragments: int) -> DataFrame:
    """The shingles of each class in each fragment of the order, for classes that the bit table ``wanted`` may hold."""
    bits = fragments.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wanted.value
        seen = Seen()
        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                hashes, at = shingle_sets(data, offsets, n)
                every = _classes(hashes, at)
                classes, parts, out = [], [], []
                for i in seen.fresh(every, at, _in_table(table, every)):
                    own = hashes[at[i] : at[i + 1]]
                    cut = np.searchsorted(own >> np.uint64(64 - bits), np.arange(fragments + 1).astype(np.uint64))
                    for part, (c, d) in enumerate(zip(cut, cut[1:])):
                        if d > c:
                            classes.append(int(every[i]))
                            parts.append(part)
                            out.append(own[c:d])
                if out:
                    ends = np.concatenate([[0], np.cumsum([len(o) for o in out])]).astype(np.int32)
                    yield _batch(SEGMENTS, pa.array(classes, pa.int64()), pa.array(parts, pa.int32()),
                                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out).view(np.int64))))

    return docs.select("text").mapInArrow(run, SEGMENTS).groupBy("class", "fragment").agg(F.first("segment").alias("segment"))


BLOOM_BYTES = 1 << 22


def _bits(classes: np.ndarray) -> np.ndarray:
    return (classes.view(np.uint64) % np.uint64(BLOOM_BYTES * 8)).astype(np.int64)


def _in_table(table: np.ndarray, classes: np.ndarray) -> np.ndarray:
    at = _bits(classes)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bit_table(spark: SparkSession, classes: DataFrame):
    """A broadcast bit table of fixed size (4 MB) that holds all ``classes``, built by the tasks that hold them.

    It spares most other classes the shuffle; the exact join follows, so a full table costs time, never a link.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = np.zeros(0, np.int64)
        for batch in batches:
            pos = np.union1d(pos, _bits(batch.column(0).to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array(pos >> 3, pa.int32()), pa.array(pos & 7, pa.int32())], ["byte", "bit"])

    marks = classes.select("class").mapInArrow(mark, "byte int, bit int").groupBy("byte").agg(
        F.bit_or(F.expr("shiftleft(1, bit)")).alias("bits")).toPandas()
    table = np.zeros(BLOOM_BYTES, np.uint8)
    table[marks["byte"].to_numpy()] = marks["bits"].to_numpy().astype(np.uint8)
    return spark.sparkContext.broadcast(table)


def plausible(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` that the first quarter of the order alone does not rule out.

    Sets of sizes na, nb reach the threshold only if at most (100 - percent) / (100 + percent) of na + nb shingles are
    in one of them alone; for most false candidates the first quarter already holds more.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = bit_table(pairs.sparkSession, ends)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(pa.array(_in_table(wanted.value, batch.column("class").to_numpy())))
            parts = [np.frombuffer(x, np.int32) for x in rows.column("first_part").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([rows.column("class"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["class", "part"])

    held = classes.where("first_part IS NOT NULL").select("class", "first_part").mapInArrow(keep, "class long, part array<int>")
    held = saved(held.groupBy("class").agg(F.first("part").alias("part")))
    left = pairs.join(held.select(F.col("class").alias("a"), F.col("part").alias("sa")), "a")
    both = left.join(held.select(F.col("class").alias("b"), F.col("part").alias("sb")), "b")
    apart = F.size("sa") + F.size("sb") - 2 * F.size(F.array_intersect("sa", "sb"))
    kept = saved(both.where((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "na", "b", "nb"))
    discard(held)
    return kept


def verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int, fragments: int) -> DataFrame:
    """The ``pairs`` (a, na, b, nb) of classes whose Jaccard similarity reaches ``percent``.

    The overlap of each pair is counted in every fragment of the order by itself, and the counts are summed.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    held = saved(segments(docs, n, bit_table(docs.sparkSession, ends), fragments))
    left = pairs.join(held.select(F.col("class").alias("a"), "fragment", F.col("segment").alias("sa")), "a")
    both = left.join(held.select(F.col("class").alias("b"), "fragment", F.col("segment").alias("sb")), ["b", "fragment"])
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("shared"))
    linked = saved(partial.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared")).where(
        F.expr(f"100 * shared >= {percent} * (na + nb - shared)")).select("a", "b"))
    discard(held)
    return linked


def components(links: DataFrame) -> DataFrame:
    """``class, component`` of undirected ``links`` (a, b): the least class that each can be reached from.

    Alternates the large-star and small-star steps (Kiveris et al. 2014) until nothing changes; each step is a
    grouped minimum and a join, written to the shared folder, so a node with many links is no unbounded group.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(large.where("a <> b").distinct())
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        then = saved(small.where("a <> b").distinct())
        discard(edges, large)
        edges = then
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("class"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("class"), F.col("b").alias("component")).distinct())


def similar_classes(docs: DataFrame, classes: DataFrame, n: int = 5, percent: int = 75, fragments: int = 4, frequent: int = 8,
                    most_frequent: int = 1 << 20, hot: int = 50_000) -> DataFrame:
    """Components of the classes (equal shingle sets) of ``docs`` under links of at least ``percent`` similarity.

    ``classes`` is ``shingle_classes``' table. Classes that share a prefix shingle form its bucket. First every member
    is compared with the bucket's leader, the class in whose order the shingle stands first; then only members that
    are not yet in one component are compared with each other, where sizes and places allow the threshold at all.
    What the first round has joined needs no further comparing, so a large group of near copies costs a multiple of
    its size, while no link is lost. Sets whose sizes are too far apart don't meet: members are dealt to bands of size.
    """
    spark = docs.sparkSession
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    bits = max(4, (total // FRAGMENT).bit_length())
    keys, counts = frequent_shingles(docs, n, frequent, most_frequent, bits)
    order = spark.sparkContext.broadcast((keys, counts))

    rows = prefix_rows(docs, n, percent, order, bits, 0, hot)
    # of two sets that reach the threshold, the smaller has its first common shingle in an even shorter part
    early = F.expr(f"(at >> 32) * {100 + percent} <= (at & 4294967295) * {100 - percent} + {100 + percent}")
    bucket = Window.partitionBy("sig").orderBy("at", "class")
    whole = Window.partitionBy("sig")
    led = rows.withColumn("lead", F.first("class").over(bucket)).withColumn("lead_at", F.first("at").over(bucket)).withColumn(
        "_prev", F.lag("class").over(bucket)).withColumn("_next", F.lead("class").over(bucket)).withColumn("_early", F.max(early).over(whole)).where("_early")
    copy = F.col("_prev").isNotNull() & (F.col("_prev") == F.col("class"))
    alone = F.col("_prev").isNull() & F.col("_next").isNull()
    packed = led.where(~copy & ~alone).select("sig", "class", "at", "lead", "lead_at")
    if len(counts) and counts.max() > hot:
        # a bucket that very many documents share is no window's group: its leader is a grouped minimum, joined to its rows
        shared = saved(prefix_rows(docs, n, percent, order, bits, hot + 1, 2**31 - 1).distinct())
        head = shared.groupBy("sig").agg(F.min(F.struct("at", "class")).alias("head"), F.max(early).alias("_early"), F.count("*").alias("_n"))
        head = head.where("_early AND _n > 1").select("sig", F.col("head.class").alias("lead"), F.col("head.at").alias("lead_at"))
        packed = packed.unionByName(shared.join(head, "sig"))
    packed = saved(packed)
    size, place = "{0} & 4294967295", "{0} >> 32"
    members = packed.select("sig", "class", F.expr(size.format("at")).alias("n"), F.expr(place.format("at")).alias("place"), "lead",
                            F.expr(size.format("lead_at")).alias("lead_n"), F.expr(place.format("lead_at")).alias("lead_place"))

    def possible(na: str, pa_: str, nb: str, pb: str) -> str:
        most = f"least({na} - {pa_}, {nb} - {pb})"
        return f"100 * {most} >= {percent} * ({na} + {nb} - {most})"

    def pairs(df: DataFrame, a: str, na: str, b: str, nb: str) -> DataFrame:
        first = F.expr(f"{a} < {b}")
        return df.select(F.when(first, F.col(a)).otherwise(F.col(b)).alias("a"), F.when(first, F.col(na)).otherwise(F.col(nb)).alias("na"),
                         F.when(first, F.col(b)).otherwise(F.col(a)).alias("b"), F.when(first, F.col(nb)).otherwise(F.col(na)).alias("nb")).distinct()

    led = members.where("class <> lead").where(possible("n", "place", "lead_n", "lead_place"))
    tried = saved(pairs(led, "class", "n", "lead", "lead_n"))
    links = verified(docs, plausible(classes, tried, percent), n, percent, fragments)
    joined = components(links)

    labelled = members.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class")).select(
        "sig", "class", "n", "place", "component")
    mixed_buckets = labelled.groupBy("sig").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where(
        "_lo <> _hi").select("sig")
    open_ = saved(labelled.join(mixed_buckets, "sig"))
    # sizes that reach the threshold differ by a factor of 100 / percent at most, so they are in one band or in adjacent ones
    band = F.floor(F.log(F.col("n") + F.lit(0.0)) / np.log(100 / percent) + 1e-9).cast("int")
    x = open_.withColumn("band", band).alias("x")
    y = open_.withColumn("band", F.explode(F.sequence(band - 1, band + 1))).alias("y")
    rest = x.join(y, F.expr("x.sig = y.sig AND x.band = y.band AND x.component <> y.component AND x.class < y.class AND "
                            + possible("x.n", "x.place", "y.n", "y.place"))).select(
        F.col("x.class").alias("a"), F.col("x.n").alias("na"), F.col("y.class").alias("b"), F.col("y.n").alias("nb")).distinct()
    rest = saved(rest.join(tried, ["a", "b"], "left_anti").select("a", "na", "b", "nb"))
    discard(packed, open_, tried)
    left = plausible(classes, rest, percent)
    discard(rest)
    if left.isEmpty():
        return joined
    more = verified(docs, left, n, percent, fragments)
    if more.isEmpty():
        return joined
    return components(links.unionByName(more))


def _grouped(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The class of each document, and the component and least doc_id of each class."""
    small_batches(docs.sparkSession)
    classes = saved(shingle_classes(docs, n))
    named = classes.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least")).join(
        similar_classes(docs, classes, n, percent), "class", "left").withColumn("component", F.coalesce("component", "class"))
    return classes, named


def near_duplicate_components(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    Documents are linked when the Jaccard similarity of their sets of n-word shingles (words lower-cased A-Z; a
    shorter text is one shingle) is at least ``percent`` per cent; ``component_id`` is the least doc_id that links
    lead to. Texts without words, and null texts, have no shingles and stand alone. Rows with a null id keep it; they
    take part in links but name no component unless all of it is null. Repeated rows share a component. An empty
    table gives no rows; other columns are dropped.
    """
    classes, named = _grouped(docs.select("doc_id", "text"), n, percent)
    best = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = named.join(best, "component").select("class", "component_id")
    return classes.where("class IS NOT NULL").join(names, "class").select("doc_id", "n_shingles", "component_id").unionByName(
        classes.where("class IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, with all columns, less all but one of each near-duplicate component.

    The row with the least doc_id stays (a null id only where there is no other). Texts without words all stay.
    Columns may have any names; an empty table gives no rows.
    """
    classes, named = _grouped(docs.select("doc_id", "text"), n, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")).alias("kept")
    kept = classes.where("class IS NOT NULL").join(named.select("class", "component"), "class").groupBy("component").agg(
        first).select(F.col("kept.doc_id").alias("id"), F.col("kept.class").alias("of"))
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]  # the table's own names may be any
    text, doc_id = inner[names.index("text")], inner[names.index("doc_id")]
    plain = docs.toDF(*inner)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, text):
                hashes, at = shingle_sets(data, offsets, n)
                own = pa.array(_classes(hashes, at), mask=np.diff(at) == 0)
                yield pa.RecordBatch.from_arrays([*rows.columns, own], [*inner, "class"])

    rows = plain.mapInArrow(classed, T.StructType([*plain.schema.fields, T.StructField("class", T.LongType())]))
    same = F.col("class").eqNullSafe(F.col("of")) & F.col(doc_id).eqNullSafe(F.col("id"))
    copies = Window.partitionBy("class", doc_id).orderBy(text)
    one = rows.where("class IS NOT NULL").join(kept, same).withColumn("copy", F.row_number().over(copies)).where("copy = 1")
    return one.select(*inner).unionByName(rows.where("class IS NULL").select(*inner)).toDF(*names)
