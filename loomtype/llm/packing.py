"""Packing of tokenized documents into fixed-length sequences by large-item matching and best fit."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lanes, saved, small_batches, spread
from .textbytes import runs
from .wordcache import WordIds

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2,
                     keep_ids: bool = False) -> DataFrame:
    """Cut each document's ids (its text's, then ``end_id``) into pieces of ``capacity``; the first may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_path)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for rows, texts in runs(batch, "text"):
                doc, piece, start, length, crc, ids = [], [], [], [], [], []
                for doc_id, coded in zip(rows.column("doc_id").to_pylist(), words.encode(texts)):
                    coded = coded.astype("<u4").tobytes() + end
                    n = len(coded) // 4
                    at, i = 0, 0
                    while at < n:
                        to = at + (n - at - 1) % capacity + 1
                        part = coded[4 * at : 4 * to]
                        doc.append(doc_id)
                        piece.append(i)
                        start.append(at)
                        length.append(to - at)
                        crc.append(zlib.crc32(part))
                        ids.append(part if keep_ids else None)
                        at, i = to, i + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def bin_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Lay out bins for ``counts`` pieces of each length; at most ``capacity`` lengths, whatever the corpus.

    Lengths above a third of the capacity are matched first: the longest with the longest that fits beside it, so
    that at most two share a bin. The others, longest first, go where they fit best. Equal bins are handled as one
    class (gap, first bin, number of bins), so the work depends on the number of lengths, not of pieces.

    Returns rows (length, from, to, first bin, offset, per bin): pieces ranked from..to-1 of that length go, ``per
    bin`` side by side, into consecutive bins.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    used: dict[int, int] = {}
    gaps: dict[int, list[list[int]]] = {}
    order: list[int] = []
    bins = 0

    def put(length: int, n_bins: int, per_bin: int, first: int, offset: int) -> None:
        rank = used.get(length, 0)
        rows.append((length, rank, rank + n_bins * per_bin, first, offset, per_bin))
        used[length] = rank + n_bins * per_bin

    def opened(gap: int, first: int, n_bins: int) -> None:
        if gap and n_bins:
            if not gaps.get(gap):
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append([first, n_bins])

    left = {n: c for n, c in counts.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect_left(large, capacity - n + 1) - 1
        if at >= 0 and (large[at] != n or left[n] > 1):
            m = large[at]
            pairs = left[n] // 2 if m == n else min(left[n], left[m])
            put(n, pairs, 2 if m == n else 1, bins, 0)
            if m != n:
                put(m, pairs, 1, bins, n)
            left[n] -= pairs
            left[m] -= pairs
            opened(capacity - n - m, bins, pairs)
        else:
            pairs, m = left[n], n
            put(n, pairs, 1, bins, 0)
            left[n] = 0
            opened(capacity - n, bins, pairs)
        bins += pairs
        large = [x for x in large if left[x]] if not left[n] or not left[m] else large

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            at = bisect_left(order, n)
            if at < len(order):
                gap = order[at]
                first, free = gaps[gap][-1]
            else:
                gap, first, free = capacity, bins, max(1, todo // (capacity // n))
                bins += free
            per_bin = min(gap // n, todo)
            n_bins = min(free, todo // per_bin)
            put(n, n_bins, per_bin, first, capacity - gap)
            todo -= n_bins * per_bin
            if at < len(order):
                if n_bins == free:
                    gaps[gap].pop()
                    if not gaps[gap]:
                        order.remove(gap)
                else:
                    gaps[gap][-1] = [first + n_bins, free - n_bins]
            opened(gap - per_bin * n, first, n_bins)
    return rows


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    Pieces are tokenized once and saved. Only the number of pieces of each length (``capacity`` rows at most) goes
    to the driver, where ``bin_plan`` lays out the bins; a piece finds its place from its rank among the pieces of
    its length, which is a prefix sum over hash lanes, so a length that a third of all pieces share is no hot spot.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` on demand). A null text is
    empty and gives one piece, the end id; null ids are kept; repeated rows are packed each; an empty table gives no
    rows; other columns are dropped.
    """
    pieces = saved(tokenized_pieces(docs, tokenizer_path, capacity, end_id, keep_ids))
    per_length = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = docs.sparkSession.createDataFrame(
        bin_plan(per_length, capacity), "length long, _from long, _to long, _first long, _offset long, _per long")

    n = lanes(sum(per_length.values()))
    laned = pieces.withColumn("_lane", spread("doc_id", "piece", "ids_crc32", lanes=n))
    before = Window.partitionBy("length").orderBy("_lane")
    starts = laned.groupBy("length", "_lane").agg(F.count("*").alias("_n")).select(
        "length", "_lane", (F.sum("_n").over(before) - F.col("_n")).alias("_start"))
    lane = Window.partitionBy("length", "_lane").orderBy("doc_id", "piece", "ids_crc32")
    ranked = laned.join(starts, ["length", "_lane"]).withColumn("_rank", F.col("_start") + F.row_number().over(lane) - 1)
    place = (ranked["length"] == plan["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(F.broadcast(plan), place).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        F.expr("_first + (_rank - _from) div _per").alias("sequence_id"),
        (F.col("_offset") + F.expr("(_rank - _from) % _per") * ranked["length"]).alias("offset"),
        *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences' ids in order (little-endian unsigned 32-bit), from ``pack(..., keep_ids=True)``."""
    return packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids"))).alias("pieces")).select(
        "sequence_id", F.expr("aggregate(pieces, 0L, (n, p) -> n + p.length)").alias("n_tokens"),
        F.expr("transform(pieces, p -> struct(p.offset, p.length, p.doc_id))").alias("pieces"),
        F.expr("aggregate(pieces, cast('' AS binary), (b, p) -> concat(b, p.ids))").alias("ids"))
