"""Language-model scores of texts: prediction by partial matching over bytes, and a word-unigram base.

The model is a trie of byte contexts, kept as rows: a gram is the last ``order`` bytes and the next one, packed in a
long. Counts of the longest grams are numbers of occurrences in the training texts; a shorter gram counts once for each
byte before it, as if it were learned only where the longer context did not know the byte. With N and D a context's
counts and distinct bytes, a byte that it counts c times has the chance (c - 1/2) / N, and one that it did not see costs
an escape of D / (2 N); bytes that longer contexts know are excluded from N and D of shorter ones. Bytes that no context
knows share what is left evenly.

Texts are cut into chunks. A chunk sends its distinct grams and words in packed lists, one for each bucket, and gets lists
of their counts back. Equal words share a bucket, and so do grams whose contexts end alike (but for the ``APART`` first
bytes): a bucket does the two longest contexts' work by itself. Sent row by row are only the rest of the trie and the
grams that no training text has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, saved, small_batches
from .textbytes import slices
from .wordcache import mixed, span_hashes

ORDER, APART = 6, 2
CHUNK_BYTES, BUCKET_BYTES = 24 << 20, 16 << 20
END = 0x0A  # white space, so no word holds it
BYTES = 256
_PIECE, _ENTRIES = 2 << 20, 2_000_000

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in lower case with their words joined by one blank and ``END`` behind: bytes, and where each text begins."""
    n = len(offsets) - 1
    # every text with one more byte of white space behind it: then a gap follows every word
    buffer = np.full(len(data) + n, END, np.uint8)
    buffer[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
    last = offsets[1:] + np.arange(n)
    gap = _GAP[buffer]
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    starts = np.concatenate([[0], last[:-1] + 1]) if n else last
    sizes = np.add.reduceat(keep, starts, dtype=np.int64) if n else last
    keep[last[sizes == 0]] = True
    out = np.where(gap, np.uint8(0x20), _LOWER[buffer])[keep]
    ends = np.cumsum(np.maximum(sizes, 1))
    out[ends - 1] = END
    return out, np.concatenate([[0], ends]).astype(np.int64)


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The gram that ends at each byte; before a text there is nothing but ``END``."""
    n = order + 1
    padded = np.concatenate([np.full(order, END, np.uint8), data, np.zeros(8, np.uint8)])
    out = np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(np.uint64) >> np.uint64(8 * (8 - n))
    # a text's first bytes: what the bytes of the text before left is overwritten
    ends = int.from_bytes(bytes([END] * n), "big")
    for k in range(order):
        at = offsets[:-1][np.diff(offsets) > k] + k
        own = np.uint64((1 << 8 * (k + 1)) - 1)
        out[at] = (out[at] & own) | (np.uint64(ends) & ~own & np.uint64((1 << 8 * n) - 1))
    return out.view(np.int64)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of normalised texts, and where they begin and end."""
    stops = np.flatnonzero((data == 0x20) | (data == END))
    starts = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
    real = stops > starts
    starts, stops = starts[real], stops[real]
    return span_hashes(np.concatenate([data, np.zeros(8, np.uint8)]), starts, stops).view(np.int64), starts, stops


def _first(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each code is first."""
    out = np.zeros(n, np.int64)
    out[codes[::-1]] = np.arange(len(codes))[::-1]
    return out


def _summed(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of sorted lists, and their counts added."""
    if len(pairs) == 1:
        return pairs[0]
    keys = np.concatenate([k for k, _ in pairs])
    order = np.argsort(keys, kind="stable").astype(np.int32)  # merges the lists; they have less than 2^31 keys together
    keys, counts = keys[order], np.concatenate([c for _, c in pairs])[order]
    del order
    return _grouped(keys, counts)


def _grouped(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys[first], np.add.reduceat(counts, np.flatnonzero(first))


class Chunk:
    """What a chunk's texts hold: distinct grams, and distinct tokens with their text, with their counts in training texts."""

    def __init__(self, order: int):
        self.order, self.size = order, 0
        self.grams: list[tuple] = []
        self.entries = 0
        self.words: list[tuple] = []

    def add(self, data: np.ndarray, offsets: np.ndarray, held: np.ndarray) -> None:
        self.size += len(data)
        for a, b in _pieces(offsets, _PIECE):
            part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            sizes, own = np.diff(bounds), held[a:b]
            code, times = np.unique(grams(part, bounds, self.order) << 1 | np.repeat(own, sizes), return_counts=True)
            self.grams.append((code, times.astype(np.int32)))
            self.entries += len(code)
            if self.entries > _ENTRIES:
                self.grams = [_summed(self.grams)]
                self.entries = len(self.grams[0][0]) // 2  # what is merged already counts half
            hashes, starts, stops = words(part)
            codes, some = pd.factorize(hashes)
            where = _first(codes, len(some))
            n = np.bincount(codes, weights=~np.repeat(own, sizes)[starts], minlength=len(some)).astype(np.int64)
            self.words.append((some, n, _spans(part, starts[where], (stops - starts)[where])))

    def rows(self, buckets: int) -> Iterator[dict[str, list]]:
        """A row for each bucket: packed grams or words, and their counts."""
        code, counts = _summed(self.grams)
        self.grams = []
        counts[code & 1 == 1] = 0
        keys, n = _grouped(code >> 1, counts)
        del code, counts
        order, edges = _by_bucket(bucket_of(keys >> 8 & ((1 << 8 * (self.order - APART)) - 1), buckets), buckets)
        full = np.flatnonzero(np.diff(edges))
        keys, n = keys[order], n[order]
        del order
        yield {"bucket": full, "word": False, "keys": [packed(np.diff(keys[edges[b] : edges[b + 1]], prepend=0)) for b in full],
               "n": [packed(n[edges[b] : edges[b + 1]]) for b in full]}
        del keys, n
        codes, some = pd.factorize(np.concatenate([w[0] for w in self.words]))
        n = np.bincount(codes, weights=np.concatenate([w[1] for w in self.words]), minlength=len(some)).astype(np.int64)
        order, edges = _by_bucket(bucket_of(some, buckets), buckets)
        full = np.flatnonzero(np.diff(edges))
        texts = pa.chunked_array([w[2] for w in self.words]).combine_chunks().take(pa.array(_first(codes, len(some))[order]))
        some, n = some[order], n[order]
        for b in full:
            own = slice(edges[b], edges[b + 1])
            # words hold no blank, so they are joined by blanks
            joined = b" ".join(texts[own].to_pylist())
            yield {"bucket": [b], "word": True, "keys": [packed(some[own])], "n": [packed(n[own])], "texts": [pa.compress(joined, "zstd", asbytes=True)], "size": [len(joined)]}


def _by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket, and where each bucket begins in it."""
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])


def _spans(data: np.ndarray, starts: np.ndarray, widths: np.ndarray) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
    raw = data[np.repeat(starts - bounds[:-1], widths) + np.arange(bounds[-1])]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((mixed(keys.view(np.uint64)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def packed(numbers: np.ndarray) -> bytes:
    """A list of longs, compressed."""
    return len(numbers).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(numbers, np.int64).tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], n * 8, "zstd", asbytes=True), np.int64)


def _pieces(offsets: np.ndarray, size: int, texts: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes, one text at least and ``texts`` at most."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(at + texts, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1))
        yield at, to
        at = to


_GATHERED = {"chunk": pa.int64(), "block": pa.binary(), "bucket": pa.int32(), "word": pa.bool_(), "keys": pa.binary(), "n": pa.binary(), "texts": pa.binary(), "size": pa.int64()}
_GATHERED_DDL = "chunk long, block binary, bucket int, word boolean, keys binary, n binary, texts binary, size long"


def _batch(types: dict[str, pa.DataType], count: int, columns: dict) -> pa.RecordBatch:
    """A batch of these columns: lists, single values, or nothing (nulls)."""
    def one(c: str, t: pa.DataType) -> pa.Array:
        x = columns.get(c)
        return pa.nulls(count, t) if x is None else x if isinstance(x, pa.Array) else pa.array(x if isinstance(x, list | np.ndarray) else [x] * count, t)

    return pa.RecordBatch.from_arrays([one(c, t) for c, t in types.items()], list(types))


def _packed(doc_id: pa.Array, held: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> bytes:
    texts = pa.Array.from_buffers(pa.large_binary(), len(held), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    batch = pa.RecordBatch.from_arrays([doc_id, pa.array(held), texts], ["doc_id", "held_out", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def gathered(docs: DataFrame, held_out, order: int, chunk_bytes: int, total: int, buckets: int) -> DataFrame:
    """The texts in compressed blocks, and the grams and words of each chunk, by bucket, with their counts in training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        chunk = Chunk(order)

        def lists() -> Iterator[pa.RecordBatch]:
            for columns in chunk.rows(buckets):
                yield _batch(_GATHERED, len(columns["bucket"]), columns | {"chunk": number})

        for batch in batches:
            for rows, data, offsets in slices(batch, "text", 2 << 20):
                held = rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                data, offsets = normalised(data, offsets)
                chunk.add(data, offsets, held)
                give_back()
                yield _batch(_GATHERED, 1, {"chunk": number, "block": [_packed(rows.column("doc_id"), held, data, offsets)]})
                if chunk.size >= chunk_bytes:
                    yield from lists()
                    number, chunk = number + 1, Chunk(order)
                    give_back()
        if chunk.grams:
            yield from lists()
        del chunk
        give_back()

    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    rows = rows.coalesce(max(spark.sparkContext.defaultParallelism, -(-total // chunk_bytes)))
    return rows.mapInArrow(run, _GATHERED_DDL)


_COUNTED = {"kind": pa.string(), "chunk": pa.int64(), "bucket": pa.int32(), "word": pa.bool_(), "c": pa.binary(), "total": pa.binary(), "gram": pa.int64(), "count": pa.int64(),
            "logp": pa.float64(), "cost": pa.float64(), "n": pa.int64(), "d": pa.int64()}
_COUNTED_DDL = "kind string, chunk long, bucket int, word boolean, c binary, total binary, gram long, count long, logp double, cost double, n long, d long"


class Level:
    """Grams of one length, ascending, with their counts, and their contexts' counts and distinct bytes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = grams, counts
        context = grams >> 8
        first = np.ones(len(grams), bool)
        first[1:] = context[1:] != context[:-1]
        self.first = np.flatnonzero(first)
        self.contexts = context[self.first]
        self.total = np.add.reduceat(counts, self.first) if len(grams) else counts
        self.distinct = np.diff(np.append(self.first, len(grams)))

    def shorter(self, order: int) -> tuple["Level", np.ndarray]:
        """The grams without their first byte, which count once for each; and each context's count of what it knows there."""
        short, back, counts = np.unique(self.grams & ((1 << 8 * order) - 1), return_inverse=True, return_counts=True)
        known = np.add.reduceat(counts[back], self.first) if len(self.first) else counts
        return Level(short, counts), known


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def escapes(wanted: np.ndarray, level: Level, order: int) -> tuple[dict[str, np.ndarray], Level]:
    """``logp`` of grams that ``level`` (the longest contexts) lacks, by its escapes and the next level's counts; where that
    lacks them too, not a number, and ``cost``, ``n``, ``d``: the escapes' log10, and what the next context has to exclude.
    """
    out = {"logp": np.full(len(wanted), np.nan), "cost": np.zeros(len(wanted)), "n": np.zeros(len(wanted), np.int64), "d": np.zeros(len(wanted), np.int64)}
    for step in range(APART):
        width = order + 1 - step
        own = wanted & ((1 << 8 * width) - 1)
        below, known = level.shorter(width - 1)
        at, seen = _at(level.contexts, own >> 8)
        place, hit = _at(level.grams, own)
        open_ = np.isnan(out["logp"])
        if len(level.contexts):
            n, d = level.total[at] - out["n"], level.distinct[at] - out["d"]
            with np.errstate(divide="ignore", invalid="ignore"):
                out["logp"] = np.where(open_ & hit, out["cost"] + np.log10((level.counts[place] - 0.5) / n), out["logp"])
                out["cost"] = np.where(open_ & ~hit & seen & (d > 0), out["cost"] + np.log10(d / (2 * n)), out["cost"])
            out["n"], out["d"] = np.where(seen, known[at], 0), np.where(seen, level.distinct[at], 0)
        level = below
    return out, level


def count_bucket(rows: pa.Table, order: int) -> pa.Table:
    """Counts of a bucket's grams and words over all chunks.

    ``list``: for each chunk's list the counts in its order, and for grams their contexts' counts too (``total``).
    ``trie``: the grams of contexts of ``order`` - ``APART`` bytes. ``new``: a chunk's gram that no training text has, with
    its ``logp`` where the bucket knows it; ``open``: those where it doesn't, once each, with what they cost so far.
    ``words``: the number of distinct words in training texts.
    """
    out = []
    is_word = rows["word"].to_numpy(zero_copy_only=False).astype(bool)
    chunks, bucket = rows["chunk"].to_numpy(), rows["bucket"][0].as_py()
    for word in (False, True):
        own = np.flatnonzero(is_word == word)
        if not len(own):
            continue
        part = rows.take(pa.array(own))
        n = [unpacked(x) for x in part["n"].to_pylist()]
        sizes = np.array([len(x) for x in n])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        n = np.concatenate(n)
        if word:
            texts = [pa.array(pa.decompress(t, m, "zstd", asbytes=True).split(b" "), pa.large_binary()) for t, m in zip(part["texts"].to_pylist(), part["size"].to_pylist())]
            back = pa.concat_arrays(texts).dictionary_encode().indices.to_numpy().astype(np.int64)
        else:
            keys, back = np.unique(np.concatenate([np.cumsum(unpacked(x)) for x in part["keys"].to_pylist()]), return_inverse=True)
        counts = np.bincount(back, weights=n).astype(np.int64)
        lists = {"kind": "list", "chunk": chunks[own], "bucket": bucket, "word": word, "c": [packed(counts[back[a:b]]) for a, b in zip(edges, edges[1:])]}
        if word:
            out.append(_batch(_COUNTED, 1, {"kind": "words", "count": int((counts > 0).sum())}))
        else:
            known = counts > 0
            level = Level(keys[known], counts[known])
            at, seen = _at(level.contexts, keys >> 8)
            total = np.where(seen, level.total[at], 0) if len(level.total) else np.zeros(len(keys), np.int64)
            lists["total"] = [packed(total[back[a:b]]) for a, b in zip(edges, edges[1:])]
            found, rest = escapes(keys[~known], level, order)
            out.append(_batch(_COUNTED, len(rest.grams), {"kind": "trie", "gram": rest.grams, "count": rest.counts}))
            still = np.isnan(found["logp"])
            out.append(_batch(_COUNTED, int(still.sum()), {"kind": "open", "gram": keys[~known][still], **{c: found[c][still] for c in ("cost", "n", "d")}}))
            lacking = ~known[back]
            number = (np.cumsum(~known) - 1)[back][lacking]
            out.append(_batch(_COUNTED, int(lacking.sum()), {"kind": "new", "chunk": np.repeat(chunks[own], sizes)[lacking], "gram": keys[back][lacking],
                                                            "logp": pa.array(found["logp"][number], from_pandas=True)}))
        out.append(_batch(_COUNTED, len(own), lists))
    return pa.Table.from_batches(out)


def _suffix(level: int):
    return F.col("gram").bitwiseAND((1 << 8 * (level + 1)) - 1)


def _context(gram="gram"):
    return F.shiftrightunsigned(gram, 8)


def unseen(wanted: DataFrame, trie: list[DataFrame]) -> DataFrame:
    """``gram, logp`` of grams (distinct) that no training text has, by escapes to shorter contexts.

    ``wanted`` has ``gram, cost, n, d`` as ``escapes`` leaves them, ``trie[k]`` has ``gram, c`` of contexts of k bytes.
    """
    rows = wanted.select("gram", "cost", F.lit(None).cast("double").alias("logp"), F.col("n").alias("_n"), F.col("d").alias("_d"))
    for level in range(len(trie) - 1, -1, -1):
        known = trie[level].select(F.col("gram").alias("_g"), "c")
        below = known.withColumn("_low", F.lit(0).cast("long"))
        if level:
            low = trie[level - 1].select(F.col("gram").alias("_s"), F.col("c").alias("_low"))
            below = known.join(low, F.col("_g").bitwiseAND((1 << 8 * level) - 1) == F.col("_s"))
        contexts = below.groupBy(_context("_g").alias("_x")).agg(F.sum("c").alias("N"), F.count("*").alias("D"), F.sum("_low").alias("A"))
        own = F.col("_own")
        rows = rows.withColumn("_own", _suffix(level)).join(known, own == F.col("_g"), "left").join(contexts, _context("_own") == F.col("_x"), "left")
        n, d = F.col("N") - F.col("_n"), F.col("D") - F.col("_d")
        hit = F.col("logp").isNull() & F.col("c").isNotNull()
        cost = F.when(F.col("D").isNotNull() & (d > 0), F.log10(d / (2 * n))).otherwise(0.0)
        seen = F.col("D").isNotNull()
        # what this context knows is excluded from the next one
        rows = rows.select(
            "gram", F.when(F.col("logp").isNull() & ~F.col("c").isNotNull(), F.col("cost") + cost).otherwise(F.col("cost")).alias("cost"),
            F.when(hit, F.col("cost") + F.log10((F.col("c") - 0.5) / n)).otherwise(F.col("logp")).alias("logp"),
            F.when(seen, F.col("A")).otherwise(F.lit(0)).alias("_n"), F.when(seen, F.col("D")).otherwise(F.lit(0)).alias("_d"))
    return rows.select("gram", F.coalesce("logp", F.col("cost") - F.log10(BYTES - F.col("_d"))).alias("logp"))


def language_scores(docs: DataFrame, held_out, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each text.

    Texts of which ``held_out`` (a boolean column) is not true are learned; all are scored. A-Z is lower-cased; tokens
    are words between white space and one end. The base gives a token log10((c + 0.1) / (N + 0.1 (V + 1))); ``score`` is
    the log10 probability that the byte model gives the words, joined by blanks, and the end.

    Null texts are empty: they have the end alone. Repeated rows are learned and scored as often as they occur. An
    empty table gives no rows; without training texts every byte has one of 256 chances. Other columns are not read.
    Words meet by their bytes; within a chunk they are told apart by 64-bit hashes.
    """
    if not APART < order <= 6:
        raise ValueError("order must be from 3 to 6: a gram is packed in 56 bits, and buckets do the two longest contexts")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(32, -(-total // BUCKET_BYTES))
    rows = saved(gathered(docs, held_out, order, chunk_bytes, total, buckets))
    lists = rows.where("bucket IS NOT NULL")
    bucketed = lists.select("chunk", "bucket", "word", F.when(~F.col("word"), F.col("keys")).alias("keys"), "n", "texts", "size").groupBy("bucket")
    counted = saved(bucketed.applyInArrow(lambda t: count_bucket(t, order), _COUNTED_DDL))
    trie = [counted.where("kind = 'trie'").select("gram", F.col("count").alias("c"))]
    for level in range(order - APART - 1, -1, -1):
        trie.insert(0, saved(trie[0].groupBy(_suffix(level).alias("gram")).agg(F.count("*").alias("c"))))
    found = saved(unseen(counted.where("kind = 'open'").select("gram", "cost", "n", "d"), trie))
    new = counted.where("kind = 'new'").select("chunk", "gram", "logp")
    new = new.where("logp IS NOT NULL").unionByName(new.where("logp IS NULL").drop("logp").join(found, "gram").select("chunk", "gram", "logp"))
    none = lambda kind: F.lit(None).cast(kind)
    values = lists.select("chunk", "bucket", "word", "keys", none("binary").alias("c"), none("binary").alias("total"), none("long").alias("gram"), none("double").alias("logp"))
    values = values.unionByName(counted.where("kind = 'list'").select("chunk", "bucket", "word", none("binary").alias("keys"), "c", "total", none("long").alias("gram"), none("double").alias("logp")))
    values = values.unionByName(new.select(
        "chunk", none("int").alias("bucket"), none("boolean").alias("word"), none("binary").alias("keys"), none("binary").alias("c"), none("binary").alias("total"), "gram", "logp"))

    def score(blocks: pa.Table, values: pa.Table) -> pa.Table:
        packs = {}
        for r in values.filter(values["bucket"].is_valid()).to_pylist():
            packs.setdefault((r["word"], r["bucket"]), {}).update({c: r[c] for c in ("keys", "c", "total") if r[c] is not None})
        rest = values.filter(values["gram"].is_valid())
        keys, logp = [rest["gram"].to_numpy()], [rest["logp"].to_numpy()]
        words_, counts = [], []
        for (word, _), p in packs.items():
            c = unpacked(p["c"])
            if word:
                words_.append(unpacked(p["keys"]))
                counts.append(c)
            else:
                seen = c > 0
                keys.append(np.cumsum(unpacked(p["keys"]))[seen])
                logp.append(np.log10((c[seen] - 0.5) / unpacked(p["total"])[seen]))
        packs.clear()
        keys, logp = np.concatenate(keys), np.concatenate(logp)
        place = np.argsort(keys, kind="stable")
        keys, logp = keys[place], logp[place]
        table, counts = pd.Index(np.concatenate(words_)) if words_ else pd.Index([], dtype="int64"), np.concatenate([*counts, np.zeros(0)])
        del place, words_
        out = []
        for raw in blocks["block"]:
            batch = pa.ipc.open_stream(raw.as_buffer()).read_next_batch()
            texts = batch.column("text")
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2], np.uint8)
            sums = np.zeros((4, len(texts)))
            for a, b in _pieces(bounds, 1 << 20, 128):
                part, own = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                text = np.repeat(np.arange(b - a), np.diff(own))
                # a gram leaves room for the text's number: both are sorted at once, and distinct ones looked up in order
                both, times = np.unique(grams(part, own, order) << 7 | text, return_counts=True)
                sums[0, a:b] = np.bincount(both & 127, weights=times * logp[np.searchsorted(keys, both >> 7)], minlength=b - a)
                hashes, starts, _ = words(part)
                codes, some = pd.factorize(hashes)
                c = counts[table.get_indexer(some)][codes]
                at = text[starts]
                sums[1, a:b] = np.bincount(at, minlength=b - a)
                sums[2, a:b] = np.bincount(at, weights=c > 0, minlength=b - a)
                sums[3, a:b] = np.bincount(at, weights=np.log10(c + 0.1), minlength=b - a)
            out.append(pa.table({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": sums[1].astype(np.int64),
                                 "n_known": sums[2].astype(np.int64), "base": sums[3], "score": sums[0]}))
        del keys, logp, table, counts
        give_back()
        return pa.concat_tables(out)

    blocks = rows.where("block IS NOT NULL").select(F.col("chunk").alias("own"), "block")
    scored = saved(blocks.groupBy("own").cogroup(values.groupBy("chunk")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"))
    distinct = counted.where("kind = 'words'").agg(F.sum("count")).first()[0] or 0
    train = scored.where("NOT held_out").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("ends")).first()
    discard(rows, counted, found, *trie[:-1])
    # the end is a token as well, as frequent as there are texts
    total, ends = (train["n"] or 0) + train["ends"], train["ends"]
    norm = math.log10(total + 0.1 * (distinct + (ends > 0) + 1))
    return scored.select("doc_id", "held_out", (F.col("n_tokens") + 1).alias("n_tokens"), (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
                         (F.col("base") + math.log10(ends + 0.1) - (F.col("n_tokens") + 1) * norm).alias("base_score"), "score")


def held_out_by_crc(doc_id="doc_id", of: int = 10):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(of)) == 0
