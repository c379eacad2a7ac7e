"""Phrases that stand out by their collocation, mined by partitions (SON).

First pass: each shard of the texts is mined completely, length by length, at the support lowered to the shard's share
of all bytes. A phrase that is frequent over all texts is so in one shard at least, and so are all its parts. Second
pass: the union of what the shards found is counted in every shard, and the counts are added.

Beyond ``MOST_SHARDS`` shards the lowered support says little. Then the first pass is made twice, with a support of one:
words and pairs are mined first, and longer phrases only where all pairs in them are in the union so far.

The union reaches the tasks as a bit field of a fixed size (``BITS``): a phrase without its bit, or with a part without
one, is not in the union. One that has its bit by chance has it in every shard, so it is counted exactly as well, and
the support decides. Phrases are keyed by 64-bit hashes of their language and words. Keys and counts of a shard travel
packed, by buckets of the keys' first bits; a phrase's text travels from the shards that have it most often only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved, small_batches
from .textbytes import slices
from .wordcache import mixed, span_hashes

BITS = 27
#: Bits of a key by which a phrase's highest count in a shard is known.
MOST_BITS = 24
#: Shards up to which the lowered support is used.
MOST_SHARDS = 32
#: Shards are as large as this, but there are ``LEAST_SHARDS`` at least, so that a cluster has work.
SHARD_BYTES, LEAST_SHARDS = 64 << 20, 16
_SLOTS, _BLOCK = 1 << 22, 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)

_KIND = np.zeros(256, np.uint8)  # 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Shard:
    """The words of some texts as numbers of distinct (language, word), and how far each piece goes on.

    A word takes five bytes, whatever its length: a shard of 64 MB of text is mined in a few hundred MB.
    """

    def __init__(self) -> None:
        self.size = 0
        self.parts: list[tuple] = []
        self.langs: dict[str, int] = {}

    def add(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]) -> None:
        """Take texts: text i is ``data[offsets[i]:offsets[i + 1]]``."""
        self.size += len(data)
        codes = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int32)
        data = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
        kind = _KIND[data[:-8]]
        word = kind == 0
        first = np.zeros(len(word) + 1, bool)
        first[offsets] = True  # a text's end ends a word
        begins = word.copy()
        begins[1:] &= ~word[:-1] | first[1:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | first[1:-1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        n = len(starts)
        if not n:
            return
        text = np.searchsorted(offsets, starts, "right") - 1
        breaks = np.cumsum(kind == 2, dtype=np.int32)[starts]
        new = np.ones(n, bool)
        new[1:] = (text[1:] != text[:-1]) | (breaks[1:] != breaks[:-1])
        at = np.append(np.flatnonzero(new), n)
        left = np.minimum(np.repeat(at[1:], np.diff(at)) - np.arange(n), 255).astype(np.uint8)
        lang = codes[text]
        keys = mixed((self.seeds()[lang] ^ span_hashes(data, starts, ends)) * _STEP + np.uint64(1))
        some, where, back = np.unique(keys, return_index=True, return_inverse=True)
        self.parts.append((some, lang[where], _spans(data, starts[where], (ends - starts)[where]), back.astype(np.int32), left))

    def seeds(self) -> np.ndarray:
        """A number for each language."""
        names = [x.encode() for x in self.langs]
        ends = np.cumsum([len(x) for x in names], dtype=np.int64)
        raw = np.frombuffer(b"".join(names) + bytes(8), np.uint8)
        return mixed(span_hashes(raw, ends - np.array([len(x) for x in names], np.int64), ends) + np.uint64(1))

    def close(self) -> None:
        """Number the distinct words of all parts."""
        every = np.concatenate([p[0] for p in self.parts])
        self.keys, where, back = np.unique(every, return_index=True, return_inverse=True)
        self.lang = np.concatenate([p[1] for p in self.parts])[where]
        self.words = pa.chunked_array([p[2] for p in self.parts]).combine_chunks().take(pa.array(where))
        starts = np.cumsum([0, *(len(p[0]) for p in self.parts)])
        self.left = np.concatenate([p[4] for p in self.parts])
        self.ids = np.concatenate([back[a : a + len(p[0])].astype(np.int32)[p[3]] for a, p in zip(starts, self.parts)])
        self.parts.clear()

    def blocks(self, at: np.ndarray, keys: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places ``at`` whose phrases of ``size - 1`` words have these keys, and the keys with the next word, in blocks."""
        for i in range(0, len(at), _BLOCK):
            some = at[i : i + _BLOCK]
            yield some, mixed((mixed(keys[i : i + _BLOCK]) ^ self.keys[self.ids[some + (size - 1)]]) * _STEP + np.uint64(size))

    def lengths(self, longest: int, one, more, shortest: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length from ``shortest`` on the phrases that are kept: places, keys and counts of distinct ones.

        ``one`` marks distinct words by their keys and counts; ``more(size, blocks)`` gives those of the phrases that are
        kept, with a place for each of their occurrences. Only phrases are asked for of which all parts were kept.
        """
        counts = np.bincount(self.ids, minlength=len(self.keys))
        kept = one(self.keys, counts)
        mark = np.append(kept[self.ids], False)
        where = np.zeros(len(self.keys), np.int64)
        where[self.ids[::-1]] = np.arange(len(self.ids))[::-1]
        if shortest == 1:
            yield 1, where[kept], self.keys[kept], counts[kept]
        at = np.flatnonzero(mark).astype(np.int32)
        keys = None
        for size in range(2, longest + 1):
            further = (self.left[at] >= size) & mark[at + 1]
            at = at[further]
            keys = self.keys[self.ids[at]] if keys is None else keys[further]
            at, keys = more(size, lambda at=at, keys=keys, size=size: self.blocks(at, keys, size))
            if not len(at):
                return
            mark = np.zeros(len(self.ids) + 1, bool)
            mark[at] = True
            if size < shortest:
                continue
            some, where, counts = np.unique(keys, return_index=True, return_counts=True)
            yield size, at[where].astype(np.int64), some, counts

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        """The texts of phrases, their words joined by one space."""
        words = [self.words.take(pa.array(self.ids[at + k])) for k in range(size)]
        joined = words[0] if size == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary()))
        return joined.cast(pa.large_string()).cast(pa.string())


def _spans(data: np.ndarray, starts: np.ndarray, widths: np.ndarray) -> pa.Array:
    step = np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths)
    bounds = np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[np.repeat(starts, widths) + step])])


def _joined(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not pairs:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    return np.concatenate([a for a, _ in pairs]), np.concatenate([k for _, k in pairs])


def _frequent(least: int):
    """Keeps what occurs ``least`` times: counters that keys share leave most rare ones out before they are counted one by one."""
    def more(size: int, blocks) -> tuple[np.ndarray, np.ndarray]:
        if least == 1:
            return _joined(list(blocks()))
        slot = lambda keys: ((keys >> np.uint64(20)) & np.uint64(_SLOTS - 1)).astype(np.int64)
        counters = np.zeros(_SLOTS, np.int32)
        for _, keys in blocks():
            counters += np.bincount(slot(keys), minlength=_SLOTS).astype(np.int32)
        enough = counters >= least
        at, keys = _joined([(a[m], k[m]) for a, k in blocks() for m in (enough[slot(k)],)])
        some, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
        own = (counts >= least)[back]
        return at[own], keys[own]

    return more


def _in(union: Union, shortest: int, then=None) -> tuple:
    """Keeps the words, and the phrases of fewer than ``shortest`` words, that are in a union; ``then`` says it of longer ones."""
    def more(size: int, blocks) -> tuple[np.ndarray, np.ndarray]:
        if size >= shortest:
            return then(size, blocks)
        return _joined([(a[m], k[m]) for a, k in blocks() for m in (union.known(k),)])

    return lambda keys, counts: union.known(keys), more


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[Shard]:
    """The texts of a task in shards of about ``shard_bytes``; a longer text is cut where a piece ends."""
    shard = Shard()
    for batch in batches:
        for rows, data, offsets in slices(batch, "text", 4 << 20):
            langs = rows.column("lang").to_pylist()
            for some, bounds in _cut(data, offsets, shard_bytes):
                shard.add(some, bounds, langs)
                if shard.size >= shard_bytes:
                    if shard.parts:
                        shard.close()
                        yield shard
                    shard = Shard()
    if shard.parts:
        shard.close()
        yield shard


def _cut(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if len(data) <= 2 * most:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        to = at + most
        window = 1 << 16
        while to < len(data):
            found = np.flatnonzero(_KIND[data[to : to + window]] == 2)
            if len(found):
                to += int(found[0]) + 1
                break
            to += window
        to = min(to, len(data))
        yield data[at:to], np.clip(offsets - at, 0, to - at)
        at = to


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


#: Bits that a bucket of keys stands for, at least, and the bytes of a key that travel in it: together they are the whole key.
_BUCKET_BITS, _KEY_BYTES = 8, 7
_PACKED = "bucket int, keys binary, counts binary"


def _packed(keys: np.ndarray, counts: np.ndarray, bucket_bits: int, kind: type) -> Iterator[dict[str, pa.Array]]:
    """A shard's keys in order and their counts, a row a bucket. A count's bytes lie apart, since most of its high ones are zero."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(kind)
    edges = np.searchsorted((keys >> np.uint64(64 - bucket_bits)).astype(np.int64), np.arange((1 << bucket_bits) + 1))
    low = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES])
    parts = counts.view(np.uint8).reshape(len(counts), -1)
    own = np.flatnonzero(np.diff(edges))
    for some in (own[i : i + 64] for i in range(0, len(own), 64)):
        yield {"bucket": pa.array(some.astype(np.int32)), "keys": pa.array([low[edges[k] : edges[k + 1]].tobytes() for k in some], pa.binary()),
               "counts": pa.array([parts[edges[k] : edges[k + 1]].T.tobytes() for k in some], pa.binary())}


def _unpacked(bucket: int, frame: pd.DataFrame, bucket_bits: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's keys in order with their counts, the first place of each distinct key, and each key's row of ``frame``."""
    sizes = np.array([len(x) for x in frame["keys"]]) // _KEY_BYTES
    whole = np.zeros((sizes.sum(), 8), np.uint8)
    whole[:, :_KEY_BYTES] = np.frombuffer(b"".join(frame["keys"]), np.uint8).reshape(-1, _KEY_BYTES)
    keys = whole.view(np.uint64).reshape(-1) | (np.uint64(bucket) << np.uint64(64 - bucket_bits))
    counts = np.concatenate([np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).reshape(-1) for x in frame["counts"]])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    return keys, counts[order], np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), np.repeat(np.arange(len(sizes)), sizes)[order]


class Union:
    """What the shards found, as fields of a fixed size: a bit for each phrase, and the highest count (up to 255) that a shard has of it."""

    def __init__(self) -> None:
        self.bits, self.most = np.zeros(1 << (BITS - 3), np.uint8), np.full(1 << MOST_BITS, 255, np.uint8)

    def known(self, keys: np.ndarray) -> np.ndarray:
        high = (keys >> np.uint64(64 - BITS)).astype(np.int64)
        return (self.bits[high >> 3] >> (high & 7).astype(np.uint8)) & 1 == 1

    def has_most(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Whether no shard has more of a phrase; of phrases that share a number, the lowest counts."""
        return counts >= self.most[(keys >> np.uint64(64 - MOST_BITS)).astype(np.int64)]

    def add(self, found: DataFrame) -> None:
        """Take ``_FIELDS``, which have one size altogether, whatever the number of phrases."""
        for r in found.collect():
            bits, most = (np.frombuffer(zlib.decompress(r[x]), np.uint8) for x in ("bits", "most"))
            self.bits[r["bucket"] * len(bits) :][: len(bits)] |= bits
            own = self.most[r["bucket"] * len(most) :][: len(most)]
            np.minimum(own, most, out=own)


_FIELDS = "bucket int, bits binary, most binary"


def _fields(bucket: int, keys: np.ndarray, most: np.ndarray, bucket_bits: int) -> pd.DataFrame:
    """A bucket's part of the fields of a ``Union``."""
    bits, high = np.zeros(1 << (BITS - bucket_bits), bool), np.full(1 << (MOST_BITS - bucket_bits), 255, np.uint8)
    bits[(keys >> np.uint64(64 - BITS)).astype(np.int64) & (len(bits) - 1)] = True
    np.minimum.at(high, (keys >> np.uint64(64 - MOST_BITS)).astype(np.int64) & (len(high) - 1), np.minimum(most, 255).astype(np.uint8))
    return pd.DataFrame({"bucket": [bucket], "bits": [zlib.compress(np.packbits(bits, bitorder="little"), 1)], "most": [zlib.compress(high, 1)]})


def frequent_phrases(docs: DataFrame, support: int = 100, longest: int = 5, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``lang, size, phrase, f``: all phrases of up to ``longest`` words with ``f >= support`` in their language, exactly.

    ``size`` 0 with an empty phrase is a language's number of words (whatever it is). ``docs`` has ``lang`` (null:
    ``und``) and ``text`` (null: empty).
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # shards as large as they may be: the fewer they are, the higher is their support
    shard_bytes = max(1, min(shard_bytes, -(-total // LEAST_SHARDS)))
    lowered = total <= MOST_SHARDS * shard_bytes
    if not lowered:  # their size changes no support, and all their phrases are in work at a time
        shard_bytes = max(1, shard_bytes // 2)
    rows = rows.coalesce(max(spark.sparkContext.defaultParallelism, -(-total // shard_bytes)))
    bucket_bits = min(MOST_BITS - 3, max(_BUCKET_BITS, int(total >> 25).bit_length()))
    # counts that are cut to a byte are over the support in one shard
    kind = np.uint8 if support <= 255 else np.int64

    def least(shard: Shard) -> int:
        return max(1, -(-support * shard.size // max(total, 1))) if lowered else 1

    def mine(shortest: int, to: int, sent=None) -> DataFrame:
        """The fields of a shard's frequent phrases that may be so in all; parts of fewer than ``shortest`` words are those in ``sent``."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in _shards(batches, shard_bytes):
                t = least(shard)
                one, more = (lambda keys, counts: counts >= t), _frequent(t)  # noqa: B023, E731
                if sent is not None:
                    one, more = _in(sent.value, shortest, more)
                found = [(keys, counts) for _, _, keys, counts in shard.lengths(to, one, more, shortest)]
                if found:
                    keys, counts = (np.concatenate(x) for x in zip(*found))
                    del found
                    for part in _packed(keys, np.minimum(counts, np.iinfo(kind).max), bucket_bits, kind):
                        yield _batch({**part, "under": pa.array([t - 1] * len(part["bucket"]), pa.int64())})
                yield _batch({"bucket": pa.nulls(1, pa.int32()), "keys": pa.nulls(1, pa.binary()), "counts": pa.nulls(1, pa.binary()), "under": pa.array([t - 1], pa.int64())})

        def union(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            """By how much each count is over what a shard that does not name it may have, and what all shards may have."""
            keys, counts, at, row = _unpacked(group[0], frame, bucket_bits, kind)
            over = np.add.reduceat(counts.astype(np.int64) - frame["under"].to_numpy()[row], at)
            enough = over + slack >= support
            return _fields(group[0], keys[at][enough], np.maximum.reduceat(counts, at)[enough], bucket_bits)

        mined, slack = rows.mapInArrow(run, f"{_PACKED}, under long"), 0
        if lowered:
            mined = saved(mined)
            kept.append(mined)
            slack = mined.where("bucket IS NULL").agg(F.sum("under")).first()[0] or 0
        return mined.where("bucket IS NOT NULL").groupBy("bucket").applyInPandas(union, _FIELDS)

    kept: list[DataFrame] = []
    found = Union()
    if lowered:
        found.add(mine(1, longest))
    else:
        found.add(mine(1, min(2, longest)))
        if longest > 2:
            found.add(mine(3, longest, spark.sparkContext.broadcast(found)))

    def count(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = {"bucket": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "key": pa.int64(), "n": pa.int64(), "size": pa.int32(), "lang": pa.string(), "phrase": pa.string()}

            def some(**columns) -> pa.RecordBatch:
                n = len(next(iter(columns.values())))
                return _batch({c: columns[c] if c in columns else pa.nulls(n, kind) for c, kind in none.items()})

            for shard in _shards(batches, shard_bytes):
                names, every = list(shard.langs), []
                n = np.bincount(shard.lang[shard.ids], minlength=len(names))
                yield some(n=pa.array(n, pa.int64()), size=pa.array([0] * len(names), pa.int32()), lang=pa.array(names), phrase=pa.array([""] * len(names)))
                for size, at, keys, counts in shard.lengths(longest, *_in(sent.value, longest + 1)):
                    every.append((keys, counts))
                    # a frequent phrase has its highest count in one shard at least, which gives its text
                    own = np.flatnonzero(sent.value.has_most(keys, counts))
                    for part in (own[i : i + 100_000] for i in range(0, len(own), 100_000)):
                        yield some(key=pa.array(keys[part].view(np.int64)), size=pa.array(np.full(len(part), size, np.int32)),
                                   lang=pa.array(names).take(pa.array(shard.lang[shard.ids[at[part]]])), phrase=shard.phrases(at[part], size))
                if every:
                    keys, counts = (np.concatenate(x) for x in zip(*every))
                    for part in _packed(keys, counts, bucket_bits, np.uint32):
                        yield some(**part)

        return rows.mapInArrow(run, f"{_PACKED}, key long, n long, size int, lang string, phrase string")

    def total_of(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        keys, counts, at, _ = _unpacked(group[0], frame, bucket_bits, np.uint32)
        f = np.add.reduceat(counts, at, dtype=np.int64)
        return pd.DataFrame({"key": keys[at][f >= support].view(np.int64), "f": f[f >= support]})

    counted = saved(count(spark.sparkContext.broadcast(found)))
    sums = saved(counted.where("bucket IS NOT NULL").select("bucket", "keys", "counts").groupBy("bucket").applyInPandas(total_of, "key long, f long"))
    kept += [counted, sums]
    phrases = lambda some: some.where("size > 0").select("key", "size", "lang", "phrase").dropDuplicates(["key"]).join(sums, "key")
    texts = saved(phrases(counted))
    kept.append(texts)
    if texts.count() < sums.count():
        # rows came in another order than when they were mined, so shards are others: all of them give the texts
        found.most[:] = 0
        texts = saved(phrases(count(spark.sparkContext.broadcast(found))))
        kept.append(texts)
    of_lang = counted.where("size = 0").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f"))
    out = saved(texts.select("lang", "size", "phrase", "f").unionByName(of_lang))
    discard(*kept)
    return out


#: floor(1000 a n / (l r)), in decimals, since the products may pass 64 bits.
SCORE = "(CAST(1000 * CAST(a AS DECIMAL(19,0)) AS DECIMAL(23,0)) * CAST(n AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"


def collocations(docs: DataFrame, support: int = 100, longest: int = 5, first: int = 2000, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``first`` phrases of 2 to ``longest`` words.

    A-Z is lower-cased; pieces end at ``.,;:!?`` and line ends, words at spaces and tabs. ``a`` is a phrase's number of
    occurrences, overlapping ones included, ``n`` that of all words; ``l`` and ``r`` are those of its two parts at the
    cut with the lowest score, floor(1000 a n / (l r)), the shortest first part on ties. A phrase goes if a longer one
    with ``support`` holds it and occurs at least as often. Numbers are exact (38 digits).

    Null and empty texts have no words, null languages are ``und``, repeated rows count as often as they occur, empty
    tables give no rows; other columns are not read. Texts of any length are mined whole.
    """
    known = frequent_phrases(docs, support, longest, shard_bytes)
    words = F.split("phrase", " ")
    long = known.where("size > 1").withColumn("_w", words)
    part = lambda start, n: F.array_join(F.slice("_w", start, n), " ")
    cuts = long.select("lang", "phrase", F.col("f").alias("a"), "_w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size")
    of = lambda name, f: known.where("size > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("_l"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("_r"))
    cuts = cuts.join(of("_l", "l"), ["lang", "_l"]).join(of("_r", "r"), ["lang", "_r"])
    cuts = cuts.join(F.broadcast(known.where("size = 0").select("lang", F.col("f").alias("n"))), "lang")  # a row a language
    cuts = cuts.withColumn("score", F.expr(SCORE))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    spans = long.where("size > 2").select("lang", "f", "_w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("_m"))
    spans = spans.select("lang", "f", "_w", "_m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_m") + 1)).alias("_s"))
    holders = spans.select("lang", part(F.col("_s"), F.col("_m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_f"))
    kept = best.join(holders, ["lang", "phrase"], "left").where("_f IS NULL OR _f < a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql(support: int = 100, first: int = 2000) -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase FROM w, (VALUES (1), (2), (3), (4), (5)) AS v(k) WHERE len(w) >= k),
f AS (SELECT lang, k AS size, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= {support}),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cut AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, n.n, CAST(CAST(1000 AS HUGEINT) * a * n.n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1 : k], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[k + 1 :], ' ') JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS q FROM s) WHERE q = 1),
held AS (SELECT DISTINCT b.lang, b.phrase FROM c b JOIN c x ON x.lang = b.lang AND x.size > b.size AND x.a >= b.a AND contains(concat(' ', x.phrase, ' '), concat(' ', b.phrase, ' '))),
r AS (SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank FROM best LEFT JOIN held h ON h.lang = best.lang AND h.phrase = best.phrase WHERE h.phrase IS NULL)
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= {first}"""
