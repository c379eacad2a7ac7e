"""Quartile bucket digests of whole texts, and their comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_batches
from .textbytes import clean, runs

BUCKETS = 128
#: Offsets, from the newest byte of a five-byte window, of the triplets that are counted.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
#: Difference of two buckets' quartiles -> its cost; opposite quartiles cost most.
COSTS = np.array([0, 1, 2, 6], np.int64)
#: Differences of this much or more count as unlike.
BOUND = 180

_dice = np.random.default_rng(7)
_TABLES = _dice.integers(0, 2**32, (3, 256), np.uint32)
_SALTS = _dice.integers(0, 2**32, len(TRIPLETS), np.uint32)


def bucket_counts(texts: list[bytes], block: int = 1 << 18) -> np.ndarray:
    """Counts of hashed byte triplets per text and bucket. Texts under five bytes are padded by zero bytes to five.

    Works on ``block`` bytes at a time, however long the texts are.
    """
    padded = [t if len(t) >= 5 or not t else t + bytes(5 - len(t)) for t in texts]
    data = np.frombuffer(b"".join(padded), np.uint8)
    ends = np.cumsum([len(t) for t in padded], dtype=np.int64)
    starts = np.append(0, ends[:-1])
    counts = np.zeros(len(texts) * BUCKETS, np.int64)
    for low in range(4, len(data), block):
        high = min(low + block, len(data))  # the newest bytes of this block's windows
        owner = np.repeat(np.arange(len(texts)), np.clip(ends, low, high) - np.clip(starts, low, high))
        whole = np.flatnonzero(np.arange(low, high) - starts[owner] >= 4)
        rows = owner[whole] * BUCKETS
        one, two, three = (t[data[low - 4 : high]] for t in _TABLES)
        n = len(one)
        for (a, b, c), salt in zip(TRIPLETS, _SALTS):
            h = one[4 - a : n - a] + two[4 - b : n - b] + three[4 - c : n - c] + salt
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(rows + (h[whole] >> np.uint32(25)), minlength=len(counts))
    return counts.reshape(len(texts), BUCKETS)


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the quartile (0 to 3) of each bucket, and the length's class (log scale; 0 for the empty text)."""
    counts = bucket_counts(texts)
    ordered = np.sort(counts, axis=1)
    codes = np.zeros(counts.shape, np.uint8)
    for q in (1, 2, 3):
        codes += counts > ordered[:, q * BUCKETS // 4 - 1][:, None]
    lengths = np.array([len(t) for t in texts], np.float64)
    classes = np.where(lengths > 0, 1 + np.floor(np.log(np.maximum(lengths, 1)) / np.log(1.1)), 0)
    return codes, np.minimum(classes, 255).astype(np.int64)


def digest_strings(codes: np.ndarray, classes: np.ndarray) -> list[str]:
    quads = codes.reshape(len(codes), BUCKETS // 4, 4)
    packed = (quads << np.array([6, 4, 2, 0], np.uint8)).sum(axis=2).astype(np.uint8)
    return [f"{c:02x}{row.tobytes().hex()}" for c, row in zip(classes, packed)]


def likeness(codes: np.ndarray, classes: np.ndarray, other: np.ndarray, other_classes: np.ndarray) -> np.ndarray:
    """1 for equal digests, down to 0 where the difference reaches ``BOUND``; an empty text is unlike any other."""
    gaps = np.abs(codes.astype(np.int8) - other.astype(np.int8))
    cost = COSTS[gaps].sum(axis=1) + np.maximum(np.abs(classes - other_classes) - 1, 0)
    near = 1.0 - np.minimum(cost, BOUND) / BOUND
    return np.where((classes == 0) != (other_classes == 0), 0.0, near)


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _compared(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    edited = []
    for text, after in zip(texts, following):
        cut = len(text) // 3
        edited.append((text[: len(text) - cut] + after[:cut]).encode("utf-8", "surrogatepass"))
    shared = all(a is b for a, b in zip(texts[1:], following))
    plain = [t.encode("utf-8", "surrogatepass") for t in (texts + following[-1:] if shared else texts + following)]
    codes, classes = digests(plain)
    e_codes, e_classes = digests(edited)
    n = len(texts)
    own, own_c = codes[:n], classes[:n]
    nxt, nxt_c = (codes[1:], classes[1:]) if shared else (codes[n:], classes[n:])
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
        pa.array(digest_strings(own, own_c)), pa.array(digest_strings(e_codes, e_classes)),
        pa.array(likeness(own, own_c, e_codes, e_classes)), pa.array(likeness(own, own_c, nxt, nxt_c)),
    ]


_NAMES = [f.split()[0] for f in RESULT.split(", ")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every whole text (null: empty); equal texts have equal fingerprints.

    A digest is the length's class and, for each of 128 buckets of hashed byte triplets, the quartile of its count.
    Repeated rows and null ids are kept; an empty table gives no rows; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                for batch, texts in runs(whole.slice(at, 1000), "text"):
                    strings = digest_strings(*digests([t.encode("utf-8", "surrogatepass") for t in texts]))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(strings, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def edit_sensitivity(docs: DataFrame, chunk_chars: int = 500_000, chunk_rows: int = 1000) -> DataFrame:
    """Compare each text's fingerprint with an edited text's and with the next document's.

    The edited text has its last third (code points, rounded down) replaced by the beginning of the next document in
    descending ``doc_id`` order; the last document is followed by the first. Rows are range-partitioned by doc_id and
    the text's beginning, so that neighbours meet within a task; only each partition's first and last document are
    matched afterwards, by a join on the partition's number.

    Null texts are empty; null ids come last; rows that share an id are ordered by their text; an empty table gives
    no rows; a single row is followed by itself; other columns are dropped.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple[list, list] = ([], [])

        def edge(kind: int, doc_id, text: str) -> pa.RecordBatch:
            blank = [pa.array([doc_id], pa.int64())] + [pa.nulls(1, t) for t in (
                pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays(blank + [pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([text])],
                                              _NAMES + ["part", "kind", "text"])

        def rows(ids: list, texts: list) -> pa.RecordBatch:
            out = _compared(ids[:-1], texts[:-1], texts[1:])
            n = len(ids) - 1
            return pa.RecordBatch.from_arrays(
                out + [pa.array([part] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.string())],
                _NAMES + ["part", "kind", "text"])

        begun = False
        for batch in batches:
            size = sum(map(len, held[1]))
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), clean(batch.column("text"))):
                if not begun:
                    yield edge(1, doc_id, text)
                    begun = True
                held[0].append(doc_id)
                held[1].append(text)
                size += len(text)
                if (size > chunk_chars or len(held[0]) > chunk_rows) and len(held[0]) > 1:
                    yield rows(*held)
                    held = (held[0][-1:], held[1][-1:])
                    size = len(text)
        if len(held[0]) > 1:
            yield rows(*held)
        if begun:
            yield edge(2, held[0][-1], held[1][-1])

    small_batches(docs.sparkSession)
    by = [F.col("doc_id").desc_nulls_last(), F.substring("text", 1, 64).asc_nulls_first()]
    order = [*by, F.col("text").asc_nulls_first()]
    walked = saved(docs.select("doc_id", "text").repartitionByRange(*by).sortWithinPartitions(*order).mapInArrow(
        walk, RESULT + ", part int, kind int, text string"))

    heads = walked.where("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("after"))
    along = Window.orderBy("part")  # one number a partition
    first = F.first("part").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follows = walked.where("kind = 1").select("part").withColumn("next", F.coalesce(F.lead("part").over(along), first))
    last = walked.where("kind = 2").select("doc_id", "part", "text").join(follows, "part").join(heads, "next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    _compared(row.column("doc_id").to_pylist(), clean(row.column("text")), clean(row.column("after"))), _NAMES)

    return walked.where("kind = 0").select(*_NAMES).unionByName(
        last.select("doc_id", "text", "after").mapInArrow(finish, RESULT))
