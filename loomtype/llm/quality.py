"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded, a gated attention weighs the passages, and the weighted
mean is scored (Ilse, Tomczak, Welling 2018). Labels are known for documents only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .textbytes import slices

PASSAGE_BYTES = 400
BIGRAMS = 96
CLASSES = 16
HIDDEN, GATE = 24, 16

_SPACE, _LOWER, _UPPER, _DIGIT, _HIGH, _LINE = range(6)


def _byte_classes() -> np.ndarray:
    """White space, lower and upper case, digits, bytes of other scripts, line ends, and kinds of punctuation."""
    out = np.full(256, CLASSES - 1, np.uint8)
    out[[9, 11, 12, 13, 32]] = _SPACE
    out[10] = _LINE
    out[97:123], out[65:91], out[48:58], out[128:] = _LOWER, _UPPER, _DIGIT, _HIGH
    for i, group in enumerate((".", ",;:", "!?", "$%&#*", "|", "'\"", "()[]{}", "<>/\\=", "-_")):
        for c in group:
            out[ord(c)] = 6 + i
    return out


_CLASS = _byte_classes()
_BIGRAM = np.random.default_rng(5).integers(0, BIGRAMS, (256, 256)).astype(np.uint8)
FEATURES = CLASSES + CLASSES * CLASSES + BIGRAMS + 6


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encode all passages of a batch: (rows that they belong to, features). Every byte is in one passage.

    A text is cut into equal passages of about ``PASSAGE_BYTES`` bytes; an empty text has one empty passage. Features
    are shares of byte classes, of pairs of classes and of hashed byte pairs, word lengths, repetition of hashed
    pairs, and the passage's length.
    """
    sizes = np.diff(offsets)
    per_row = np.maximum(1, (sizes + PASSAGE_BYTES // 2) // PASSAGE_BYTES)
    owner = np.repeat(np.arange(len(sizes)), per_row)
    first = np.cumsum(per_row) - per_row
    local = np.arange(len(owner)) - first[owner]
    begins = offsets[:-1][owner] + local * sizes[owner] // per_row[owner]
    ends = np.append(begins[1:], offsets[-1])
    n = len(owner)
    length = (ends - begins).astype(np.float64)
    of = np.repeat(np.arange(n, dtype=np.int64), ends - begins)
    kind = _CLASS[data].astype(np.int64)
    counts = np.bincount(of * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    out = np.zeros((n, FEATURES), np.float32)
    out[:, :CLASSES] = counts / np.maximum(length, 1)[:, None]
    if len(data) > 1:
        same = of[1:] == of[:-1]
        pair = (of[:-1] * (CLASSES * CLASSES) + kind[:-1] * CLASSES + kind[1:])[same]
        pairs = np.bincount(pair, minlength=n * CLASSES * CLASSES).reshape(n, -1)
        total = np.maximum(length - 1, 1)[:, None]
        at = CLASSES + CLASSES * CLASSES
        out[:, CLASSES:at] = pairs / total
        grams = np.bincount((of[:-1] * BIGRAMS + _BIGRAM[data[:-1], data[1:]])[same], minlength=n * BIGRAMS).reshape(n, -1) / total
        out[:, at : at + BIGRAMS] = grams
        out[:, at + BIGRAMS] = (grams * grams).sum(axis=1) * 10
        words = pairs[:, : CLASSES * CLASSES].reshape(n, CLASSES, CLASSES)
        gaps = words[:, [_SPACE, _LINE], :].sum(axis=(1, 2)) - words[:, [_SPACE, _LINE]][:, :, [_SPACE, _LINE]].sum(axis=(1, 2))
        out[:, at + BIGRAMS + 1] = gaps / total[:, 0] * 5
    letters = np.maximum(counts[:, [_LOWER, _UPPER, _HIGH]].sum(axis=1), 1)
    out[:, -4] = counts[:, _UPPER] / letters
    out[:, -3] = 1.0 - letters / np.maximum(length, 1)
    out[:, -2] = np.log1p(length) / 10
    out[:, -1] = np.log1p(sizes[owner]) / 10
    return owner, out


@dataclass
class Model:
    """Standardisation, passage encoder, gated attention, and the document's score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, owner: np.ndarray, features: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Score of each row, and the attention of each passage."""
        w = self.weights
        x = np.clip((features - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ w["E"] + w["e"])
        gate = np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))
        raw = gate @ w["a"]
        top = np.full(n_rows, -np.inf)
        np.maximum.at(top, owner, raw)
        part = np.exp(raw - top[owner])
        attention = part / np.bincount(owner, part, n_rows)[owner]
        z = np.stack([np.bincount(owner, attention * h[:, k], n_rows) for k in range(h.shape[1])], axis=1)
        return 1 / (1 + np.exp(-(z @ w["c"] + w["b"][0]))), attention


def fit(owner: np.ndarray, features: np.ndarray, labels: np.ndarray, steps: int = 400, rate: float = 0.01,
        decay: float = 1e-3, batch: int = 256, seed: int = 3) -> Model:
    """Learn by Adam from bags: ``owner`` gives each passage's bag, ``labels`` each bag's label (0 to 1)."""
    dice = np.random.default_rng(seed)
    if not len(labels):
        zero = {k: np.zeros(s) for k, s in (("E", (FEATURES, 1)), ("e", 1), ("V", (1, 1)), ("U", (1, 1)), ("a", 1), ("c", 1), ("b", 1))}
        return Model(np.zeros(FEATURES), np.ones(FEATURES), zero)
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
    x_all = np.clip((features - mean) / scale, -6, 6)
    start = np.searchsorted(owner, np.arange(len(labels) + 1))
    share = np.clip(labels.mean(), 0.02, 0.98)
    w = {"E": dice.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), "e": np.zeros(HIDDEN),
         "V": dice.normal(0, 0.3, (HIDDEN, GATE)), "U": dice.normal(0, 0.3, (HIDDEN, GATE)), "a": dice.normal(0, 0.3, GATE),
         "c": dice.normal(0, 0.1, HIDDEN), "b": np.array([np.log(share / (1 - share))])}
    m, v = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}
    for step in range(1, steps + 1):
        bags = dice.choice(len(labels), min(batch, len(labels)), replace=False)
        rows = np.concatenate([np.arange(start[i], start[i + 1]) for i in bags])
        of = np.repeat(np.arange(len(bags)), start[bags + 1] - start[bags])
        y = labels[bags]
        x = x_all[rows]
        h = np.tanh(x @ w["E"] + w["e"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        raw = (t * s) @ w["a"]
        first = np.searchsorted(of, np.arange(len(bags)))
        part = np.exp(raw - np.maximum.reduceat(raw, first)[of])
        att = part / np.add.reduceat(part, first)[of]
        z = np.add.reduceat(att[:, None] * h, first)
        p = 1 / (1 + np.exp(-(z @ w["c"] + w["b"][0])))
        d = (p - y) / len(bags)
        dz = d[:, None] * w["c"]
        through = (h * dz[of]).sum(axis=1)
        draw = att * (through - np.add.reduceat(att * through, first)[of])
        dt, ds = draw[:, None] * w["a"] * s * (1 - t * t), draw[:, None] * w["a"] * t * s * (1 - s)
        dh = att[:, None] * dz[of] + dt @ w["V"].T + ds @ w["U"].T
        de = dh * (1 - h * h)
        grads = {"E": x.T @ de, "e": de.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "a": ((t * s) * draw[:, None]).sum(axis=0),
                 "c": z.T @ d, "b": np.array([d.sum()])}
        for k, g in grads.items():
            g = g + decay * w[k] * (k not in ("b", "e"))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def _held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def _bags(docs: DataFrame, labels: DataFrame, bound: int, passages_bound: int) -> DataFrame:
    """``doc_id, text, label`` of the bags to learn from: at most ``passages_bound`` passages, chosen before encoding.

    Of repeated rows of a document the longest is its bag. In the order of the ids' hashes a bag that doesn't fit
    into what is left is passed over, and later ones are still taken. Only ids, sizes and hashes come to the driver.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out()).groupBy("doc_id").agg(
        F.avg("quality").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    own = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).join(F.broadcast(chosen), "doc_id")
    own = own.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn("hash", F.xxhash64("text"))
    picked = own.groupBy("doc_id").agg(F.max(F.struct("bytes", "hash")).alias("pick"), F.xxhash64("doc_id").alias("at"))
    rows = picked.select("doc_id", "pick.bytes", "pick.hash", "at").orderBy("at", "doc_id").collect()
    left, keep = passages_bound, []
    for r in rows:
        n = max(1, (r["bytes"] + PASSAGE_BYTES // 2) // PASSAGE_BYTES)
        if n <= left:
            left -= n
            keep.append((r["doc_id"], r["bytes"], r["hash"]))
    if rows and not keep:
        raise ValueError(f"none of {len(rows)} labelled documents has at most {passages_bound} passages")
    kept = docs.sparkSession.createDataFrame(keep, "doc_id long, bytes long, hash long")
    same = own.join(F.broadcast(kept), ["doc_id", "bytes", "hash"])
    return same.groupBy("doc_id").agg(F.first("text").alias("text"), F.first("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, bound: int = 3000, passages_bound: int = 80_000) -> Model:
    """Fit on the labelled documents that are not held out.

    At most ``bound`` of them are used, those whose ids hash lowest, with at most ``passages_bound`` passages; a
    document has several label rows' mean as its label. Without labels every score is one half; labelled documents
    of which none fits raise an error.
    """
    small_batches(docs.sparkSession)
    bags = _bags(docs, labels, bound, passages_bound)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                owner, features = passages(data, offsets)
                at = np.searchsorted(owner, np.arange(rows.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("label"), pa.array([features[a:b].tobytes() for a, b in zip(at, at[1:])])],
                    ["doc_id", "label", "bag"])

    got = bags.mapInArrow(encode, "doc_id long, label double, bag binary").toPandas()
    got = got.sort_values("doc_id")
    parts = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in got["bag"]]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if parts else np.zeros(0, np.int64)
    features = np.concatenate(parts) if parts else np.zeros((0, FEATURES), np.float32)
    return fit(owner, features, got["label"].to_numpy())


def score(docs: DataFrame, model: Model, column: str = "_score") -> DataFrame:
    """All columns of ``docs`` and ``column``: the quality (0 to 1) of the whole text (null: empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                result, _ = shared.value.scores(*passages(data, offsets), rows.num_rows)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(result, pa.float64())], [*names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Null and empty texts are one empty passage and get the model's score for it; null ids count as not held out and
    teach nothing; repeated rows are scored each; an empty table gives no rows; other columns are dropped.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The documents that ``classify`` accepts, with all their columns, whatever their names.

    Null and empty texts are judged like others; repeated rows are kept or go together; an empty table gives no rows.
    """
    own = "_score"
    while own in docs.columns:
        own += "_"
    return score(docs, train(docs, labels), own).where(F.col(own) >= least).select(*[F.col(f"`{c}`") for c in docs.columns])
