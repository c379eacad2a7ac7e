"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, and merged shard results.

Nearness is the inner product. A shard's vectors get one more component that makes all norms equal, so that the
graph is built for a proper distance (Malkov and Yashunin 2018; Neyshabur and Srebro 2015 for the reduction).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved

LINKS = 16
BATCH = 256


@dataclass
class Graph:
    """A shard's graph: augmented vectors, and per layer its nodes and their neighbours (-1: none), all flat arrays."""

    vectors: np.ndarray
    nodes: list[np.ndarray]
    neighbours: list[np.ndarray]


def width(level: int) -> int:
    return 2 * LINKS if level == 0 else LINKS


def augmented(vectors: np.ndarray) -> np.ndarray:
    """Vectors of one common norm, at most 1 before the last component, as 32-bit floats."""
    x = vectors.astype(np.float64)
    peak = np.abs(x).max() if x.size else 0.0
    x = x / (peak or 1.0)
    norms = (x**2).sum(axis=1)
    most = norms.max() if len(norms) else 1.0
    return (np.concatenate([x, np.sqrt(np.maximum(most - norms, 0))[:, None]], axis=1) / np.sqrt(most or 1.0)).astype(np.float32)


def _nearness(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.matmul(x[ids], q[:, :, None])[:, :, 0]


def descend(x: np.ndarray, links: np.ndarray, place: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """From the nodes ``at`` of one layer, go on to the nearest neighbour until none is nearer to each query."""
    at = at.copy()
    best = np.einsum("ij,ij->i", q, x[at])
    moving = np.arange(len(at))
    while len(moving):
        near = links[place[at[moving]]]
        ids = np.where(near >= 0, near, at[moving][:, None])
        value = _nearness(x, q[moving], ids)
        k = value.argmax(axis=1)
        row = np.arange(len(moving))
        top = value[row, k]
        better = top > best[moving]
        moving, ids, top = moving[better], ids[row, k][better], top[better]
        at[moving], best[moving] = ids, top
    return at


def beam(x: np.ndarray, links: np.ndarray, place: np.ndarray, q: np.ndarray, at: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and nearness of about ``ef`` nearest nodes of one layer; all queries advance together."""
    m = len(q)
    ids = np.full((m, ef), -1, np.int64)
    value = np.full((m, ef), -np.inf, np.float32)
    open_ = np.zeros((m, ef), bool)
    ids[:, 0], value[:, 0], open_[:, 0] = at, np.einsum("ij,ij->i", q, x[at]), True
    seen = np.zeros((m, len(x)), bool)
    seen[np.arange(m), at] = True
    active = np.arange(m)
    while len(active):
        a_open, a_value = open_[active], value[active]
        pick = np.where(a_open, a_value, -np.inf).argmax(axis=1)
        row = np.arange(len(active))
        open_[active, pick] = False
        a_open[row, pick] = False
        here = ids[active, pick]
        near = links[place[here]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        seen[active[:, None], np.where(fresh, near, here[:, None])] = True
        new = np.where(fresh, _nearness(x, q[active], near), -np.inf)
        all_value = np.concatenate([a_value, new], axis=1)
        keep = np.argpartition(-all_value, ef - 1, axis=1)[:, :ef]
        value[active] = all_value[row[:, None], keep]
        ids[active] = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)[row[:, None], keep]
        open_[active] = np.concatenate([a_open, fresh], axis=1)[row[:, None], keep]
        active = active[open_[active].any(axis=1)]
    return ids, value


def thinned(x: np.ndarray, ids: np.ndarray, value: np.ndarray, many: int) -> np.ndarray:
    """Per row up to ``many`` of the candidates (-1: none), nearest first, that lie in different directions.

    A candidate is kept when it is nearer to the node than to every one kept before it; what that leaves free goes to
    the nearest of the others.
    """
    order = np.argsort(-value, axis=1, kind="stable")
    ids, value = np.take_along_axis(ids, order, axis=1), np.take_along_axis(value, order, axis=1)
    there = ids >= 0
    own = x[ids]
    between = own @ own.transpose(0, 2, 1)
    kept = np.zeros(ids.shape, bool)
    closest = np.full(ids.shape, -np.inf, np.float32)
    for k in range(ids.shape[1]):
        take = there[:, k] & (value[:, k] > closest[:, k]) & (kept.sum(axis=1) < many)
        kept[:, k] = take
        closest[take] = np.maximum(closest[take], between[take, k])
    spare = there & ~kept
    kept |= spare & (np.cumsum(spare, axis=1) <= (many - kept.sum(axis=1))[:, None])
    first = np.argsort(~kept, axis=1, kind="stable")[:, :many]
    return np.where(np.take_along_axis(kept, first, axis=1), np.take_along_axis(ids, first, axis=1), -1)


def _link_back(x: np.ndarray, links: np.ndarray, place: np.ndarray, nodes: np.ndarray, chosen: np.ndarray) -> None:
    """Link the ``chosen`` neighbours back to ``nodes``; a full node keeps its nearest."""
    i, k = np.nonzero(chosen >= 0)
    src, dst = nodes[i], chosen[i, k]
    old = np.unique(dst)
    have = links[place[old]]
    r, c = np.nonzero(have >= 0)
    dst, src = np.concatenate([dst, old[r]]), np.concatenate([src, have[r, c]])
    pair = np.unique(dst * len(x) + src)
    dst, src = pair // len(x), pair % len(x)
    near = np.einsum("ij,ij->i", x[dst], x[src])
    order = np.lexsort((src, -near, dst))
    dst, src = dst[order], src[order]
    spot = np.arange(len(dst)) - np.searchsorted(dst, dst)
    fits = spot < links.shape[1]
    links[place[old]] = -1
    links[place[dst[fits]], spot[fits]] = src[fits]


def build(vectors: np.ndarray, seed: int = 1, ef: int = 80) -> Graph:
    """Insert all vectors, in batches that grow to ``BATCH``.

    A node descends through the layers above its own; in each of its layers a beam of ``ef`` nodes, and the others of
    its batch, are its candidates. They are thinned to ``LINKS`` neighbours, which link back.
    """
    x = augmented(vectors)
    n = len(x)
    dice = np.random.default_rng(seed)
    order = dice.permutation(n)
    levels = np.floor(dice.exponential(1 / np.log(LINKS), n)).astype(int)
    top = int(levels.max())
    entry = order[0]
    levels[entry] = top
    nodes = [np.flatnonzero(levels >= level) for level in range(top + 1)]
    places, tables = [], []
    for level, own in enumerate(nodes):
        place = np.full(n, -1, np.int64)
        place[own] = np.arange(len(own))
        places.append(place)
        tables.append(np.full((len(own), width(level)), -1, np.int64))
    done = 1
    while done < n:
        batch = order[done : done + min(done, BATCH)]
        q = x[batch]
        at = np.full(len(batch), entry)
        for level in range(top, -1, -1):
            inside = np.flatnonzero(levels[batch] >= level)
            if len(inside) < len(batch):
                others = np.flatnonzero(levels[batch] < level)
                at[others] = descend(x, tables[level], places[level], q[others], at[others])
            if not len(inside):
                continue
            own, qs = batch[inside], q[inside]
            ids, value = beam(x, tables[level], places[level], qs, at[inside], min(ef, done))
            best = value.argmax(axis=1)
            at[inside] = ids[np.arange(len(inside)), best]
            if len(own) > 1:
                peers = qs @ qs.T
                np.fill_diagonal(peers, -np.inf)
                many = min(LINKS, len(own) - 1)
                near = np.argpartition(-peers, many - 1, axis=1)[:, :many]
                ids, value = np.concatenate([ids, own[near]], axis=1), np.concatenate([value, np.take_along_axis(peers, near, axis=1)], axis=1)
            chosen = thinned(x, ids, value, LINKS)
            tables[level][places[level][own], : chosen.shape[1]] = chosen
            _link_back(x, tables[level], places[level], own, chosen)
        done += len(batch)
    return Graph(x, [own.astype(np.int32) for own in nodes], [t.astype(np.int32) for t in tables])


def search(graph: Graph, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and nearness, up to a factor of each query, of about ``ef`` nearest nodes."""
    q = queries.astype(np.float64)
    q = q / np.maximum(np.abs(q).max(axis=1), 1e-300)[:, None]
    q = np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)
    n = len(graph.vectors)
    at = np.full(len(q), graph.nodes[-1][0], np.int64)
    for level in range(len(graph.nodes) - 1, 0, -1):
        place = np.full(n, -1, np.int64)
        place[graph.nodes[level]] = np.arange(len(graph.nodes[level]))
        at = descend(graph.vectors, graph.neighbours[level], place, q, at)
    return beam(graph.vectors, graph.neighbours[0], np.arange(n), q, at, min(ef, n))


INDEX = "shard int, n int, dim int, vectors binary, ids binary, id_counts binary, layers array<int>, nodes binary, neighbours binary"


def _matrix(column: pa.Array, kind: type, dim: int | None = None) -> np.ndarray:
    rows = column.to_pylist()
    dim = dim or max(map(len, rows))
    out = np.zeros((len(rows), dim), kind)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r[:dim]
    return out


def _build_shard(kind: type):
    def make(key, rows):
        vectors = _matrix(rows.column("embedding"), kind)
        ids = rows.column("ids").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        vectors, ids = vectors[order], [ids[i] for i in order]
        graph = build(vectors)
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(ids)], pa.int32()),
            "dim": pa.array([vectors.shape[1]], pa.int32()), "vectors": pa.array([vectors.tobytes()]),
            "ids": pa.array([np.array([i for x in ids for i in x], np.int64).tobytes()]),
            "id_counts": pa.array([np.array([len(x) for x in ids], np.int32).tobytes()]),
            "layers": pa.array([[len(x) for x in graph.nodes]], pa.list_(pa.int32())),
            "nodes": pa.array([np.concatenate(graph.nodes).tobytes()]),
            "neighbours": pa.array([np.concatenate([x.reshape(-1) for x in graph.neighbours]).tobytes()])})

    return make


class Shard:
    """One row of the index, ready to be searched."""

    def __init__(self, row: dict, kind: type):
        n, dim = row["n"], row["dim"]
        nodes, neighbours, at, to = [], [], 0, 0
        flat_nodes, flat = np.frombuffer(row["nodes"], np.int32), np.frombuffer(row["neighbours"], np.int32)
        for level, size in enumerate(row["layers"]):
            nodes.append(flat_nodes[at : at + size])
            neighbours.append(flat[to : to + size * width(level)].reshape(size, width(level)))
            at, to = at + size, to + size * width(level)
        self.vectors = np.frombuffer(row["vectors"], kind).reshape(n, dim)
        self.graph = Graph(augmented(self.vectors), nodes, neighbours)
        self.ids, self.ends = np.frombuffer(row["ids"], np.int64), np.cumsum(np.frombuffer(row["id_counts"], np.int32))
        self.begins = np.append(0, self.ends[:-1])

    def nearest(self, q_ids: np.ndarray, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, found ids and scores of the ``k`` nearest rows of each query, scored in double precision."""
        found, _ = search(self.graph, q, ef)
        i, j = np.nonzero(found >= 0)
        node = found[i, j]
        score = np.einsum("ij,ij->i", q[i].astype(np.float64), self.vectors[node].astype(np.float64))
        times = (self.ends - self.begins)[node]
        at = np.repeat(self.begins[node] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        who, what, score = np.repeat(i, times), self.ids[at], np.repeat(score, times)
        keep = what != q_ids[who]
        who, what, score = who[keep], what[keep], score[keep]
        order = np.lexsort((what, -score, who))
        who, what, score = who[order], what[order], score[order]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < k
        return q_ids[who[keep]], what[keep], score[keep]


FOUND = "query_id long, vec_id long, score double"


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part: an id, and finite components that are not all zero."""
    ok = F.expr("vec_id IS NOT NULL AND size(embedding) > 0 AND exists(embedding, v -> v <> 0) AND "
                "forall(embedding, v -> coalesce(NOT isnan(v) AND abs(v) < double('infinity'), false))")
    kind = "array<float>" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "array<double>"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where(
        F.coalesce(ok, F.lit(False)))


def shard_count(rows: int, dim: int) -> int:
    """Shards of up to 16,384 vectors, and never more than 64 MB of them.

    Larger ones would be fewer for a query to visit, but a beam of one width finds less in them (see the README).
    """
    size = min(16_384, max((1 << 26) // (4 * max(dim, 1)), 1))
    return max(1, -(-rows // size))


def hnsw_index(rows: DataFrame, k: int, shards: int | None = None, salts: int = 64) -> tuple[DataFrame, int]:
    """Build one graph per shard over all ``rows`` (from ``valid_vectors``); returns the index table and its shards.

    Equal vectors become one node that keeps its ``k`` + 1 smallest ids, which is all that any answer can need; a
    vector that a third of all rows share is cut down in ``salts`` parts first. Shards are dealt by hash.
    """
    salted = Window.partitionBy("embedding", "salt").orderBy("vec_id")
    some = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).withColumn(
        "r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    distinct = saved(some.groupBy("embedding").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids")))
    if shards is None:
        n, dim = distinct.agg(F.count("*"), F.max(F.size("embedding"))).first()
        shards = shard_count(n, dim or 1)
    index = saved(distinct.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int")).repartition(shards, "shard").groupBy("shard").applyInArrow(
        _build_shard(_kind(rows)), INDEX))
    discard(distinct)
    return index, shards


def _kind(rows: DataFrame) -> type:
    return np.float32 if rows.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, ef: int = 192, shards: int | None = None) -> DataFrame:
    """The ``k`` nearest rows of each row whose vec_id is divisible by ``every``, among all other rows.

    A query is sent once to every shard; there the shard's graph comes first and its queries stream by, so neither is
    copied or gathered. A beam of ``ef`` nodes is scored again in double precision on the original vectors, and the
    best of each shard are merged.

    Returns ``query_id, rank, vec_id, score``, nearest first, ties to the smaller vec_id; fewer than ``k`` where there
    are fewer candidates. Rows without an id, and null, zero or non-finite vectors, take no part; shorter vectors
    count as ending in zeros; equal vectors and repeated rows are candidates of their own; an empty table gives no
    rows; other columns are dropped.
    """
    rows = valid_vectors(vectors)
    kind = _kind(rows)
    index, shards = hnsw_index(rows, k, shards)
    asked = rows.where(F.col("vec_id") % every == 0).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "vec_id", "embedding")
    stream = index.withColumn("query", F.lit(False)).unionByName(asked.withColumn("query", F.lit(True)), allowMissingColumns=True)
    stream = stream.repartition(shards, "shard").sortWithinPartitions("shard", "query")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = None, None
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            is_query = batch.column("query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, (numbers[1:] != numbers[:-1]) | ~is_query[1:] | ~is_query[:-1]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(numbers)]):
                part = batch.slice(a, b - a)
                if not is_query[a]:
                    shard, number = Shard(part.to_pylist()[0], kind), int(numbers[a])
                    continue
                if number != numbers[a]:
                    continue  # a shard without vectors
                for c in range(0, b - a, BATCH):
                    some = part.slice(c, BATCH)
                    out = shard.nearest(some.column("vec_id").to_numpy(), _matrix(some.column("embedding"), kind, shard.vectors.shape[1]), k, ef)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query_id", "vec_id", "score"])

    found = stream.mapInArrow(look, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score")
