"""Alignment of two tokenizers over the same texts, and how often their tokens are linked corpus-wide.

Tokens of both are ranges of the same bytes. Each points to the token that overlaps it and reaches farthest to the
right; doubling these pointers leads every token to the last one of its connected component, where tokens of both
end together. That token labels the component: a group.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches
from .textbytes import runs
from .wordcache import WordIds


class PlainIds(WordIds):
    """Ids by a byte-level BPE; special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        self.specials = None


class SpacedIds(WordIds):
    """Ids by a sentencepiece model with a dummy blank before the text, for texts that have that blank already.

    A piece is a run of blanks with what follows up to the next blank. The model must leave texts as they are (no
    normalisation), and none of its tokens may have a blank behind another character: then no token crosses pieces.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        if any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(self.model.get_piece_size())):
            raise ValueError("a token has a blank inside; its texts cannot be cut at blanks")
        self.library, self.special_ids, self.specials, self.limit = self, {}, None, limit
        self.behind = len(self.model.encode("a"))
        self.forget()

    def encode_batch_fast(self, pieces: list[str], add_special_tokens: bool = False) -> list:
        """As the tokenizers library's, for pieces that begin with a blank (blanks alone are read behind a letter)."""
        blank = [not p.strip(" ") for p in pieces]
        got = self.model.encode(["a" + p if b else p[1:] for p, b in zip(pieces, blank)], num_threads=1)
        return [_Ids(ids[self.behind :] if b else ids) for ids, b in zip(got, blank)]

    def encode(self, texts: str | list[str], per_turn: int = 500_000, add_special_tokens: bool = False):
        if isinstance(texts, str):  # one text that the cache leaves to the library
            return self.encode_batch_fast([texts])[0]
        return super().encode(texts, per_turn)

    def starts(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        blank = points == 0x20
        first = np.zeros(len(points) + 1, bool)
        first[bounds] = True
        after = np.ones(len(points), bool)
        after[1:] = ~blank[:-1]
        return first[:-1] | (blank & after)

    def parts(self, text: str, size: int) -> Iterator[str]:
        at = 0
        while len(text) - at > size:
            to = text.find(" ", at + size)
            while to > 0 and text[to - 1] == " ":
                to = text.find(" ", to + 1)
            if to < 0:
                break
            yield text[at:to]
            at = to
        yield text[at:]


class _Ids:
    def __init__(self, ids: list[int]):
        self.ids = ids


def byte_level_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level BPE: printable characters stand for themselves, other bytes for those from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)
    out = [b""] * (1 + max([*vocabulary["model"]["vocab"].values(), *(t["id"] for t in vocabulary.get("added_tokens", []))]))
    for token, i in vocabulary["model"]["vocab"].items():
        out[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return out


def sentencepiece_tokens(model) -> list[bytes]:
    """The bytes of each id: U+2581 is a blank, <0xHH> a byte."""
    def one(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return [one(i) for i in range(model.get_piece_size())]


class Table:
    """The tokens' bytes end to end, and the digits of their ids."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.width = len(str(len(tokens)))
        self.digits = np.frombuffer("".join(f"{i:<{self.width}}" for i in range(len(tokens))).encode(), np.uint8).reshape(-1, self.width)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        return self.flat[np.repeat(self.starts[ids] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last token of each token's component: for A's tokens, for B's, as numbers of B's tokens.

    Ends ascend, and the last ones of both are equal. A component's last tokens are one of each; B's stands for it.
    """
    n = len(ends_a)
    over_a = np.searchsorted(ends_b, ends_a, "left")  # the token of B that holds A's last byte
    over_b = np.searchsorted(ends_a, ends_b, "left")
    own = n + np.arange(len(ends_b))
    point = np.concatenate([n + over_a, np.where(ends_a[over_b] > ends_b, over_b, own)])
    while True:
        further = point[point]
        if np.array_equal(further, point):
            return point[:n] - n, point[n:] - n
        point = further


def align(ids_a: list[np.ndarray], ids_b: list[np.ndarray], table_a: Table, table_b: Table, wanted: list[bytes]) -> dict[str, list]:
    """Per text: numbers of tokens, groups and links, digest of the groups, and the links as A's id times B's size plus B's id."""
    out = {"n_a": [0] * len(wanted), "n_b": [0] * len(wanted), "n_groups": [0] * len(wanted), "groups_sha256": [""] * len(wanted), "links": [[]] * len(wanted)}
    sizes = np.array([len(t) for t in wanted], np.int64)
    usable = np.array([len(t) > 1 for t in wanted], bool)
    for ids, table in ((ids_a, table_a), (ids_b, table_b)):
        usable &= np.array([int(table.lengths[x].sum()) for x in ids], np.int64) == sizes
    for ids, table in ((ids_a, table_a), (ids_b, table_b)):
        who = np.flatnonzero(usable)
        if not len(who):
            return out
        got = table.joined(np.concatenate([ids[i] for i in who]).astype(np.int64))
        same = got == np.frombuffer(b"".join(wanted[i] for i in who), np.uint8)
        usable[who] = np.logical_and.reduceat(same, np.cumsum(sizes[who]) - sizes[who])
    who = np.flatnonzero(usable)
    if not len(who):
        return out
    a, b = (np.concatenate([ids[i] for i in who]).astype(np.int64) for ids in (ids_a, ids_b))
    n_a, n_b = (np.array([len(ids[i]) for i in who]) for ids in (ids_a, ids_b))
    ends_a, ends_b = np.cumsum(table_a.lengths[a]), np.cumsum(table_b.lengths[b])
    last_a, last_b = terminals(ends_a, ends_b)
    is_last = np.zeros(len(b), bool)
    is_last[last_b] = True
    number = np.cumsum(is_last) - 1
    group_a, group_b = number[last_a], number[last_b]
    n = int(number[-1]) + 1
    links = a[np.searchsorted(ends_a, ends_b[is_last])] * len(table_b.lengths) + b[is_last]

    # tokens in the order of the text form: group by group, A's before B's
    upto_a, upto_b = np.cumsum(np.bincount(group_a, minlength=n)), np.cumsum(np.bincount(group_b, minlength=n))
    first_a, first_b = np.ones(len(a), bool), np.ones(len(b), bool)
    first_a[1:], first_b[1:] = group_a[1:] != group_a[:-1], group_b[1:] != group_b[:-1]
    text_a = np.cumsum(n_a) - n_a
    width = max(table_a.width, table_b.width)
    form = np.full((len(a) + len(b), 1 + width), 0x20, np.uint8)
    place = np.arange(len(a)) + np.concatenate([[0], upto_b])[group_a]
    form[place, 0] = np.where(first_a, ord(";"), ord(","))
    form[place[text_a], 0] = 0x20
    form[place, 1 : 1 + table_a.width] = table_a.digits[a]
    place = np.arange(len(b)) + upto_a[group_b]
    form[place, 0] = np.where(first_b, ord("|"), ord(","))
    form[place, 1 : 1 + table_b.width] = table_b.digits[b]
    filled = form != 0x20
    edges = np.concatenate([[0], np.cumsum(filled.sum(axis=1))])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    raw = form[filled].tobytes()
    groups = np.concatenate([[0], number[np.cumsum(n_b) - 1] + 1])
    for k, i in enumerate(who):
        out["n_a"][i], out["n_b"][i], out["n_groups"][i] = int(n_a[k]), int(n_b[k]), int(groups[k + 1] - groups[k])
        out["groups_sha256"][i] = sha256(raw[edges[k] : edges[k + 1]]).hexdigest()
        out["links"][i] = links[groups[k] : groups[k + 1]]
    return out


@cache
def _tokenizers(path_a: str, path_b: str) -> tuple[PlainIds, SpacedIds, Table, Table]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    a, b = PlainIds(path_a), SpacedIds(path_b)
    return a, b, Table(byte_level_tokens(path_a)), Table(sentencepiece_tokens(b.model))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups_sha256, links`` of each text, see ``align_tokens``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, table_a, table_b = _tokenizers(path_a, path_b)
        for batch in batches:
            for rows, texts in runs(batch, "text"):
                spaced = [" " + t if t else "" for t in texts]
                got = align(a.encode(spaced), b.encode(spaced), table_a, table_b, [t.encode() for t in spaced])
                counts = np.array([len(x) for x in got["links"]], np.int32)
                flat = np.concatenate(got["links"]).astype(np.int64) if counts.sum() else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), *(pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups")), pa.array(got["groups_sha256"]),
                     pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(flat))],
                    ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>")


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each text.

    A (a byte-level BPE) reads a blank and the text, B (a sentencepiece model) the text, before which it puts that
    blank. A link is a token of A and one of B that end together; a pair of ids counts as often as it is linked in all
    texts. ``n_best`` counts a text's links whose pair is the most frequent of its B id, ``count_sum`` adds their counts.

    Null and empty texts, and those that a tokenizer doesn't give back byte by byte, have no tokens: zeros and ''.
    Repeated rows count as often as they occur; empty tables give no rows; other columns are not read.

    The table of pairs is sent to all tasks. Its size is bound by the vocabularies, not by the texts: of two tokens
    that end together one ends the other, so there are at most twice as many pairs as both vocabularies have bytes.
    """
    spark = docs.sparkSession
    rows = saved(aligned(docs, path_a, path_b))
    counts = rows.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")).toArrow()
    pairs, of = counts["pair"].to_numpy(), counts["count"].to_numpy()
    order = np.argsort(pairs)
    pairs, of = pairs[order], of[order]
    n_b = len(_tokenizers(path_a, path_b)[3].lengths)
    top = np.zeros(n_b, np.int64)
    np.maximum.at(top, pairs % n_b, of)
    sent = spark.sparkContext.broadcast((pairs, of, of == top[pairs % n_b]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, of, best = sent.value
        for batch in batches:
            links = batch.column("links")
            at = np.searchsorted(pairs, links.flatten().to_numpy())
            ends = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))])
            total = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[ends]), pa.int64())
            own = {c: batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
            own |= {"n_links": pa.array(np.diff(ends), pa.int64()), "n_best": total(best[at]), "count_sum": total(of[at])}
            yield pa.RecordBatch.from_arrays([own[c] for c in COLUMNS], COLUMNS)

    return rows.mapInArrow(sums, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
