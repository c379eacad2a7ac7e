"""Token ids of whole texts by way of a cache of the pieces that the pre-tokenizer cuts.

Works on whole batches: numpy finds the pieces' borders and hashes, and the tokenizers library is asked once for
each distinct piece. A piece that is found by its hash is compared with the one that was encoded.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from itertools import chain

import numpy as np
import regex

LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)


@cache
def classes() -> np.ndarray:
    """Class of each code point: letter, number, other, the blank, other white space."""
    points = [chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000)]
    text = "".join(points)
    out = np.full(len(text), OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[m.start() : m.end()] = kind
    out[0xD800:0xE000] = OTHER
    out[0x20] = BLANK
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points end to end, and where each text begins (and the last ends)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def piece_starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where byte-level BPE's pre-tokenizer begins a piece, as a mask over ``points``.

    Whether a piece begins at a code point depends on it, its neighbours, and on an apostrophe at most three before:
    runs of one class form a piece with the blank before them; of a run of white space the last character stands
    apart when something follows; 's 't 'm 'd 're 've 'll form pieces unless the apostrophe belongs to a run.
    """
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    first = first[:n]
    if not n:
        return first
    gap = kind >= BLANK
    before = np.empty(n, np.uint8)
    before[0], before[1:] = BLANK, kind[:-1]
    gap_before = before >= BLANK
    filled_next = np.zeros(n, bool)
    filled_next[:-1] = ~gap[1:] & ~first[1:]
    starts = first | (gap & (~gap_before | filled_next)) | (~gap & (before == SPACE)) | (~gap & ~gap_before & (kind != before))

    quote = np.flatnonzero((points == 0x27) & (first | ((before != OTHER) & (before != BLANK))))
    if len(quote):
        end = bounds[np.searchsorted(bounds, quote, "right")]
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"]) & (quote + 1 < end)
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        long = np.any([(one == a) & (two == b) for a, b in pairs], axis=0) & (quote + 2 < end)
        long &= ~short
        starts[quote[short | long] + 1] = False
        after = np.concatenate([quote[short] + 2, quote[long] + 3])
        ends = np.concatenate([end[short], end[long]])
        starts[after[after < ends]] = True
    return starts


def cut_at_pieces(text: str, size: int) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut where a piece begins.

    Not between white space and what follows it: there the end of a part would join what the text keeps apart. ``text``
    holds no special token's string.
    """
    at, width = 0, size
    while len(text) - at > width:
        window = text[at : at + width + 8]
        points, bounds = code_points([window])
        gap = classes()[points] >= BLANK
        fit = piece_starts(points, bounds)
        fit[1:] &= gap[1:] | ~gap[:-1]
        starts = np.flatnonzero(fit[: width + 1])
        if len(starts) > 1:
            yield text[at : at + int(starts[-1])]
            at, width = at + int(starts[-1]), size
        else:
            width *= 2
    yield text[at:]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LONG = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of ``data`` (bytes, with at least eight more behind the last span).

    A span's eight-byte words are mixed in one after the other, its length first; spans of ``LONG`` bytes or more are
    hashed by BLAKE2b. Neither is linear in the bytes, so repetitive texts collide no more than others.
    """
    lengths = ends - starts
    words = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
    out = lengths.astype(np.uint64) * _STEP
    at, left, who = starts, lengths, np.flatnonzero(lengths < LONG)
    if len(who) < len(starts):
        for i in np.flatnonzero(lengths >= LONG).tolist():
            out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        at, left = starts[who], lengths[who]
    state = out[who]
    while len(who):
        chunk = words[at]
        short = left < 8
        chunk[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        state = mixed((state ^ chunk) * _STEP + np.uint64(1))
        out[who] = state
        more = left > 8
        at, left, who, state = at[more] + 8, left[more] - 8, who[more], state[more]
    return out


def _appended(store: np.ndarray, used: int, more: np.ndarray) -> tuple[np.ndarray, int]:
    """``store`` with ``more`` behind its first ``used`` rows, grown by half or more where it is full, and what is used."""
    if used + len(more) > len(store):
        grown = np.zeros((max(len(store) // 2, len(more)), *store.shape[1:]), store.dtype)
        store = np.concatenate([store[:used], grown])
    store[used : used + len(more)] = more
    return store, used + len(more)


class WordIds:
    """Encodes texts with the tokenizers library, asking it only once for each distinct piece.

    Merges never cross pieces, so a text's ids are its pieces' ids in order, and a text may be cut where a piece
    begins. Special tokens' strings stand for their ids. Every piece is compared with the cached piece of its hash;
    a text with a piece of which the hash is taken goes to the library. Known pieces are dropped when there are more
    than ``limit``; that changes the speed, never the ids.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            specials = {t["content"]: t["id"] for t in json.load(file).get("added_tokens", [])}
        self.special_ids = specials
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(specials, key=len, reverse=True))) if specials else None
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # in the order of hashes
        # by row: first id, number of ids, first byte, number of bytes
        self.known, self.n_known = np.zeros((1 << 14, 4), np.int64), 0
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self.bytes, self.n_bytes = np.zeros(1 << 16, np.uint8), 0

    def learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Encode new pieces, given in the order of their hashes."""
        got = [e.ids for e in self.library.encode_batch_fast([p.decode("utf-8", "surrogatepass") for p in pieces], add_special_tokens=False)]
        counts = np.array([len(x) for x in got], np.int64)
        widths = np.array([len(x) for x in pieces], np.int64)
        new = np.stack([self.n_ids + np.cumsum(counts) - counts, counts, self.n_bytes + np.cumsum(widths) - widths, widths], axis=1)
        self.ids, self.n_ids = _appended(self.ids, self.n_ids, np.fromiter(chain.from_iterable(got), np.uint32, counts.sum()))
        self.bytes, self.n_bytes = _appended(self.bytes, self.n_bytes, np.frombuffer(b"".join(pieces), np.uint8))
        at = np.searchsorted(self.hashes, hashes)
        self.rows = np.insert(self.rows, at, np.arange(self.n_known, self.n_known + len(new), dtype=np.int32))
        self.hashes = np.insert(self.hashes, at, hashes)
        self.known, self.n_known = _appended(self.known, self.n_known, new)

    def taken(self, known: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The pieces that are not the cached ones that their hashes led to. Eight bytes' hash has no other preimage of that length."""
        widths = ends - starts
        differs = known[:, 3] != widths
        long = np.flatnonzero((widths > 8) & ~differs)
        if len(long):
            widths = widths[long]
            step = np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths)
            other = self.bytes[np.repeat(known[long, 2], widths) + step] != data[np.repeat(starts[long], widths) + step]
            differs[long] = np.bitwise_or.reduceat(other, np.cumsum(widths) - widths)
        return np.flatnonzero(differs)

    def starts(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pieces begin, as a mask over ``points``."""
        return piece_starts(points, bounds)

    def parts(self, text: str, size: int) -> Iterator[str]:
        """``text`` in parts that may be encoded apart."""
        return cut_at_pieces(text, size)

    def encode_turn(self, texts: list[str]) -> list[np.ndarray]:
        points, bounds = code_points(texts)
        starts = np.flatnonzero(self.starts(points, bounds))
        raw = "".join(texts).encode("utf-8", "surrogatepass")
        data = np.frombuffer(raw + bytes(8), np.uint8)
        places = starts
        if len(raw) != len(points):
            width = 1 + (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)
            places = (np.cumsum(width, dtype=np.int64) - width)[starts]
        ends = np.append(places[1:], len(raw))
        hashes = span_hashes(data, places, ends)
        known, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > self.limit:
            self.forget()
        at = np.searchsorted(self.hashes, known)
        new = np.ones(len(known), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != known[inside]
        if new.any():
            self.learn(known[new], [raw[places[i] : ends[i]] for i in where[new]])
            at = np.searchsorted(self.hashes, known)
        rows = self.known[self.rows[at]][back]
        counts = rows[:, 1]
        upto = np.cumsum(counts)
        flat = self.ids[np.repeat(rows[:, 0] - (upto - counts), counts) + np.arange(upto[-1] if len(upto) else 0)]
        firsts = np.searchsorted(starts, bounds)
        edge = np.concatenate([[0], upto])[firsts]
        out = [flat[a:b] for a, b in zip(edge[:-1], edge[1:])]
        for i in np.unique(np.searchsorted(firsts, self.taken(rows, data, places, ends), "right") - 1).tolist():
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out

    def encode(self, texts: list[str], per_turn: int = 500_000) -> list[np.ndarray]:
        """Ids of each text, from turns of about ``per_turn`` characters; long texts are cut."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        turn: list[str] = []
        slots: list[tuple[list, int]] = []
        size = 0

        def finish() -> None:
            for (own, k), ids in zip(slots, self.encode_turn(turn)):
                own[k] = ids
            turn.clear()
            slots.clear()

        for own, text in zip(out, texts):
            at = 0
            for m in [*(self.specials.finditer(text) if self.specials else ()), None]:
                for part in self.parts(text[at : m.start() if m else len(text)], per_turn):
                    turn.append(part)
                    slots.append((own, len(own)))
                    own.append(None)
                    size += len(part)
                    if size >= per_turn:
                        finish()
                        size = 0
                if m:
                    own.append(np.array([self.special_ids[m[0]]], np.uint32))
                    at = m.end()
        if turn:
            finish()
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]
