"""Token counts of byte-level BPE by compiled finite-state transducers.

Two deterministic transducers are compiled from the tokenizer's file:

* the *cutter* reads code points and marks where the pre-tokenizer begins a piece. It has a dozen states, so a chunk's
  effect is a map from states to states; the maps of all chunks are composed by a parallel prefix scan, which gives
  every chunk its true first state;
* the *counter* reads a piece's bytes; each transition carries the number of tokens by which the piece's encoding
  grows (or shrinks, when bytes merge). Every state begins anew at a piece's start, so byte chunks cut there need no
  composing. Its states are compiled when first met.

All chunks of a batch advance together, one numpy step at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textbytes import clean
from .wordcache import BLANK, LETTER, NUMBER, SPACE, classes, code_points, cut_at_pieces

# Symbols of the cutter: the letters that can end a contraction stand apart.
S_LETTER, S_SHORT, S_RV, S_L, S_E, S_NUMBER, S_OTHER, S_QUOTE, S_BLANK, S_SPACE, S_END = range(11)
# States: nothing read; in letters, numbers, other characters; after one or more than one white space character, by
# the last (blank or not); after a quote that may begin a contraction, then after its r, v or l; after a contraction.
START, LETTERS, NUMBERS, OTHERS, BLANK1, SPACE1, BLANK2, SPACE2, QUOTE, QUOTE_RV, QUOTE_L, DONE = range(12)
STATES, SYMBOLS = 12, 11
HERE, BEFORE = 1, 2


def cutter_step(state: int, symbol: int) -> tuple[int, int]:
    """Next state, and whether a piece begins at this code point (HERE) or at the one before it (BEFORE)."""
    if state in (QUOTE_RV, QUOTE_L):
        if symbol == (S_E if state == QUOTE_RV else S_L):
            return DONE, 0
        then, begun = cutter_step(LETTERS, symbol)
        return then, begun | BEFORE
    if symbol == S_END:
        return START, 0
    if symbol in (S_BLANK, S_SPACE):
        blank = symbol == S_BLANK
        if state in (BLANK1, SPACE1, BLANK2, SPACE2):
            return (BLANK2 if blank else SPACE2), 0
        return (BLANK1 if blank else SPACE1), HERE
    begun = 0
    if state in (BLANK2, SPACE2):
        begun |= BEFORE
    joined = state in (BLANK1, BLANK2)
    if symbol == S_QUOTE and not joined and state not in (OTHERS, QUOTE):
        return QUOTE, begun | HERE
    if state == QUOTE:
        if symbol == S_SHORT:
            return DONE, 0
        if symbol == S_RV:
            return QUOTE_RV, 0
        if symbol == S_L:
            return QUOTE_L, 0
        state = OTHERS
    then = NUMBERS if symbol == S_NUMBER else OTHERS if symbol in (S_OTHER, S_QUOTE) else LETTERS
    if not joined and then != state:
        begun |= HERE
    return then, begun


@cache
def cutter() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transition and output tables, indexed by symbol * STATES + state, and the symbol of each code point."""
    steps = [cutter_step(state, symbol) for symbol in range(SYMBOLS) for state in range(STATES)]
    symbols = np.append(np.full(0x110000, S_OTHER, np.uint8), np.uint8(S_END))
    kinds = classes()
    for kind, symbol in ((LETTER, S_LETTER), (NUMBER, S_NUMBER), (BLANK, S_BLANK), (SPACE, S_SPACE)):
        symbols[:-1][kinds == kind] = symbol
    for letters, symbol in (("stmd", S_SHORT), ("rv", S_RV), ("l", S_L), ("e", S_E), ("'", S_QUOTE)):
        for c in letters:
            symbols[ord(c)] = symbol
    return np.array([s for s, _ in steps], np.uint8), np.array([o for _, o in steps], np.uint8), symbols


END_POINT = 0x110000


def scanned_starts(points: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """Piece starts among code points (END_POINT closes each text): chunk maps, prefix scan, then the outputs."""
    if not len(points):
        return np.zeros(0, bool)
    step, output, symbols = cutter()
    n = -(-len(points) // chunk)
    padded = np.full(n * chunk, END_POINT, np.uint32)
    padded[: len(points)] = points
    rows = np.ascontiguousarray(symbols[padded].reshape(n, chunk).T).astype(np.uint8) * np.uint8(STATES)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (n, 1))
    for row in rows:
        maps = step[row[:, None] + maps]
    reach = 1
    while reach < n:
        later = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        maps = np.concatenate([maps[:reach], later])
        reach *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)
    marks = np.empty((chunk, n), np.uint8)
    for i, row in enumerate(rows):
        at = row + state
        marks[i] = output[at]
        state = step[at]
    marks = marks.T.reshape(-1)
    starts = (marks & HERE) > 0
    starts[:-1] |= (marks[1:] & BEFORE) > 0
    return starts[: len(points)]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level files use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: A cell has 21 bits for a state.
STATE_LIMIT = 1 << 21


class Counter:
    """The counter, compiled state by state.

    After reading w, what matters for the future are the places where a token still to come may begin: the starts
    of suffixes of w that a longer token begins with. For each of them a state keeps the last token of the encoding
    that ends there, and how many tokens that encoding is short of the current one. The encoding of w then b ends
    with the one token t = suffix + b that is compatible with the last token before it, where two tokens are
    compatible when BPE leaves them apart. States are equal when those lists and the suffix are.
    """

    def __init__(self, path: str, limit: int = 250_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        plain = lambda s: bytes(alphabet[c] for c in s)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(plain(a), plain(b)): i for i, (a, b) in enumerate(pairs)}
        self.tokens = {plain(t) for t in spec["model"]["vocab"] if t not in self.specials}
        self.longer = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.limit = limit
        self.path = path
        self.reset()

    def reset(self) -> None:
        self.together: dict[tuple[bytes, bytes], bool] = {}
        self.states: list[tuple[bytes, tuple]] = []
        self.numbers: dict[tuple[bytes, tuple], int] = {}
        self.bits, self.filled = 16, 0
        self.cells = np.full(1 << self.bits, -1, np.int64)
        self.number((b"", ((0, None, 0),)))

    def number(self, state: tuple[bytes, tuple]) -> int:
        if state not in self.numbers:
            if len(self.states) >= STATE_LIMIT:
                raise OverflowError("too many states")
            self.numbers[state] = len(self.states)
            self.states.append(state)
        return self.numbers[state]

    # Transitions are one open-addressing table: a cell holds (state * 256 + byte), the next state and the tokens added.

    def store(self, cells: list[int]) -> None:
        self.filled += len(cells)
        if self.filled * 4 > len(self.cells):
            cells = [*cells, *self.cells[self.cells >= 0].tolist()]
            while self.filled * 4 > 1 << self.bits:
                self.bits += 1
            self.cells = np.full(1 << self.bits, -1, np.int64)
        mask = len(self.cells) - 1
        for cell, at in zip(cells, self.slots(np.array(cells, np.int64) >> 28).tolist()):
            while self.cells[at] >= 0:
                at = (at + 1) & mask
            self.cells[at] = cell

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def step(self, keys: np.ndarray) -> np.ndarray:
        """The cells of (state * 256 + byte), compiled where they are new."""
        at = self.slots(keys)
        found = self.cells[at]
        open_ = np.flatnonzero(found >> 28 != keys)
        new = []
        while len(open_):
            new.append(open_[found[open_] < 0])
            open_ = open_[found[open_] >= 0]
            at[open_] = (at[open_] + 1) & (len(self.cells) - 1)
            found[open_] = self.cells[at[open_]]
            open_ = open_[found[open_] >> 28 != keys[open_]]
        if new and len(new := np.concatenate(new)):
            self.store([self.compiled(*divmod(k, 256)) for k in np.unique(keys[new]).tolist()])
            found[new] = self.step(keys[new])
        return found

    def apart(self, left: bytes, right: bytes) -> bool:
        """Whether BPE of both tokens' bytes gives just these two tokens."""
        known = self.together.get((left, right))
        if known is None:
            parts = [bytes([b]) for b in left + right]
            get, none = self.ranks.get, len(self.ranks)
            while len(parts) > 1:
                rank, i = min((get(p, none), i) for i, p in enumerate(zip(parts, parts[1:])))
                if rank == none:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = self.together[left, right] = parts == [left, right]
        return known

    def compiled(self, number: int, byte: int) -> int:
        suffix, places = self.states[number]
        one = bytes([byte])
        for back, last, short in places:
            token = suffix[len(suffix) - back :] + one
            if token in self.tokens and (last is None or self.apart(last, token)):
                break
        else:
            raise ValueError("no token fits; this is not a byte-level BPE file")
        grown = short + 1
        kept = [(back + 1, before, lacks - grown) for back, before, lacks in places
                if suffix[len(suffix) - back :] + one in self.longer]
        reach = kept[0][0] if kept else 0
        state = ((suffix + one)[len(suffix) + 1 - reach :], (*kept, (0, token, 0)))
        if not 0 <= grown + 64 < 128:
            raise OverflowError("a token too many")
        return (number * 256 + byte) << 28 | self.number(state) << 7 | grown + 64

    def token_deltas(self, data: np.ndarray, starts: np.ndarray, lane: int = 1024) -> np.ndarray:
        """The tokens that each byte adds, for bytes of whole pieces whose first bytes are marked."""
        out = np.zeros(len(data), np.int16)
        if not len(data):
            return out
        if len(self.states) > self.limit:
            self.reset()
        first = np.flatnonzero(starts)
        goals = np.arange(0, len(data), lane)
        begins = np.unique(first[np.minimum(np.searchsorted(first, goals), len(first) - 1)])
        lengths = np.diff(np.append(begins, len(data)))
        order = np.argsort(-lengths, kind="stable")
        begins, lengths = begins[order], lengths[order]
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        state = np.zeros(len(begins), np.int64)
        fresh = ~starts
        for i, k in enumerate(active):
            at = begins[:k] + i
            cells = self.step(state[:k] * fresh[at] * 256 + data[at])
            out[at] = (cells & 127) - 64
            state[:k] = cells >> 7 & 0x1FFFFF
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, special strings inside counted as one token each.

        Where the states don't suffice, they are forgotten and the texts, or parts of a text, are counted by halves; a
        single piece that has more by itself is left to the library.
        """
        try:
            return self._counts(texts)
        except OverflowError:
            self.reset()
        if len(texts) > 1:
            half = len(texts) // 2
            return np.concatenate([self.counts(texts[:half]), self.counts(texts[half:])])
        parts, specials = self.parts(texts[0], max(len(texts[0]) // 2, 1))
        if len(parts) > 1:
            return np.array([specials + sum(int(self.counts([p])[0]) for p in parts)], np.int64)
        from tokenizers import Tokenizer

        return np.array([len(Tokenizer.from_file(self.path).encode(texts[0], add_special_tokens=False).ids)], np.int64)

    def parts(self, text: str, size: int) -> tuple[list[str], int]:
        """``text`` in parts of about ``size`` characters whose counts add up, and the special strings between them."""
        pieces = [text]
        for special in self.specials:
            pieces = [p for piece in pieces for p in piece.split(special)]
        return [p for piece in pieces for p in cut_at_pieces(piece, size)], len(pieces) - 1

    def _counts(self, texts: list[str]) -> np.ndarray:
        parts, owners = [], []
        extra = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            cut = [text]
            for special in self.specials:
                if special in text:
                    cut = [p for piece in cut for p in piece.split(special)]
            extra[i] = len(cut) - 1
            parts += cut
            owners += [i] * len(cut)
        points, bounds = code_points([p + "\0" for p in parts])
        points = points.copy()
        points[bounds[1:] - 1] = END_POINT
        starts = scanned_starts(points)
        inside = points != END_POINT
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        width[~inside] = 0
        byte_at = np.concatenate([[0], np.cumsum(width)])
        data = np.frombuffer("".join(parts).encode("utf-8", "surrogatepass"), np.uint8)
        marked = np.zeros(len(data), bool)
        marked[byte_at[:-1][starts & inside]] = True
        upto = np.concatenate([[0], np.cumsum(self.token_deltas(data, marked), dtype=np.int64)])
        per_part = upto[byte_at[bounds[1:]]] - upto[byte_at[bounds[:-1]]]
        return extra + np.bincount(owners, per_part, len(texts)).astype(np.int64)


@cache
def compiled(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, turn_chars: int = 2_000_000) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    Counts equal those of the tokenizers library without added special tokens; the strings of special tokens inside
    texts count as one token. A null text is empty (0 tokens); null ids and repeated rows are kept; an empty table
    gives no rows; other columns are dropped. Runs per row, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(tokenizer_path)
        for batch in batches:
            texts = clean(batch.column("text"))
            n = np.zeros(len(texts), np.int64)
            turn, owners, size = [], [], 0
            for i, text in enumerate(texts):
                parts, n[i] = counter.parts(text, turn_chars) if len(text) > turn_chars else ([text], 0)
                for part in parts:
                    turn.append(part)
                    owners.append(i)
                    size += len(part)
                    if size >= turn_chars:
                        np.add.at(n, owners, counter.counts(turn))
                        turn, owners, size = [], [], 0
            if turn:
                np.add.at(n, owners, counter.counts(turn))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()),
                                              pa.array(n > limit, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
