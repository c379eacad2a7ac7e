"""The alignment of two tokenizers against a plain walk over the libraries' own ids."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest

from loomtype.llm import crosstokens as C
from loomtype.llm.queries import tokenizer_path

PATHS = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   ", "a", "a  b ", "\n", "x\t y\n\n z", "<s> <|endoftext|> hi </s> <0x41>", "a▁b  c", "日本語 のテスト  ﬁ Ⅷ", "ab" * 3000, "word " * 2000,
    "don't we've they'll 'tis", "é́ é  x", "🙂🙂 ok", "The same text. " * 30, "The same text. " * 30, "\x00\x01 \x7f", "xyz" * 5 + " " * 40 + "q"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PATHS[1])


def plain(rows, libraries):
    a, b = libraries
    bytes_a, bytes_b = C.byte_level_tokens(PATHS[0]), C.sentencepiece_tokens(b)
    found, counts = {}, Counter()
    for i, text in rows:
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids if text else [], b.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(bytes_a[x] for x in ids_a) != whole or b"".join(bytes_b[x] for x in ids_b) != whole:
            ids_a, ids_b = [], []
        ends_a, ends_b = {}, {}
        for ids, table, ends in ((ids_a, bytes_a, ends_a), (ids_b, bytes_b, ends_b)):
            at = 0
            for k, x in enumerate(ids):
                at += len(table[x])
                ends[at] = k
        groups, links, fa, fb = [], [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            groups.append(",".join(map(str, ids_a[fa : ends_a[e] + 1])) + "|" + ",".join(map(str, ids_b[fb : ends_b[e] + 1])))
            links.append((ids_a[ends_a[e]], ids_b[ends_b[e]]))
            fa, fb = ends_a[e] + 1, ends_b[e] + 1
        counts.update(links)
        found.setdefault(i, []).append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    top = Counter()
    for (_, y), c in counts.items():
        top[y] = max(top[y], c)
    return sorted((i, n_a, n_b, g, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha)
                  for i, rows in found.items() for n_a, n_b, g, links, sha in rows)


def test_rows_are_those_of_a_plain_walk(spark, libraries):
    rows = [*enumerate(TEXTS), (3, "   "), (4, "a")]
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id int, text string, links int, n_a string").repartition(3)
    assert sorted(tuple(r) for r in C.align_tokens(frame, *PATHS).collect()) == plain(rows, libraries)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_given_documents(spark, libraries):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    assert sorted(tuple(r) for r in C.align_tokens(frame, *PATHS).collect()) == plain(rows, libraries)


def test_a_long_text_is_cut_without_effect(libraries):
    b = C.SpacedIds(PATHS[1])
    text = ("some words  and   blanks, " * 400 + " " * 50 + "z" * 3000) * 2
    assert list(b.encode([" " + text], per_turn=700)[0]) == libraries[1].encode(text)


def test_pointers_lead_to_the_last_token_of_each_component():
    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(1, 60))
        ends = [np.unique(np.append(r.integers(1, n + 1, int(r.integers(1, n + 1))), n)) for _ in range(2)]
        got_a, got_b = C.terminals(*ends)
        common = np.intersect1d(*ends)
        for got, own in ((got_a, ends[0]), (got_b, ends[1])):
            assert np.array_equal(ends[1][got], common[np.searchsorted(common, own)])


def test_no_rows(spark):
    assert C.align_tokens(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []
