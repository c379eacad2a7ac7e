"""Mined phrases against a plain count of all of them."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomtype.llm import phrases
from loomtype.llm.common import saved
from loomtype.llm.phrases import SCORE, collocations, frequent_phrases

SCHEMA = "doc_id long, text string, lang string, key long, n long"


def plain_counts(rows):
    counts = {}
    for _, text, lang, *_ in rows:
        own = counts.setdefault(lang or "und", Counter())
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall(r"[^ \t]+", piece)
            for k in range(1, 6):
                own.update((k, " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    return counts


def plain(rows, support, first):
    out = []
    for lang, f in plain_counts(rows).items():
        n = sum(c for (k, _), c in f.items() if k == 1)
        found = {p: c for (k, p), c in f.items() if k > 1 and c >= support}
        kept = []
        for p, a in found.items():
            w = p.split(" ")
            score, k = min((1000 * a * n // (f[k, " ".join(w[:k])] * f[len(w) - k, " ".join(w[k:])]), k) for k in range(1, len(w)))
            if not any(c >= a and q != p and f" {p} " in f" {q} " for q, c in found.items()):
                kept.append((-score, -a, p.encode(), p, f[k, " ".join(w[:k])], f[len(w) - k, " ".join(w[k:])]))
        out += [(lang, i + 1, p, -a, left, right, n, -score) for i, (score, a, _, p, left, right) in enumerate(sorted(kept)[:first])]
    return sorted(out)


def corpus(seed=1, n=300):
    r = random.Random(seed)
    words = ["a", "B", "cé", "d", "e", "the", "of", "語", "x" * 70]
    rows = []
    for i in range(n):
        text = "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r"]) for _ in range(r.randrange(30)))
        rows.append((i, text, r.choice(["en", "de", None, "und"]), 0, 0))
    rows += [(900, None, "en", 0, 0), (901, "", None, 0, 0), (902, "a b " * 400, "en", 0, 0), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("shard_bytes", [500, 1 << 25])
@pytest.mark.parametrize("support", [1, 12, 100])
def test_collocations_are_those_of_a_plain_count(spark, shard_bytes, support):
    rows = corpus()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in collocations(frame, support, first=40, shard_bytes=shard_bytes).collect())
    assert got and got == plain(rows, support, 40)


def test_counts_of_all_lengths_and_of_words(spark):
    rows = corpus(2, 80)
    got = {(r["lang"], r["size"], r["phrase"]): r["f"] for r in frequent_phrases(spark.createDataFrame(rows, SCHEMA), 5, shard_bytes=400).collect()}
    expected = {(lang, k, p): c for lang, f in plain_counts(rows).items() for (k, p), c in f.items() if c >= 5}
    words = {(lang, 0, ""): sum(c for (k, _), c in f.items() if k == 1) for lang, f in plain_counts(rows).items()}
    assert {k: v for k, v in got.items() if k[1]} == expected
    assert all(words[k] == v for k, v in got.items() if not k[1]) and len(expected) > 50


def test_products_beyond_64_bits_are_exact(spark):
    rows = [(10**12, 10**12 + 7, 10**12 + 1, 3 * 10**14), (123456789012, 10**9 + 7, 123456789013, 98765432109876), (100, 100, 100, 10**14)]
    got = spark.createDataFrame(rows, "a long, l long, r long, n long").select("a", "l", "r", "n", F.expr(SCORE).alias("s")).collect()
    assert all(x["s"] == 1000 * x["a"] * x["n"] // (x["l"] * x["r"]) for x in got)


def test_empty_tables_and_texts_give_no_rows(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations(spark.createDataFrame([(1, None, None, 0, 0), (2, " . ", "en", 0, 0)], SCHEMA), 1).collect() == []


def test_shards_of_a_low_support_write_few_rows(spark, monkeypatch):
    """Phrases that are rare in all texts are not written for each shard that has them; a text comes from few shards."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choice(words) for _ in range(100)) + ".", "en", 0, 0) for i in range(400)]
    written = []

    def counted(frame):
        out = saved(frame)
        written.append(out.count())
        return out

    monkeypatch.setattr(phrases, "saved", counted)
    got = {(x["size"], x["phrase"]): x["f"] for x in frequent_phrases(spark.createDataFrame(rows, SCHEMA), 100, shard_bytes=1000).collect()}
    expected = {k: c for k, c in plain_counts(rows)["en"].items() if c >= 100}
    assert {k: v for k, v in got.items() if k[0]} == expected and len(expected) == 60
    assert sum(written) < 40_000 < sum(len(c) for c in plain_counts(rows).values())
