"""The byte model against a plain one of dictionaries, and against its base on held-out texts."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtype.llm import bytemodel as B

SCHEMA = "doc_id long, text string, held_out boolean, chunk long, n long"
SF = "/root/testdata/sf0.01"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


class Plain:
    """Contexts of bytes as dictionaries; escapes D / (2 N) with exclusion; shorter contexts count distinct longer ones."""

    def __init__(self, texts, order):
        self.order, self.tables = order, [{} for _ in range(order + 1)]
        for raw in texts:
            for k, (context, s) in enumerate(self.steps(raw)):
                self.tables[order].setdefault(context, Counter())[s] += 1
        for k in range(order - 1, -1, -1):
            for context, symbols in self.tables[k + 1].items():
                own = self.tables[k].setdefault(context[1:], Counter())
                for s in symbols:
                    own[s] += 1

    def steps(self, raw):
        padded = b"\n" * self.order + raw
        for i in range(len(raw)):
            yield padded[i : i + self.order], raw[i]

    def chances(self, context):
        """The probability of every byte behind ``context``."""
        out, left, known = {}, 1.0, set()
        for k in range(self.order, -1, -1):
            seen = self.tables[k].get(context[self.order - k :])
            if seen is None:
                continue
            own = {s: c for s, c in seen.items() if s not in known}
            n, d = sum(own.values()), len(own)
            if d:
                out |= {s: left * (c - 0.5) / n for s, c in own.items()}
                left *= d / (2 * n)
            known |= set(seen)
        return out | {s: left / (256 - len(known)) for s in range(256) if s not in known}

    def score(self, raw):
        return sum(math.log10(self.chances(context)[s]) for context, s in self.steps(raw))


def plain(rows, order):
    raw = [(" ".join(words_of(t)) + "\n").encode() for _, t, *_ in rows]
    model = Plain([x for x, r in zip(raw, rows) if not r[2]], order)
    counts = Counter(t for _, text, held, *_ in rows if not held for t in [*words_of(text), None])
    total, v = sum(counts.values()), len(counts)
    out = []
    for x, (i, text, held, *_) in zip(raw, rows):
        own = [*words_of(text), None]
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (v + 1))) for t in own)
        out.append((i, bool(held), len(own), sum(counts[t] > 0 for t in own), total, base, model.score(x)))
    return sorted(out)


def corpus(n=60):
    r = random.Random(5)
    words = ["the", "The", "thé", "of", "offer", "語の", "a", "zz" * 20, "x"]
    rows = [(i, r.choice([" ", "", "\n"]) + "".join(r.choice(words) + r.choice([" ", "\t", "\r\n ", "  "]) for _ in range(r.randrange(12))), i % 4 == 0, 7, 7) for i in range(n)]
    return rows + [(900, None, False, 0, 0), (901, "", True, 0, 0), (902, "new Ω\x00 words! " * 40, True, 0, 0), (903, "qqqq", None, 0, 0), rows[5], rows[4], rows[4]]


@pytest.mark.parametrize("order,chunk_bytes", [(3, 400), (5, 1 << 20), (6, 300)])
def test_scores_are_those_of_plain_dictionaries(spark, order, chunk_bytes):
    rows = corpus()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in B.language_scores(frame, F.col("held_out"), order, chunk_bytes).collect())
    expected = plain(rows, order)
    assert [x[:5] for x in got] == [x[:5] for x in expected]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in expected], rtol=1e-12)


def test_chances_behind_a_context_add_up_to_one():
    model = Plain([(" ".join(words_of(t)) + "\n").encode() for _, t, *_ in corpus()], 3)
    for context in (b"\n\n\n", b"the", b" of", b"???", b"e o"):
        assert abs(sum(model.chances(context).values()) - 1) < 1e-9


def test_edge_cases(spark):
    assert B.language_scores(spark.createDataFrame([], SCHEMA), F.col("held_out")).collect() == []
    rows = [(1, "abc", True, 0, 0), (2, None, True, 0, 0)]  # nothing to learn from
    got = sorted(tuple(r) for r in B.language_scores(spark.createDataFrame(rows, SCHEMA), F.col("held_out")).collect())
    assert [r[:5] for r in got] == [(1, True, 2, 0, 0), (2, True, 1, 0, 0)]
    assert np.allclose([r[6] for r in got], [-4 * math.log10(256), -math.log10(256)])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_texts_of_the_given_documents_beat_the_base(spark):
    rows = B.language_scores(spark.read.parquet(f"{SF}/documents.parquet"), B.held_out_by_crc()).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(r["score"] < 0 for r in rows)
