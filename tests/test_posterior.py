"""The posterior over allele pairs against brute force over the whole pair table."""

import math
import random
from collections import Counter, defaultdict

import pytest


def by_hand(rows, columns, ranks):
    pairs = [(i, j) for i in range(8) for j in range(i, 8)]
    z, weights = defaultdict(float), defaultdict(Counter)
    for read in range(12):
        for i, j in pairs:
            (a, pa), (b, pb) = rows[read, i], rows[read, j]
            z[i, j] += max(a, b)
            w = (1, 1) if a == b else (2, 0) if a > b else (0, 2)
            for side in (0, 1):
                if w[side]:
                    weights[i, j, side][pa if a >= b else pb] += w[side]
    best = sorted({round(v, 6) for v in z.values()}, reverse=True)[:ranks]
    scored = {}
    for p in pairs:
        if round(z[p], 6) in best:
            c = 0.0
            for side in (0, 1):
                ws = weights[(*p, side)].values()
                if ws:
                    n = sum(ws)
                    c += math.log10(math.factorial(n)) - n * math.log10(columns) - sum(math.log10(math.factorial(w)) for w in ws)
            scored[p] = z[p] + c
    top = max(scored.values())
    p = {k: 10 ** (v - top) for k, v in scored.items()}
    norm = sum(p.values()) + min(p.values()) * (len(pairs) - len(p))
    return {k: v / norm for k, v in p.items()}


def test_posterior_counts_the_pairs_that_were_cut(spark):
    from loomtype.operators.score import type_samples

    dice = random.Random(9)
    rows = {(r, a): (-dice.randrange(1, 5) / 4, dice.randrange(3)) for r in range(12) for a in range(7)}
    rows |= {(r, 7): rows[r, 6] for r in range(12)}  # alike, so that pairs tie
    data = [(r, "A", a, False, 1, llhd, pos, None) for (r, a), (llhd, pos) in rows.items()]
    scores = spark.createDataFrame(data, "read_id long, locus string, allele_id long, rc boolean, mate int, llhd double, pos long, filter_reason string")
    every = by_hand(rows, 300, 99)
    assert len(every) == 36
    for options, expected in (({"report": 3}, by_hand(rows, 300, 3)), ({"report": None}, every),
                              ({"least": 1e-3}, {k: v for k, v in every.items() if v > 1e-3})):
        got = {(r["i"], r["j"]): r["prob"] for r in type_samples(scores, 300, **options)["posterior"].collect()}
        assert got == pytest.approx(expected, rel=1e-6)


def test_every_pair_is_evaluated_without_a_row_for_each_score_and_pair(spark):
    from loomtype.operators import pairs as P

    dice = random.Random(4)
    data = [(r, "AB"[r % 2], a, -dice.randrange(1, 5) / 4, dice.randrange(3)) for r in range(30) for a in dice.sample(range(9), 4)]
    scores = spark.createDataFrame(data, "read_id long, locus string, allele_id long, llhd double, pos long")
    got = {(r["locus"], r["i"], r["j"]): (r["z"], r["reads"], r["c"]) for r in P.evaluated_pairs(scores, 300).collect()}
    z = P.pair_log_likelihood(scores)
    c = P.coverage_likelihood(P.pair_emissions(scores, z), 300)
    expected = {(r["locus"], r["i"], r["j"]): (r["z"], r["reads"], r["c"]) for r in z.join(c, ["locus", "i", "j"]).collect()}
    assert set(got) == set(expected)
    assert all(got[k] == pytest.approx(expected[k], abs=1e-9) for k in got)
    # the posterior of a table that has its coverage, and no window over a gene's pairs
    every = P.evaluated_pairs(scores, 300)
    probs = P.pair_posterior(every)
    assert "Window" not in probs._jdf.queryExecution().executedPlan().toString()
    assert {r["locus"]: round(r["p"], 9) for r in probs.groupBy("locus").agg({"prob": "sum"}).withColumnRenamed("sum(prob)", "p").collect()} == {"A": 1.0, "B": 1.0}
    old = P.pair_posterior(z, c)
    assert {(r["locus"], r["i"], r["j"]): round(r["prob"], 9) for r in old.collect()} == {(r["locus"], r["i"], r["j"]): round(r["prob"], 9) for r in probs.collect()}
