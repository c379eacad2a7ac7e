"""Slices along the alleles' paths against a walk, letter by letter."""

import random

import pytest

from loomtype.operators import graph as G
from loomtype.operators.msa import GROUP


def _walk(cells, start, begin, stop, length, pad, marks):
    """``cells`` are an allele's (pos, state, ch, region), known ones only; None where it has no row."""
    cells = [c for c in cells if (start is None or c[0] >= start) and (stop is None or c[0] < stop)]
    first = next((c[0] for c in cells if c[1] == "base"), None)
    if first is None:
        return None
    out, before = "", None
    for pos, state, ch, region in cells:
        if start is not None and pos < first:
            continue
        if before is not None and pos != before[0] + 1:
            if start is not None:
                break
            before = None
        if marks and before is not None:
            out += "|" * (region - before[1])
        out += ch if state == "base" else ""
        before = (pos, region)
    if start is not None and begin == "at" and first != start:
        return (None,)
    if start is not None and begin == "pad":
        out = "." * (first - start) + out
    if length is not None:
        out = out[:length].ljust(length, ".") if pad else out[:length]
    return (out,)


@pytest.fixture(scope="module")
def alleles(spark):
    draw, rows, cells = random.Random(5), [], {}
    for a in range(40):
        state = "base"
        for pos in range(30):
            if draw.random() < 0.25:
                state = draw.choice(["base", "gap", "unknown"])
            if a == 7:
                state = "unknown"
            if a == 8:
                state = "gap"
            row = (pos, state, draw.choice("ACGT") if state == "base" else "." if state == "gap" else "*", pos // 6)
            rows.append(("A", "nuc", f"D{a}", *row))
            if state != "unknown":
                cells.setdefault(f"D{a}", []).append(row)
    frame = spark.createDataFrame(rows, "locus string, source string, allele string, pos int, state string, ch string, region_ix int")
    return frame.repartition(4), cells


@pytest.mark.parametrize("options", [
    {}, {"marks": True}, {"start": 5}, {"start": 5, "stop": 17, "marks": True}, {"start": 5, "begin": "next", "length": 4}, {"start": 5, "begin": "next", "length": 9, "marks": True},
    {"start": 5, "begin": "pad", "length": 12, "pad": True}, {"start": 0, "begin": "pad"}, {"length": 7, "marks": True}, {"stop": 9}, {"start": 29, "begin": "next"}, {"start": 40}])
def test_slices_follow_the_path(alleles, options):
    frame, cells = alleles
    assert set(GROUP) <= set(frame.columns)
    o = {"start": None, "begin": "at", "stop": None, "length": None, "pad": False, "marks": False} | options
    expected = {a: x[0] for a, c in cells.items() if (x := _walk(c, **o)) is not None}
    rows = G.allele_slices(frame, **options).collect()
    assert {r["allele"]: r["seq"] for r in rows} == expected and len(rows) == len(expected)


def test_slices_that_make_no_sense_are_refused(alleles):
    for options in ({"begin": "near"}, {"stop": 3, "length": 4}, {"pad": True}):
        with pytest.raises(ValueError):
            G.allele_slices(alleles[0], **options)


def test_streams_give_what_their_letters_give(spark):
    """Spans, sequences, distances and variability of resolved streams, without a row for each letter."""
    from loomtype.operators import msa as M

    draw, rows = random.Random(8), []
    for locus, start in (("A", 1), ("B", -3)):
        for a in range(12):
            stream = "".join("|" if draw.random() < 0.1 else draw.choice("ACGT.**" if a == 0 else "ACGT--.*" if a % 3 else "ACGT--.") for _ in range(40 - a))
            rows.append((locus, "nuc", f"D{a}", a == 0, start + (a == 5) * 2, stream))
    rows.append(("A", "nuc", "D99", False, 1, "***|**"))
    rows += [("C", "nuc", "D1", True, 1, "ACGT"), ("C", "nuc", "D2", False, 1, "----"), ("E", "nuc", "D1", True, 1, "**")]  # nothing differs, nothing is known
    streams = spark.createDataFrame(rows, "locus string, source string, allele string, is_ref boolean, start_pos int, stream string").repartition(3)
    letters, whole = M.resolve_to_reference(M.parse_streams(streams)), M.resolve_streams(streams)
    assert all("Exchange hash" not in f(whole)._jdf.queryExecution().executedPlan().toString() for f in (G.bounds, M.allele_sequences))
    swap = lambda own, other: own.isin("A", "G") & other.isin("A", "G")
    for f in (G.bounds, M.allele_sequences, lambda x: M.allele_sequences(x, by_region=True), lambda x: M.allele_sequences(x, boundary="|"), M.segment_distance_to_reference,
              lambda x: M.segment_distance_to_reference(x, swap), M.region_variability, lambda x: M.region_variability(x, False, False)):
        one, two = f(letters), f(whole)
        assert one.count() and sorted(map(str, one.select(*two.columns).collect())) == sorted(map(str, two.collect()))
    with pytest.raises(Exception, match="wrong letter"):
        M.resolve_streams(spark.createDataFrame([("A", "nuc", "D1", True, 1, "AC-T")], streams.schema)).collect()
