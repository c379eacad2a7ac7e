"""Qualities, probabilities, sequences and small texts as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NUCLEOTIDES, AMINO_ACIDS = "ACGTN", "ACDEFGHIKLMNPQRSTVWY"  # fixed values: the letters of alignments


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def phred(qual: Column) -> Column:
    """Phred scores of a quality string (offset 33)."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def phred_valid(qual: Column) -> Column:
    return qual.rlike("^[!-~]*$")


def phred_prob(qual: Column) -> Column:
    return F.transform(phred(qual), lambda q: F.pow(F.lit(10.0), -q / 10))


def phred_log10(qual: Column) -> Column:
    return F.transform(phred(qual), lambda q: q / F.lit(-10.0))


def letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def phred_log_likelihood(one: Column, two: Column, errors: Column) -> Column:
    """Natural-log likelihood of two equal-length strings: ln(1-p) where they agree, else ln(p/3)."""
    cells = F.arrays_zip(letters(one).alias("a"), letters(two).alias("b"), errors.alias("p"))
    return F.aggregate(cells, F.lit(0.0), lambda s, x: s + F.when(x["a"] == x["b"], F.log1p(-x["p"])).otherwise(F.log(x["p"] / 3)))


def mismatch_log_likelihood(length: Column, mismatches: Column, alphabet: int = 4, error: float = 0.01) -> Column:
    return (length - mismatches) * F.lit(math.log(1 - error)) + mismatches * F.lit(math.log(error / (alphabet - 1)))


def mismatch_indices(one: Column, two: Column) -> Column:
    """Zero-based indices at which two strings differ, over the shorter one's length."""
    pairs = F.zip_with(letters(one), letters(two), lambda a, b: (a != b) & a.isNotNull() & b.isNotNull())
    return F.filter(F.transform(pairs, lambda differs, i: F.when(differs, i)), lambda i: i.isNotNull())


def valid_letter(letter: Column, kind: str) -> Column:
    return letter.rlike(f"^[{AMINO_ACIDS if kind == 'protein' else NUCLEOTIDES}]$")


def log10_add(a: Column, b: Column) -> Column:
    """log10(10^a + 10^b); minus infinity (here also null) is neutral."""
    low = F.lit(float("-inf"))
    a, b = F.coalesce(a, low), F.coalesce(b, low)
    top = F.greatest(a, b)
    return F.when(top == low, low).otherwise(top + F.log10(F.lit(1.0) + F.pow(F.lit(10.0), F.least(a, b) - top)))


def log10_one_minus(a: Column) -> Column:
    return F.log10(F.lit(1.0) - F.pow(F.lit(10.0), a))


def ln_add(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return top + F.log1p(F.exp(F.least(a, b) - top))


def log10_sum(values: str | Column):
    """Aggregate: log10 of the sum of 10^x, by the largest; use as ``log10_sum("x")`` in agg over grouped arrays."""
    xs = F.collect_list(values)
    top = F.array_max(xs)
    return top + F.log10(F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.pow(F.lit(10.0), x - top)))


def close_enough(a: Column, b: Column, dx: float = 1e-6) -> Column:
    return (F.isnan(a) & F.isnan(b)) | (~F.isnan(a) & ~F.isnan(b) & (F.abs(a - b) < dx))


def gap_aware(value: Column) -> Column:
    """Sort key in which NaN (a gap) is smallest."""
    return F.nanvl(value, F.lit(float("-inf")))


def floor_precision(value: Column, digits: int) -> Column:
    return F.floor(value * 10**digits) / F.lit(float(10**digits))


def region_label(kind: Column, n: Column, short: bool = False) -> Column:
    inner = F.when(kind == "Exon", F.lit("X" if short else "Exon ")).otherwise(F.lit("I" if short else "Intron "))
    outer = F.replace(kind, F.lit("UTR"), F.lit("U")) if short else kind
    return F.when(kind.isin("UTR5", "UTR3"), outer).otherwise(F.concat(inner, n.cast("string")))


def short_seq(seq: Column) -> Column:
    return F.when(F.length(seq) > 10, F.concat(F.substring(seq, 1, 4), F.lit("..."), F.right(seq, F.lit(3)))).otherwise(seq)


def pair_index(i: Column, j: Column, n: Column, diagonal: bool = True) -> Column:
    """Place of (i, j), i <= j (or i < j), in the rows of an upper triangle."""
    row = i * (n if diagonal else n - 1) - (i * (i - 1)) / 2
    return (row + j - i - (0 if diagonal else 1)).cast("long")


def pair_of_index(k: Column, n: Column, diagonal: bool = True) -> Column:
    """struct(i, j) of a place in the upper triangle; the inverse of ``pair_index``, exact up to 2^25 alleles."""
    rows = n if diagonal else n - 1
    left = rows * (rows + 1) / 2 - k - 1
    i = (rows - 1 - F.floor((F.sqrt(8 * left + 1) - 1) / 2)).cast("long")
    begin = (i * rows - i * (i - 1) / 2).cast("long")
    j = (k - begin + i + (0 if diagonal else 1)).cast("long")
    return F.struct(i.alias("i"), j.alias("j"))


def alteration_text(donor: Column, why: Column, distance: Column, segments: Column) -> Column:
    """``donor why (d: x) positions: [X2:full:a,b);...`` for segments of struct(full, region, start, end)."""
    shown = F.transform(segments, lambda s: F.format_string("[%s:%s:%d,%d)", s["region"], F.when(s["full"], F.lit("full")).otherwise(F.lit("partial")), s["start"], s["end"]))
    return F.format_string("%s %s (d: %.6f) positions: [%s]", donor, why, distance, F.array_join(shown, ";"))
