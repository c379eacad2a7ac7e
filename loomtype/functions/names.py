"""Allele names as columns: parsing, order, distance, diploids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The known genes, groups of them, genes for which imputing and merging is supported, the suffix
# letters, and the splice variants that are left out of merged alignments.
LOCI = ("A B C DMA DMB DOA DOB DPA1 DPA2 DPB1 DPB2 DQA1 DQB1 DRA DRB1 DRB3 DRB4 E F G HFE H J K L MICA MICB N P "
        "TAP1 TAP2 S T U V W Y").split()
LOCUS_GROUPS = {"ClassI": "A B C".split(), "FullClassI": "A B C E F G H J K L N P S T U V W".split()}
SUPPORTED_LOCI = "A B C E F G HFE H J K L MICA MICB P TAP1 TAP2 T V W Y".split()
SUFFIXES = "NLSCAQ"
SPLICE_VARIANTS = {
    "A": ["A*01:11N", "A*29:01:01:02N", "A*26:01:01:03N", "A*03:01:01:02N"],
    "B": ["B*15:01:01:02N", "B*44:02:01:02S", "B*07:44N"],
    "C": ["C*04:09N"], "E": [], "F": [], "G": [], "H": [], "J": [], "K": [], "L": [], "T": [], "V": [], "W": [],
}

FIELDS = ("f1", "f2", "f3", "f4")
_RESOLUTION = rf"^(\d+)(?::(\d+))?(?::(\d+))?(?::(\d+))?([{SUFFIXES}])?$"


def parse_locus(name: Column) -> Column:
    """The gene, or null where it is not a known one."""
    return F.when(name.isin(LOCI), name)


def locus_in_group(locus: Column, group: str) -> Column:
    return locus.isin(LOCUS_GROUPS[group])


def locus_supported(locus: Column) -> Column:
    return locus.isin(SUPPORTED_LOCI)


def trim_suffix(text: Column) -> Column:
    """struct(rest, suffix); null where the last character is neither a digit nor a suffix letter."""
    last = F.right(text, F.lit(1))
    return F.when(last.rlike(f"[{SUFFIXES}]"), F.struct(F.regexp_replace(text, ".$", "").alias("rest"), last.alias("suffix"))).when(
        last.rlike("[0-9]"), F.struct(text.alias("rest"), F.lit(None).cast("string").alias("suffix")))


def parse_resolution(text: Column) -> Column:
    """struct(f1..f4, suffix) of one to four positive numbers (absent: 0); null where it is none."""
    parts = [F.regexp_extract(text, _RESOLUTION, i) for i in range(1, 5)]
    fields = [F.coalesce(F.nullif(p, F.lit("")).cast("int"), F.lit(0)).alias(n) for n, p in zip(FIELDS, parts)]
    positive = F.lit(True)
    for p in parts:
        positive = positive & ((p == "") | (p.cast("int") > 0))
    suffix = F.nullif(F.regexp_extract(text, _RESOLUTION, 5), F.lit("")).alias("suffix")
    return F.when(text.rlike(_RESOLUTION) & positive, F.struct(*fields, suffix))


def parse_allele(text: Column) -> Column:
    """struct(locus, f1..f4, suffix) of ``LOCUS*f1[:f2[:f3[:f4]]][suffix]``; null where the name is wrong."""
    locus = parse_locus(F.regexp_extract(text, r"^([^*]+)\*[^*]+$", 1))
    rest = parse_resolution(F.regexp_extract(text, r"^[^*]+\*([^*]+)$", 1))
    return F.when(locus.isNotNull() & rest.isNotNull(), F.struct(
        locus.alias("locus"), *[rest[f].alias(f) for f in FIELDS], rest["suffix"].alias("suffix")))


def order_key(name: Column) -> Column:
    """Sort key of a parsed name: the numbers, absent ones first, suffixes ignored."""
    return F.struct(*[name[f].alias(f) for f in FIELDS])


def format_allele(name: Column, locus: Column | None = None, suffix: bool = True) -> Column:
    numbers = [F.when(name[f] > 0, F.lpad(name[f].cast("string"), F.greatest(F.lit(2), F.length(name[f].cast("string"))), F.lit("0")))
               for f in FIELDS]
    text = F.concat_ws(":", *numbers)
    if locus is not None:
        text = F.concat(locus, F.lit("*"), text)
    return F.concat(text, F.coalesce(name["suffix"], F.lit(""))) if suffix else text


def reduce_two(name: Column) -> Column:
    zero = F.lit(0)
    return F.struct(name["f1"].alias("f1"), name["f2"].alias("f2"), zero.alias("f3"), zero.alias("f4"))


def two_matches_full(two: Column, full: Column) -> Column:
    """Whether a two-field name agrees with another's first two; null where the first has not just two fields."""
    only_two = (two["f2"] > 0) & (two["f3"] == 0) & (two["f4"] == 0)
    return F.when(only_two, (two["f1"] == full["f1"]) & (two["f2"] == full["f2"]))


def name_distance(a: Column, b: Column, n: int = 4) -> Column:
    """Differences by field; fields after the first ``n`` count as equal. Structs compare as distances do."""
    return F.struct(*[(F.abs(a[f] - b[f]) if i < n else F.lit(0)).cast("int").alias(f) for i, f in enumerate(FIELDS)])


def diploid(a: Column, b: Column) -> Column:
    return F.struct(F.least(order_key(a), order_key(b)).alias("lower"), F.greatest(order_key(a), order_key(b)).alias("upper"))


def diploid_match(two: Column, full: Column, both: bool = True) -> Column:
    """Whether the reference's two-field alleles match the other's lower and upper (or one of them)."""
    lower = (two["lower"]["f1"] == full["lower"]["f1"]) & (two["lower"]["f2"] == full["lower"]["f2"])
    upper = (two["upper"]["f1"] == full["upper"]["f1"]) & (two["upper"]["f2"] == full["upper"]["f2"])
    return lower & upper if both else lower | upper


def diploid_distance(a: Column, b: Column, n: int = 4) -> Column:
    """struct(near, far, crossed, first, second) of the straight or crossed pairing, whichever is smaller.

    ``first`` and ``second`` are the distances of a's lower and upper allele; straight wins ties.
    """

    def pairing(x: str, y: str, crossed: int) -> Column:
        one, two = name_distance(a["lower"], b[x], n), name_distance(a["upper"], b[y], n)
        return F.struct(F.least(one, two).alias("near"), F.greatest(one, two).alias("far"), F.lit(crossed).alias("crossed"),
                        one.alias("first"), two.alias("second"))

    return F.least(pairing("lower", "upper", 0), pairing("upper", "lower", 1))


def safe_file_name(text: Column) -> Column:
    for character, name in (("*", "s"), (":", "c"), ("/", "fs"), ("\\", "bs")):
        text = F.replace(text, F.lit(character), F.lit(name))
    return text
