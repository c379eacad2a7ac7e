"""Probabilities as plain numbers, natural or decimal logarithms, behind one interface."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ring:
    """How a probability is written (``of``), read back (``plain``), and multiplied, row by row or over a group."""

    name: str
    of: Callable[[Column], Column]
    plain: Callable[[Column], Column]
    times: Callable[[Column, Column], Column]
    product: Callable[[Column], Column]

    def total(self, rows: DataFrame, keys: list[str], column: str, name: str = "total") -> DataFrame:
        """Sum of each group's probabilities, scaled by the group's largest so that none is lost below the least number."""
        if self.name == "plain":
            return rows.groupBy(*keys).agg(F.sum(column).alias(name))
        tops = rows.groupBy(*keys).agg(F.max(column).alias("_m"))
        sums = rows.join(tops, keys).groupBy(*keys, "_m").agg(F.sum(self.plain(F.col(column) - F.col("_m"))).alias("_s"))
        return sums.select(*keys, (F.col("_m") + self.of(F.col("_s"))).alias(name))


PLAIN = Ring("plain", lambda p: p, lambda x: x, lambda a, b: a * b, F.product)
LN = Ring("ln", F.ln, F.exp, lambda a, b: a + b, F.sum)
LOG10 = Ring("log10", F.log10, lambda x: F.pow(F.lit(10.0), x), lambda a, b: a + b, F.sum)
RINGS = {r.name: r for r in (PLAIN, LN, LOG10)}
