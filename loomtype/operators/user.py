"""Places where users plug in their own code."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame


def fold(rows: DataFrame, keys: list[str], step: Callable, start: Callable[[], object], finish: Callable[[tuple, object], pd.DataFrame], schema: str,
         order: str | None = None) -> DataFrame:
    """Fold ``step(state, row)`` over the rows of each key, in order; one group is one task's work."""

    def run(key, frame):
        state = start()
        for row in (frame.sort_values(order) if order else frame).itertuples(index=False):
            state = step(state, row)
        return finish(key, state)

    return rows.groupBy(*keys).applyInPandas(run, schema)


def map_then_combine(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: list[str], combine: list[Column]) -> DataFrame:
    """Parallel ``work`` on batches, then a grouped combination that Spark sums partially first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(work, frames)

    return rows.mapInPandas(run, schema).groupBy(*keys).agg(*combine)


@dataclass(frozen=True)
class Worker:
    """A job over reads in three parts: ``score`` each batch, ``merge`` scores by key, ``finish`` the merged table."""

    score: Callable[[pd.DataFrame], pd.DataFrame]
    schema: str
    keys: tuple[str, ...]
    merge: tuple[Column, ...]
    finish: Callable[[DataFrame], DataFrame] = lambda merged: merged

    def run(self, reads: DataFrame) -> DataFrame:
        return self.finish(map_then_combine(reads, self.score, self.schema, list(self.keys), list(self.merge)))
