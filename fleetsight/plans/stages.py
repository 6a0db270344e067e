"""Chains of DataFrame steps with declared inputs.

A stage is a function of a DataFrame; the chain stays lazy, so Catalyst sees all of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, functions as F

from fleetsight.sources.schemas import require


@dataclass(frozen=True)
class Stage:
    """A named step; ``needs`` lists the columns and types it reads, ``params`` its settings."""

    name: str
    apply: Callable[..., DataFrame]
    needs: str = ""
    params: dict = field(default_factory=dict)

    def __call__(self, df: DataFrame) -> DataFrame:
        checked = require(df, self.needs, self.name) if self.needs else df
        return self.apply(checked, **self.params)


def chain(df: DataFrame, stages: Iterable[Stage], watch: dict[str, Observation] | None = None) -> DataFrame:
    """Run stages in order; with ``watch`` every stage reports its row count when the job runs."""
    for s in stages:
        df = df.transform(s)
        if watch is not None:
            watch[s.name] = Observation(s.name)
            df = df.observe(watch[s.name], F.count(F.lit(1)).alias("rows"))
    return df


def replaced(stages: Iterable[Stage], name: str, new: Stage | None) -> tuple[Stage, ...]:
    """The chain with one stage swapped, or taken out if ``new`` is None."""
    out = [new if s.name == name else s for s in stages]
    return tuple(s for s in out if s is not None)
