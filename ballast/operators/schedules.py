"""Learning rates over the epochs that a log has: each schedule is an expression of the epoch and of its run's number of epochs."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scale_factor(scale: bool, configured: float | None = None, world: int | None = None) -> float:
    """What the base rate is multiplied by: 1 unless scaling is on, else the configured factor, else the number of workers."""
    if not scale:
        return 1.0
    factor = float(configured if configured is not None else world or 1)
    if factor <= 0:
        raise ValueError(f"the factor of the learning rate must be positive, not {factor}")
    return factor


def cosine(e: Column, period: Column, rate: float, least: float = 0.0) -> Column:
    return F.lit(least) + F.lit((rate - least) / 2) * (1 + F.cos(F.lit(math.pi) * e / period))


def restarted(e: Column, rate: float, first: int = 10, growth: int = 2, least: float = 0.0, direct: bool = False) -> Column:
    """Cosine that starts again: the first cycle has ``first`` epochs (one more with ``direct``), each other one ``growth`` times those of the last."""
    first += direct
    if first < 1 or growth < 1:
        raise ValueError("a cycle has at least one epoch, and doesn't get shorter")
    if growth == 1:
        at, length = e % first, F.lit(first)
    else:
        starts, size = [0], first
        while starts[-1] + size < 2**31:
            starts.append(starts[-1] + size)
            size *= growth
        begun = F.filter(F.array(*[F.lit(s).cast("long") for s in starts]), lambda s: s <= e)
        start = F.array_max(begun)
        at, length = e - start, start * (growth - 1) + first
    return cosine(at, length, rate, least)


def stepped(e: Column, rate: float, step: int, gamma: float) -> Column:
    return F.lit(rate) * F.pow(F.lit(gamma), F.floor(e / step).cast("double"))


def linear(e: Column, total: Column, rate: float, end: float) -> Column:
    """From ``rate`` to ``end``, which the epoch after the last would have."""
    return F.lit(rate) + F.lit(end - rate) * e / F.greatest(total, F.lit(1))


def exponential(e: Column, rate: float, decay: float) -> Column:
    """Powers of a decay between 0 and 1; any other is a rate of natural decay."""
    return F.lit(rate) * (F.pow(F.lit(decay), e.cast("double")) if 0 < decay < 1 else F.exp(F.lit(-decay) * e))


def scheduled(log: DataFrame, run: str, epoch: str, schedules: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """``log`` with a column for each schedule, a function of the epoch and its run's number of epochs (the last one's number and 1)."""
    totals = log.groupBy(F.col(run).alias("_run")).agg((F.max(epoch) + 1).alias("_total"))
    known = log.join(totals, F.col(run).eqNullSafe(F.col("_run")))
    return known.withColumns({name: F.round(f(F.col(epoch), F.col("_total")), 10) for name, f in schedules.items()}).drop("_run", "_total")
