"""Exponential averages of a whole history as a scan of affine maps, in window sums.

Each step y = d * y' + b is an affine map of the value before, and such maps compose to one of the same
form. So a security's bars are cut into chunks of ``CHUNK``: within a chunk the composed map is a
running sum of b * d^-k, scaled back by d^k, and from the chunks before only the last one's value
at its end is carried in. What lies further back has a weight of d^CHUNK or less, which ``averages`` checks to
be below a double's resolution. No step depends on the one before, and no task holds a history.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import KEY, TIME

CHUNK = 1024
#: Weight below which an earlier value cannot change a double, and the largest factor of a running sum.
NOTHING, LARGEST = 1e-18, 1e250

c = F.col


@dataclass(frozen=True)
class Average:
    """Exponential average of the column ``x`` that starts at bar ``first`` + ``n`` - 1 with the mean of the ``n`` values so far."""

    x: str
    n: int
    weight: float
    first: int = 1

    @property
    def start(self) -> int:
        return self.first + self.n - 1


def ema(x: str, n: int, first: int = 1) -> Average:
    return Average(x, n, 2.0 / (n + 1), first)


def wilder(x: str, n: int, first: int = 1) -> Average:
    return Average(x, n, 1.0 / n, first)


def numbered(df: DataFrame, there) -> DataFrame:
    """``df`` plus ``_there`` and ``_nth``, the number of the bar among those of its security where ``there`` holds."""
    w = Window.partitionBy(KEY, "_there").orderBy(TIME)
    return df.withColumn("_there", F.coalesce(there, F.lit(False))).withColumn("_nth", F.row_number().over(w))


def averages(df: DataFrame, wanted: dict[str, Average]) -> DataFrame:
    """``df`` (see ``numbered``) plus the averages by name: NULL before their start and where ``_there`` is false.

    Inputs must have a value from their ``first`` numbered bar on.
    """
    for name, a in wanted.items():
        keep = 1 - a.weight
        if keep**CHUNK > NOTHING or keep**-CHUNK > LARGEST or a.start > CHUNK:
            raise ValueError(f"{name}: chunks of {CHUNK} bars do not suit an average over {a.n}")
    chunk = Window.partitionBy(KEY, "_there", "_chunk").orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(KEY, "_there").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({"_chunk": F.floor((c("_nth") - 1) / CHUNK), "_k": (c("_nth") - 1) % CHUNK})

    def scaled(a: Average):
        keep = 1 - a.weight
        # up to the start each value has an equal share of the mean; its power of d is a constant
        return F.when(c("_nth") > a.start, c(a.x) * a.weight * F.pow(F.lit(keep), -c("_k"))).when(c("_nth") >= a.first, c(a.x) * (keep ** (1 - a.start) / a.n)).otherwise(0.0)

    out = out.withColumns({f"_s_{n}": F.sum(scaled(a)).over(chunk) * F.pow(F.lit(1 - a.weight), c("_k")) for n, a in wanted.items()})
    carried = {f"_e_{n}": F.last(F.when(c("_k") == CHUNK - 1, c(f"_s_{n}")), ignorenulls=True).over(before) for n in wanted}
    out = out.withColumns(carried)
    made = {n: F.when(c("_there") & (c("_nth") >= a.start), c(f"_s_{n}") + F.coalesce(c(f"_e_{n}"), F.lit(0.0)) * F.pow(F.lit(1 - a.weight), c("_k") + 1)) for n, a in wanted.items()}
    return out.withColumns(made).drop("_chunk", "_k", *[f"_{k}_{n}" for n in wanted for k in "se"])


def followed(state: dict[str, float], name: str, x: np.ndarray, nth: np.ndarray, a: Average) -> np.ndarray:
    """The average ``a`` of ``x`` over consecutive bars, numbered in their security; ``state`` carries its value on to the next batch.

    Each bar's step is an affine map of the value before, and maps of 2, 4, 8, ... bars are composed from halves.
    """
    keep = 1 - a.weight
    held = np.where(nth == 1, 0.0, np.where(nth <= a.start, 1.0, keep))
    value = np.where(nth > a.start, a.weight * x, np.where(nth >= a.first, x / a.n, 0.0))
    size = 1
    while size < len(x):
        value[size:] += held[size:] * value[:-size]
        held[size:] *= held[:-size]
        size *= 2
    value = value + held * state.get(name, 0.0)
    state[name] = float(value[-1])
    return np.where(nth >= a.start, value, np.nan)
