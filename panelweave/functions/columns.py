"""Column expressions that the operators share: guarded arithmetic and full-window aggregates.

A panel has one row per ``stock_code`` and ``trade_date``; missing values are NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPSILON = 1e-12
KEY, TIME = "stock_code", "trade_date"


def security() -> Window:
    return Window.partitionBy(KEY).orderBy(TIME)


def trailing(n: int, back: int = 0) -> Window:
    """The last ``n`` rows of a security, the newest of them ``back`` rows ago."""
    return security().rowsBetween(-(n - 1) - back, -back)


def leading(first: int, last: int) -> Window:
    return security().rowsBetween(first, last)


def padded(x: Column, n: int = 5) -> Column:
    """``x`` as text with zeros before it up to ``n`` characters; longer ones stay whole, as ``lpad`` alone would cut them."""
    text = x.cast("string")
    return F.when(F.length(text) >= n, text).otherwise(F.lpad(text, n, "0"))


def safe_divide(a: Column, b: Column) -> Column:
    """``a / (b + EPSILON)``; NULL for the one divisor that this makes zero."""
    return F.try_divide(a, b + F.lit(EPSILON))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL where b is zero or NULL."""
    return F.try_divide(a, F.when(b != 0, b))


def change(x: Column, n: int) -> Column:
    return ratio(x, F.lag(x, n).over(security())) - 1


def windowed(x: Column, n: int, aggregate: Column, least: int | None = None) -> Column:
    """``aggregate`` over the last ``n`` rows, NULL unless ``least`` (all, by default) have a value of ``x``."""
    w = trailing(n)
    return F.when(F.count(x).over(w) >= (least or n), aggregate.over(w))


def quantile(x: Column, q: float, over: Window) -> Column:
    """The exact quantile of a frame of bounded length, between neighbours by share as ``percentile`` does, from the frame's values sorted once."""
    values = F.sort_array(F.collect_list(x).over(over))

    def of(a: Column) -> Column:
        at = (F.size(a) - 1) * q
        lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
        return F.when(F.size(a) > 0, F.when(lo == hi, F.get(a, lo)).otherwise(F.get(a, lo) * (hi - at) + F.get(a, hi) * (at - lo)))

    return F.transform(F.array(values), of)[0]


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` between the bounds; NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def correlation(a: Column, b: Column, over: Window | None = None) -> Column:
    """Pearson correlation; NULL where either side hardly varies, where the built-in would raise."""
    own = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    # a row counts only if both sides have a value
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    vx, vy = own(F.var_pop(x)), own(F.var_pop(y))
    return F.when((vx > EPSILON) & (vy > EPSILON), own(F.covar_pop(x, y)) / F.sqrt(vx * vy))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t for a whole number of degrees of freedom.

    The distribution function is a finite series then, so no solver is needed.
    """
    theta = F.atan(F.abs(t) / F.sqrt(df))
    cos2 = F.pow(F.cos(theta), 2)
    steps = lambda start: F.when(df >= start + 4, F.sequence(F.lit(start + 2).cast("long"), F.greatest(df.cast("long") - 2, F.lit(start + 2).cast("long")), F.lit(2).cast("long")))

    def series(start: int) -> Column:
        """1 + sum of products of k-1/k cos^2 for k = start+2, start+4, ... below df."""
        begin = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
        fold = F.aggregate(
            F.coalesce(steps(start), F.array().cast("array<bigint>")), begin,
            lambda acc, k: F.struct((acc["term"] * cos2 * (k - 1) / k).alias("term"), (acc["total"] + acc["term"] * cos2 * (k - 1) / k).alias("total")),
        )
        return fold["total"]

    even = F.sin(theta) * series(0)
    odd = F.lit(2.0) / F.pi() * (theta + F.when(df > 1, F.sin(theta) * F.cos(theta) * series(1)).otherwise(0.0))
    return F.greatest(F.lit(0.0), 1 - F.when(df % 2 == 0, even).otherwise(odd))
