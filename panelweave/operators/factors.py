"""Rolling factor sets over daily bars: candle shapes, price lags and windowed statistics.

A family of factors is a function from the window length to a column over statistics of that window, and the list of
these statistics. A set collects what its factors need and computes it in one pass over the bars in their order, dealt
once by security. Asking for fewer factors computes fewer statistics.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.columns import EPSILON, KEY, TIME, safe_divide, security
from panelweave.functions.rolling import full_windows, named, needed

WINDOWS = (5, 10, 20, 30, 60)
PRICES = ("open", "high", "low", "close", "vwap")

c = F.col


def prepare(bars: DataFrame) -> DataFrame:
    """Bars with a value of every price, one per date; volume 0 and vwap the mean of the four prices if missing.

    Of repeated dates the row with the greatest values is kept.
    """
    vwap = (c("open") + c("high") + c("low") + c("close")) / 4
    if "vwap" in bars.columns:
        vwap = F.coalesce(c("vwap"), vwap)
    rows = bars.where(c(TIME).isNotNull() & c("open").isNotNull() & c("high").isNotNull() & c("low").isNotNull() & c("close").isNotNull())
    rows = rows.withColumn("volume", F.coalesce("volume", F.lit(0.0))).withColumn("vwap", vwap)
    fields = ["open", "high", "low", "close", "volume", "vwap"]
    best = rows.groupBy(KEY, TIME).agg(F.max(F.struct(*fields)).alias("bar"))
    return best.select(KEY, TIME, *[c(f"bar.{f}").alias(f) for f in fields])


def with_inputs(bars: DataFrame) -> DataFrame:
    """The lagged columns that windowed factors read; their names begin with an underscore."""
    w = security()
    out = bars.withColumn("_close1", F.lag("close").over(w)).withColumn("_volume1", F.lag("volume").over(w)).withColumn("_at", F.row_number().over(w).cast("double"))
    dc, dv = c("close") - c("_close1"), c("volume") - c("_volume1")
    step = safe_divide(c("close"), c("_close1"))
    out = out.withColumns({
        "_dc": dc, "_dv": dv, "_step": step, "_lv": F.ln(c("volume") + 1),
        "_lvstep": F.when(c("_volume1").isNotNull(), F.ln(F.greatest(safe_divide(c("volume"), c("_volume1")) + 1, F.lit(EPSILON)))),
        "_moved": F.abs(step - 1) * c("volume"),
    })
    gain = lambda x: F.greatest(c(x), F.lit(0.0))
    return out.withColumns({
        "_up": F.coalesce(c("_dc") > 0, F.lit(False)).cast("double"), "_fell": F.coalesce(c("_dc") < 0, F.lit(False)).cast("double"),
        **{f"_{k}{x}": F.when(c(f"_{x}").isNotNull(), f(f"_{x}")) for x in ("dc", "dv") for k, f in (("gained", gain), ("size", F.abs))},
    })


class Columns:
    """What factors are written in, as Spark columns of a bar and of the statistics of its windows; NULL until all bars of a window have a value."""

    field, divide, sqrt, where, greatest, least = staticmethod(c), staticmethod(safe_divide), staticmethod(F.sqrt), staticmethod(F.when), staticmethod(F.greatest), staticmethod(F.least)

    @staticmethod
    def stat(*stat: str, n: int) -> Column:
        return c(named(stat, n))


class Arrays:
    """The same as arrays of many bars, where NaN is missing; operations come in the same order, so values are equal to the last bit."""

    sqrt, greatest, least = staticmethod(np.sqrt), staticmethod(np.maximum), staticmethod(np.minimum)

    def __init__(self, fields: Mapping[str, np.ndarray], stats: Mapping[str, np.ndarray]):
        self.fields, self.stats = fields, stats

    def field(self, name: str) -> np.ndarray:
        return self.fields[name]

    def stat(self, *stat: str, n: int) -> np.ndarray:
        return self.stats[named(stat, n)]

    def divide(self, a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
        d = b + EPSILON
        return a / np.where(d != 0, d, np.nan)

    def where(self, rule: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.where(rule, x, np.nan)


def candle(v=Columns) -> dict[str, Column]:
    o, h, lo, cl = v.field("open"), v.field("high"), v.field("low"), v.field("close")
    parts = {"KMID": cl - o, "KUP": h - v.greatest(o, cl), "KLOW": v.least(o, cl) - lo, "KSFT": 2 * cl - h - lo}
    out = {"KLEN": v.divide(h - lo, o)}
    for name, x in parts.items():
        out[name], out[f"{name}2"] = v.divide(x, o), v.divide(x, h - lo)
    return {n: out[n] for n in CANDLE}


CANDLE = ("KMID", "KLEN", "KMID2", "KUP", "KUP2", "KLOW", "KLOW2", "KSFT", "KSFT2")


def lagged(field: str, n: int, base: str) -> Column:
    x = F.lag(field, n).over(security()) if n else c(field)
    return safe_divide(x, c(base))


def _mean(v, x: str, n: int):
    return v.stat("sum", x, n=n) / n


def _deviation(v, x: str, n: int):
    return v.sqrt(v.stat("m2", x, n=n) / (n - 1))


def _share(v, part: str, sign: int, n: int):
    """Gains (sign 1), losses (-1) or their difference (0) of a change column as a share of all movement; the first bar has no change."""
    moved, gained = (v.stat("sum", f"_{k}{part}", n=n) for k in ("size", "gained"))
    return v.divide({1: gained, -1: moved - gained, 0: gained + gained - moved}[sign], moved)


def slope(v, n: int):
    """Least-squares slope of the closes on their bar numbers."""
    return v.stat("co", "_at", "close", n=n) / (n * (n * n - 1) / 12)


def r_square(v, n: int):
    around = v.stat("m2", "close", n=n)
    return v.where(around > EPSILON, slope(v, n) * slope(v, n) * (n * (n * n - 1) / 12) / around)


def residual(v, n: int):
    return v.field("close") - _mean(v, "close", n) - slope(v, n) * ((n - 1) / 2)


def _corr(v, a: str, b: str, n: int):
    va, vb = (v.stat("m2", x, n=n) / n for x in (a, b))
    return v.where((va > EPSILON) & (vb > EPSILON), v.stat("co", a, b, n=n) / n / v.sqrt(va * vb))


def _top(v, n: int):
    return v.stat("max", "high", n=n)


def _bottom(v, n: int):
    return v.stat("min", "low", n=n)


def _of_close(v, x):
    return v.divide(x, v.field("close"))


#: Windowed factors by family, in the order of their columns, as ``Columns`` or ``Arrays``. ROC reads a bar before and comes from ``lagged``.
ROLLING: dict[str, Callable] = {
    "ROC": lambda v, n: lagged("close", n, "close"),
    "MA": lambda v, n: _of_close(v, _mean(v, "close", n)),
    "STD": lambda v, n: _of_close(v, _deviation(v, "close", n)),
    "BETA": lambda v, n: _of_close(v, slope(v, n)),
    "RSQR": r_square,
    "RESI": lambda v, n: _of_close(v, residual(v, n)),
    "MAX": lambda v, n: _of_close(v, _top(v, n)),
    "MIN": lambda v, n: _of_close(v, _bottom(v, n)),
    "QTLU": lambda v, n: _of_close(v, v.stat("upper", "close", n=n)),
    "QTLD": lambda v, n: _of_close(v, v.stat("lower", "close", n=n)),
    "RANK": lambda v, n: v.stat("rank", "close", n=n),
    "RSV": lambda v, n: v.divide(v.field("close") - _bottom(v, n), _top(v, n) - _bottom(v, n)),
    "IMAX": lambda v, n: v.stat("first_max", "high", n=n) / (n + EPSILON),
    "IMIN": lambda v, n: v.stat("first_min", "low", n=n) / (n + EPSILON),
    "IMXD": lambda v, n: (v.stat("first_max", "high", n=n) - v.stat("first_min", "low", n=n)) / (n + EPSILON),
    "CORR": lambda v, n: _corr(v, "close", "_lv", n),
    "CORD": lambda v, n: _corr(v, "_step", "_lvstep", n),
    "CNTP": lambda v, n: _mean(v, "_up", n),
    "CNTN": lambda v, n: _mean(v, "_fell", n),
    "CNTD": lambda v, n: _mean(v, "_up", n) - _mean(v, "_fell", n),
    "SUMP": lambda v, n: _share(v, "dc", 1, n),
    "SUMN": lambda v, n: _share(v, "dc", -1, n),
    "SUMD": lambda v, n: _share(v, "dc", 0, n),
    "VMA": lambda v, n: v.divide(_mean(v, "volume", n), v.field("volume")),
    "VSTD": lambda v, n: v.divide(_deviation(v, "volume", n), v.field("volume")),
    "WVMA": lambda v, n: v.divide(_deviation(v, "_moved", n), _mean(v, "_moved", n)),
    "VSUMP": lambda v, n: _share(v, "dv", 1, n),
    "VSUMN": lambda v, n: _share(v, "dv", -1, n),
    "VSUMD": lambda v, n: _share(v, "dv", 0, n),
}


#: Statistics of its window that each family reads.
STATS: dict[str, tuple[tuple[str, ...], ...]] = {
    "ROC": (), "MA": (("sum", "close"),), "STD": (("m2", "close"),), "BETA": (("co", "_at", "close"),), "RSQR": (("co", "_at", "close"), ("m2", "close")), "RESI": (("co", "_at", "close"), ("sum", "close")),
    "MAX": (("max", "high"),), "MIN": (("min", "low"),), "RSV": (("max", "high"), ("min", "low")), "QTLU": (("upper", "close"),), "QTLD": (("lower", "close"),), "RANK": (("rank", "close"),),
    "IMAX": (("first_max", "high"),), "IMIN": (("first_min", "low"),), "IMXD": (("first_max", "high"), ("first_min", "low")),
    "CORR": (("co", "close", "_lv"), ("m2", "close"), ("m2", "_lv")), "CORD": (("co", "_step", "_lvstep"), ("m2", "_step"), ("m2", "_lvstep")),
    "CNTP": (("sum", "_up"),), "CNTN": (("sum", "_fell"),), "CNTD": (("sum", "_up"), ("sum", "_fell")),
    **{f"SUM{k}": (("sum", "_sizedc"), ("sum", "_gaineddc")) for k in "PND"}, **{f"VSUM{k}": (("sum", "_sizedv"), ("sum", "_gaineddv")) for k in "PND"},
    "VMA": (("sum", "volume"),), "VSTD": (("m2", "volume"),), "WVMA": (("m2", "_moved"), ("sum", "_moved")),
}


def factor_names(windows: Iterable[int] = WINDOWS, families: Iterable[str] | None = None) -> list[str]:
    """Column order of the set: candle, prices, then each family's windows."""
    return [*CANDLE, *(f"{p.upper()}0" for p in ("open", "high", "low", "vwap")), *(f"{f}{n}" for f in families or ROLLING for n in windows)]


def compute(bars: DataFrame, names: Iterable[str] | None = None, keep: Iterable[str] = (), also: Mapping[str, Column] | None = None, only: Column | None = None, pack: bool = False, prepared: bool = False) -> DataFrame:
    """The 158-column set, or only the factors named, keyed by security and date; and the prepared columns in ``keep``.

    ``also`` has further columns by name, over the prepared bars of a security; made here they need no dealing of their own.
    ``only`` says which bars get a row; the others are read by the windows of these. With ``pack`` the factors and ``also`` come as one column ``rolling.PACKED``, in this order.
    ``prepared`` says that ``bars`` come from ``prepare``.
    """
    wanted = list(names) if names is not None else factor_names()
    shapes = candle()
    made: dict[str, Column] = {}
    windows: dict[int, list[str]] = {}
    for name in wanted:
        family, n = name.rstrip("0123456789"), name[len(name.rstrip("0123456789")) :]
        if name in shapes:
            made[name] = shapes[name]
        elif family.lower() in PRICES:
            made[name] = lagged(family.lower(), int(n), "close")
        elif family == "VOLUME":
            made[name] = lagged("volume", int(n), "volume")
        elif family in ROLLING and n:
            windows.setdefault(int(n), []).append(family)
            made[name] = ROLLING[family](Columns, int(n))
        else:
            raise ValueError(f"unknown factor {name!r}")
    lags = {n: x for n, x in made.items() if n not in shapes and not any(n.startswith(f) and STATS[f] for f in STATS)}  # read other bars of the security
    rows = with_inputs(bars if prepared else prepare(bars)).withColumns({**{f"_lag_{n}": x for n, x in lags.items()}, **(also or {})})
    made |= {n: c(f"_lag_{n}") for n in lags}
    stats = [(*s, n) for n, families in windows.items() for s in needed(STATS, families)]
    read = dict.fromkeys([KEY, TIME, "_at", *PRICES, "volume", *keep, *(also or {}), *(f"_lag_{n}" for n in lags), *(f for _, *fs, _ in stats for f in fs)])
    if pack:
        return full_windows(rows.select(*read), stats, "_at", only, ([KEY, TIME], [n for n in read if n not in (KEY, TIME)], _packer(wanted, list(lags), list(also or {}))))
    rows = full_windows(rows.select(*read), stats, "_at", only)
    return rows.select(KEY, TIME, *keep, *(also or {}), *[x.alias(n) for n, x in made.items()])


def _packer(wanted: list[str], lags: list[str], also: list[str]) -> Callable[[dict, dict], list[np.ndarray]]:
    """Makes the factors ``wanted`` of arrays of fields and statistics; ``lags`` and ``also`` are among the fields."""

    def values(fields: dict[str, np.ndarray], stats: dict[str, np.ndarray]) -> list[np.ndarray]:
        with np.errstate(all="ignore"):
            v, out = Arrays(fields, stats), []
            shapes = candle(v)
            for name in wanted:
                family = name.rstrip("0123456789")
                out.append(fields[f"_lag_{name}"] if name in lags else shapes[name] if name in shapes else ROLLING[family](v, int(name[len(family) :])))
            return [*out, *(fields[n] for n in also)]

    return values


def lag_panel(bars: DataFrame, lags: int = 60) -> DataFrame:
    """Each price over the newest close, each volume over the newest volume, for lags from the oldest to 0."""
    order = ("close", "open", "high", "low", "vwap", "volume")
    cols = [lagged(f, k, "volume" if f == "volume" else "close").alias(f"{f.upper()}{k}") for f in order for k in range(lags - 1, -1, -1)]
    return prepare(bars).select(KEY, TIME, *cols)


#: The component that a factor is of, by its family or price field.
COMPONENTS = {
    "trend": ("MA", "ROC", "BETA", "MAX", "MIN", "RSV", "IMAX", "IMIN", "IMXD", "RANK", "QTLU", "QTLD", "OPEN", "HIGH", "LOW", "CLOSE", "VWAP"),
    "quality": ("VMA", "WVMA", "VSUMP", "VSUMN", "VSUMD", "CORR", "CORD", "CNTP", "CNTN", "CNTD", "SUMP", "SUMN", "SUMD", "RSQR", "RESI", "KMID", "KLEN", "KMID2", "KUP", "KUP2", "KLOW", "KLOW2", "KSFT", "KSFT2", "VOLUME"),
    "risk": ("STD", "VSTD"),
}


def component(name: Column) -> Column:
    """trend, quality or risk by a factor's name, ``other`` for names of no family; NULL stays NULL."""
    family = F.when(name.isin(*CANDLE), name).otherwise(F.regexp_replace(name, "[0-9]+$", ""))
    out = F.when(name.isNull(), F.lit(None).cast("string"))
    for part, families in COMPONENTS.items():
        out = out.when(family.isin(*families), part)
    return out.otherwise("other")


def to_long(wide: DataFrame, keys: Iterable[str] = (KEY, TIME)) -> DataFrame:
    """``keys, feature_name, feature_value`` of every value that is there."""
    names = [n for n in wide.columns if n not in keys]
    return wide.unpivot(list(keys), names, "feature_name", "feature_value").where("feature_value IS NOT NULL")


FACTOR_SETS = {"rolling158": compute, "lags360": lag_panel}
