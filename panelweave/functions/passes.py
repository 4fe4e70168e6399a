"""Columns of the bars around each bar, made with numpy in one ordered pass.

Bars come dealt by security and in the order of their dates, in Arrow batches. A task holds a batch, the bars before it that
its windows reach back to, and those after it that they look ahead to; windows never leave their security. Extremes
and sums of a window are joined from windows of half its length, so a window of n costs about log n steps for all bars at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.columns import KEY, security
from panelweave.functions.rolling import _moments

#: Column that says that rows are dealt by security and in order (see ``in_turn``).
BAR = "_bar"
_ARROW = {"double": (pa.float64(), T.DoubleType()), "boolean": (pa.bool_(), T.BooleanType()), "int": (pa.int32(), T.IntegerType())}


class Bars:
    """Fields of consecutive bars as arrays (NaN is missing) and what windows by security make of them."""

    def __init__(self, fields: dict[str, np.ndarray], at: np.ndarray):
        self.fields, self.at = fields, at
        n, place = len(at), np.arange(len(at))
        begins = np.ones(n, dtype=bool)
        begins[1:] = at[1:] != at[:-1] + 1
        self.first = np.maximum.accumulate(np.where(begins, place, 0))
        self.last = np.minimum.accumulate(np.where(np.append(begins[1:], True), place, n)[::-1])[::-1]

    def __getitem__(self, name: str) -> np.ndarray:
        return self.fields[name]

    def back(self, x: np.ndarray, k: int, missing: float = np.nan) -> np.ndarray:
        """``x`` as it was ``k`` bars before; after, if negative. ``missing`` beyond the security."""
        if k == 0:
            return x
        out, n = np.full(len(x), missing), len(x)
        if k > 0:
            out[k:] = np.where(np.arange(k, n) - k >= self.first[k:], x[: max(n - k, 0)], missing)
        else:
            out[: max(n + k, 0)] = np.where(np.arange(-k, n) <= self.last[: max(n + k, 0)], x[-k:], missing)
        return out

    def _extreme(self, x: np.ndarray, n: int, pick, missing: float, sign: int) -> np.ndarray:
        out, size = np.where(np.isnan(x), missing, x), 1
        while size * 2 <= n:
            out, size = pick(out, self.back(out, sign * size, missing)), size * 2
        if size < n:
            out = pick(out, self.back(out, sign * (n - size), missing))
        return np.where(out == missing, np.nan, out)

    def highest(self, x: np.ndarray, n: int, ahead: bool = False) -> np.ndarray:
        """The largest value of the last ``n`` bars, or of this and the next ones."""
        return self._extreme(x, n, np.maximum, -np.inf, -1 if ahead else 1)

    def lowest(self, x: np.ndarray, n: int, ahead: bool = False) -> np.ndarray:
        return self._extreme(x, n, np.minimum, np.inf, -1 if ahead else 1)

    def count(self, x: np.ndarray, n: int, ahead: bool = False) -> np.ndarray:
        """How many of the last ``n`` bars, or of this and the next ones, have a value."""
        sums, place = np.concatenate([[0], np.cumsum(~np.isnan(x))]), np.arange(len(x))
        lo, hi = (place, np.minimum(place + n - 1, self.last)) if ahead else (np.maximum(place - n + 1, self.first), place)
        return sums[hi + 1] - sums[lo]

    def total(self, x: np.ndarray, n: int) -> np.ndarray:
        """The sum of the values of the last ``n`` bars, 0 without any; nothing is subtracted from a long sum."""
        block, size, out, covered = np.where(np.isnan(x), 0.0, x), 1, None, 0
        while True:
            if n & size:
                out, covered = (block if out is None else out + self.back(block, covered, 0.0)), covered + size
            if covered == n:
                return out
            block, size = block + self.back(block, size, 0.0), size * 2

    def mean(self, x: np.ndarray, n: int, least: int = 1) -> np.ndarray:
        count = self.count(x, n)
        return np.where(count >= least, self.total(x, n) / np.maximum(count, 1), np.nan)

    def deviation(self, x: np.ndarray, n: int, least: int, sample: bool = True) -> np.ndarray:
        """The standard deviation of the last ``n`` bars where ``least`` of them have a value, of a sample or of a population."""
        count, _, m2 = _moments(x, self.at, n)
        freedom = count - 1 if sample else count
        return np.where((count >= least) & (freedom > 0), np.sqrt(m2 / np.maximum(freedom, 1)), np.nan)

    def quantile(self, x: np.ndarray, n: int, q: float) -> np.ndarray:
        """The exact quantile of the last ``n`` bars that have a value, between neighbours by share."""
        seen = np.column_stack([self.back(x, k) for k in range(n)])
        seen.sort(axis=1)  # missing values come last
        count = (~np.isnan(seen)).sum(1)
        at = np.maximum(count - 1, 0) * q
        lo, hi = np.floor(at).astype(int), np.ceil(at).astype(int)
        a, b = (np.take_along_axis(seen, i[:, None], 1)[:, 0] for i in (lo, hi))
        return np.where(lo == hi, a, a * (hi - at) + b * (at - lo))


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a / b``, missing where b is zero."""
    return a / np.where(b != 0, b, np.nan)


def in_turn(df: DataFrame) -> DataFrame:
    """``df`` dealt by security and in order, with ``BAR``; as it is if it has that, which only rows that kept their order since may have."""
    return df if BAR in df.columns else df.withColumn(BAR, F.row_number().over(security()))


def made(df: DataFrame, fields: Iterable[str], work: Callable[[Bars], Mapping[str, np.ndarray]], out: Mapping[str, str], back: int, ahead: int = 0, begin: Callable[[], Callable[[Bars], Mapping[str, np.ndarray]]] | None = None, only: Callable[[Bars], np.ndarray] | None = None) -> DataFrame:
    """``df`` (see ``in_turn``) plus the columns ``out`` (type by name) that ``work`` makes of its numeric ``fields``.

    ``work`` sees at least ``back`` bars before and ``ahead`` after each bar, as far as its security goes. ``begin`` gives a
    function that carries its own state: it sees each bar once, in order, before ``work`` does, and its columns are fields for ``work``.
    What comes out is still dealt and in order, but Spark does not know; a next pass over it needs no window as long as ``BAR`` is kept.
    With ``only`` just the bars that it holds for (it reads what ``work`` made, too) are given out, without ``BAR``, as they are no longer all.
    """
    fields, types = list(fields), {n: _ARROW[t] for n, t in out.items()}
    marks = [] if only is None else [BAR]
    schema = T.StructType([*(x for x in df.schema.fields if x.name not in marks), *(T.StructField(n, t) for n, (_, t) in types.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follow = begin() if begin else None
        rows: list[pa.RecordBatch] = []  # not given out yet
        held: dict[str, np.ndarray] = {}  # their fields, after those of the bars before
        known = 0  # bars before
        latest, number = None, 0  # security and number of the last bar

        def given(until: int) -> Iterator[pa.RecordBatch]:
            """The bars up to ``until``, which counts from the first that is held."""
            nonlocal rows, held, known
            if until <= known:
                return
            with np.errstate(all="ignore"):
                bars = Bars({n: v for n, v in held.items() if n != BAR}, held[BAR])
                values = work(bars)
                bars.fields = {**bars.fields, **values}
                given_out = slice(known, until) if only is None else known + np.flatnonzero(only(bars)[known:until])
            own = pa.Table.from_batches(rows).combine_chunks()
            columns = []
            for n, (kind, _) in types.items():
                v = values[n][given_out]
                columns.append(pa.array(v, kind, mask=np.isnan(v)) if v.dtype.kind == "f" else pa.array(v, kind))
            ready = own.slice(0, until - known)
            ready = ready if only is None else ready.drop_columns(marks).take(pa.array(given_out - known))
            yield from pa.table([*ready.columns, *columns], names=[*ready.column_names, *types]).combine_chunks().to_batches()
            left = own.slice(until - known)
            rows = left.to_batches() if left.num_rows else []
            start = max(0, until - back)
            held, known = {n: v[start:].copy() for n, v in held.items()}, until - start

        for b in batches:
            if not b.num_rows:
                continue
            code = pa.concat_arrays([pa.array([latest], b[KEY].type), b[KEY]])
            differs = pc.not_equal(code.slice(1), code.slice(0, len(code) - 1)).fill_null(True).to_numpy(zero_copy_only=False)
            differs = differs & ~(pc.and_(code.slice(1).is_null(), code.slice(0, len(code) - 1).is_null()).to_numpy(zero_copy_only=False) & (number > 0 or np.arange(len(differs)) > 0))
            place = np.arange(len(differs))
            since = np.maximum.accumulate(np.where(differs, place, -number))
            new = {n: b[n].cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) for n in fields} | {BAR: place - since + 1}
            latest, number = code[-1].as_py(), int(new[BAR][-1])
            if follow:
                with np.errstate(all="ignore"):
                    new |= follow(Bars({n: v for n, v in new.items() if n != BAR}, new[BAR]))
            held = {n: np.concatenate([held[n], v]) for n, v in new.items()} if held else new
            rows.append(b)
            yield from given(len(held[BAR]) - ahead)
        if rows:
            yield from given(len(held[BAR]))

    return df.mapInArrow(run, schema)
