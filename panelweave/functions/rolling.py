"""Statistics of sliding windows in one ordered pass over the bars.

Bars come dealt by security and in the order of their dates, in Arrow batches. With the last bars of the batch before, all
windows of a batch are views of its values, so moments are taken from their own mean (nothing is subtracted from a long
sum) and a task holds a batch and a window, whatever the length of a history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from panelweave.functions.columns import EPSILON, KEY, TIME

#: A statistic: count, mean, m2 (sum of squared deviations), max or min of one column, or co (sum of products of deviations) of two.
Stat = tuple[str, ...]


#: Marks the rows that windows are asked for.
_ONLY = "_only"


def named(stat: Stat, n: int) -> str:
    return "_" + "_".join((*stat, str(n)))


def _rank(w: np.ndarray) -> np.ndarray:
    """Average rank of the newest value, as a share of the window."""
    newest = w[:, -1:]
    return ((w < newest).sum(1) + ((w == newest).sum(1) + 1) / 2) / w.shape[1]


def _between(w: np.ndarray, q: float) -> np.ndarray:
    lo, part = divmod(round(q * (w.shape[1] - 1), 9), 1)
    near = [int(lo), int(lo) + 1] if part else [int(lo)]
    ordered = np.partition(w, near, axis=1)
    return ordered[:, near[0]] * (1 - part) + ordered[:, near[-1]] * part if part else ordered[:, near[0]]


def _around(w: np.ndarray) -> np.ndarray:
    return w - w.mean(1, keepdims=True)


#: What full windows are asked for; each function reads the windows of one field or two, a row for each bar, oldest value first; those in ``CENTRED`` from their means.
FULL = {
    "sum": lambda w: w.sum(1), "m2": lambda w: (w * w).sum(1), "co": lambda v, w: (v * w).sum(1), "max": lambda w: w.max(1), "min": lambda w: w.min(1),
    "rank": _rank, "upper": lambda w: _between(w, 0.8), "lower": lambda w: _between(w, 0.2), "first_max": lambda w: w.argmax(1) + 1.0, "first_min": lambda w: w.argmin(1) + 1.0,
}


CENTRED = ("m2", "co")
#: Bars whose windows are looked at together, few enough that they stay in a processor's cache.
BLOCK = 512


def _statistics(held: Mapping[str, np.ndarray], wanted: list[tuple], size: int, own: slice | np.ndarray) -> list[np.ndarray]:
    """Each statistic wanted of the windows that end at the last ``size`` values, of those in ``own``; a field's windows are centred once."""
    views = {(f, n): np.lib.stride_tricks.sliding_window_view(held[f], n)[len(held[f]) - n + 1 - size :] for _, *fs, n in wanted for f in fs}
    rows, out = np.arange(size)[own], [[] for _ in wanted]
    for k in range(0, len(rows), BLOCK):
        at = rows[k : k + BLOCK]
        at = slice(at[0], at[-1] + 1) if at[-1] - at[0] == len(at) - 1 else at
        whole, centred = {x: v[at] for x, v in views.items()}, {}
        for made, (s, *fs, n) in zip(out, wanted):
            if s in CENTRED:
                for f in fs:
                    if (f, n) not in centred:
                        centred[f, n] = _around(whole[f, n])
            made.append(FULL[s](*((centred if s in CENTRED else whole)[f, n] for f in fs)))
    return [np.concatenate([np.zeros(0), *x]) for x in out]


#: A row's numbers as one column: their doubles one after the other, NaN is missing.
PACKED = "_packed"


def packed(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    values = np.ascontiguousarray(values, dtype=float)
    ends = np.arange(len(values) + 1, dtype="int32") * (values.shape[1] * 8)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def unpacked(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The matrix that ``packed`` made a column of; a view where the column is one piece."""
    views = []
    for x in column.chunks:
        start = int(np.frombuffer(x.buffers()[1], "int32", 1, x.offset * 4)[0]) if len(x) else 0
        views.append(np.frombuffer(x.buffers()[2], float, len(x) * width, start).reshape(len(x), width) if len(x) else np.zeros((0, width)))
    return views[0] if len(views) == 1 else np.concatenate([np.zeros((0, width)), *views])


def full_windows(df: DataFrame, wanted: Iterable[tuple], position: str, only: Column | None = None, pack: tuple[list[str], list[str], Callable[[dict, dict], list[np.ndarray]]] | None = None) -> DataFrame:
    """``df`` plus each statistic of ``FULL`` (name, field or two, n) of the last ``n`` bars; NULL until all of them have a value.

    ``df`` is dealt by security already. Bars pass in their order, a batch at a time with the last bars of the one before,
    so a task holds a batch and one window's bars, whatever the length of a history. Windows are views of the batch's values, never copied into rows.
    With ``only`` just the rows that it holds for are given out, and only their windows are computed.
    ``pack`` names the columns that stay and those it reads, and makes numbers of these (arrays by name) and of the statistics; what comes out is the columns that stay and ``PACKED``.
    """
    wanted = list(dict.fromkeys(wanted))
    if not wanted and pack is None:
        return df if only is None else df.where(only)
    fields, most = sorted({f for _, *fs, _ in wanted for f in fs}), max((w[-1] for w in wanted), default=1)
    names = [named(tuple(s), n) for *s, n in wanted]
    schema, marked = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]), only is not None
    if pack is not None:
        schema = T.StructType([*(df.schema[n] for n in pack[0]), T.StructField(PACKED, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = {f: np.full(most - 1, np.nan) for f in fields}
        for b in batches:
            held = {f: np.concatenate([before[f], b[f].to_numpy(zero_copy_only=False)]) for f in fields}
            at, made = b[position].to_numpy(zero_copy_only=False), []
            size = len(at)
            before = {f: x[len(x) - most + 1 :] for f, x in held.items()}
            own = slice(None)
            if marked:
                own = np.flatnonzero(b[_ONLY].fill_null(False).to_numpy(zero_copy_only=False))
                at, b = at[own], b.drop_columns([_ONLY]).take(pa.array(own))
                if not len(own):
                    continue
            every = _statistics(held, wanted, size, own)
            if pack is not None:
                stats = {x: np.where(at < w[-1], np.nan, got) for x, w, got in zip(names, wanted, every)}
                values = pack[2]({n: b[n].to_numpy(zero_copy_only=False).astype(float) for n in pack[1]}, stats)
                yield pa.RecordBatch.from_arrays([*(b[n] for n in pack[0]), packed(np.column_stack(values))], [*pack[0], PACKED])
                continue
            for w, got in zip(wanted, every):
                made.append(pa.array(got, pa.float64(), mask=(at < w[-1]) | np.isnan(got)))  # a window that began in another security is not full here
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *names])

    rows = df.withColumn(_ONLY, only) if marked else df
    return rows.sortWithinPartitions(KEY, TIME).mapInArrow(run, schema)


def _moments(x: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and sum of squared deviations of the last ``window`` values, up to where the security begins; NaN does not count.

    Windows of twice the length are joined from two, each deviation taken from the joint mean, so a window of n costs
    about 2 log n steps instead of n and nothing is subtracted from a long sum. ``at`` is the number of the bar in its security.
    """
    there = ~np.isnan(x)
    block, size, out, covered = (there.astype(float), np.where(there, x, 0.0), np.zeros(len(x))), 1, None, 0

    def joined(a: tuple, b: tuple, back: int) -> tuple:
        """``a`` with the ``b`` that ended ``back`` bars ago, if the security has begun by then."""
        own = at[back:] > back
        n, mean, m2 = (np.concatenate([np.zeros(min(back, len(x))), np.where(own, v[: len(x) - back], 0.0)]) for v in b)
        total = a[0] + n
        share, d = n / np.maximum(total, 1.0), mean - a[1]
        return total, a[1] + d * share, a[2] + m2 + d * d * a[0] * share

    while True:
        if window & size:
            out, covered = (block if out is None else joined(out, block, covered)), covered + size
        if covered == window:
            return out
        block, size = joined(block, block, size), size * 2


def _zscores(x: np.ndarray, at: np.ndarray, window: int, least: int) -> np.ndarray:
    """How many standard deviations each value is above the mean of its window, whose bars before the security's first do not count."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        count, mean, m2 = _moments(x, at, window)
        spread = np.sqrt(m2 / (count - 1))
        return np.where((count >= least) & (spread > EPSILON), (x - mean) / spread, np.nan)


def zscores(df: DataFrame, columns: Mapping[str, str], window: int, least: int, position: str, total: tuple[str, Mapping[str, float], int] | None = None) -> DataFrame:
    """``df`` plus, by name, the z-score of each column in its last ``window`` bars of which ``least`` have a value; NULL without variation.

    ``total`` (name, weights by z-score, least number of them) adds the weighted sum of the scores that are there, and as
    ``name_z`` the z-score of that. ``df`` is in the order and dealing that a window by security leaves, as ``passes.in_turn`` says.
    """
    out = [*columns, *([total[0], f"{total[0]}_z"] if total else [])]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, past = {n: np.full(window - 1, np.nan) for n in [*columns, "total"]}, np.zeros(window - 1, dtype="int64")
        for b in batches:
            at = b[position].to_numpy(zero_copy_only=False)
            numbers = np.concatenate([past, at])
            past = numbers[len(numbers) - window + 1 :]

            def scored(name: str, values: np.ndarray) -> np.ndarray:
                held = np.concatenate([before[name], values])  # noqa: B023
                before[name] = held[len(held) - window + 1 :]  # noqa: B023
                return _zscores(held, numbers, window, least)[window - 1 :]  # noqa: B023

            made = {n: scored(n, b[x].to_numpy(zero_copy_only=False).astype(float)) for n, x in columns.items()} if len(at) else {n: np.zeros(0) for n in columns}
            if total:
                parts = np.column_stack([made[n] * w for n, w in total[1].items()])
                there = ~np.isnan(parts)
                made[total[0]] = np.where(there.sum(1) >= total[2], np.where(there, parts, 0).sum(1), np.nan)
                made[f"{total[0]}_z"] = scored("total", made[total[0]]) if len(at) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(made[n], pa.float64(), mask=np.isnan(made[n])) for n in out)], [*b.schema.names, *out])

    return df.mapInArrow(run, schema)


def needed(stats: Mapping[str, Iterable[Stat]], families: Iterable[str]) -> list[Stat]:
    return list(dict.fromkeys(s for f in families for s in stats[f]))
