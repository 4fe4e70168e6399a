"""Scans, sliding windows and positions against plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from panelweave.functions import positions, rolling, scans
from panelweave.operators import cleaning as cl, factors, indicators as ti, scoring as sc, validation as va
from panelweave.sources import store

DAY = dt.date(2000, 1, 1)


@pytest.fixture(scope="module")
def long_panel(spark):
    """Histories of 1 to 2,600 bars, so that averages cross two borders of chunks; one has bars without a close."""
    rng, rows = random.Random(9), []
    for code, n in (("a", 2600), ("b", 1025), ("c", 40), ("d", 1), ("gap", 60)):
        price = 50.0
        for i in range(n):
            price = max(0.5, price * rng.uniform(0.96, 1.04))
            close = None if code == "gap" and i in (3, 30) else price if rng.random() > 0.05 or not rows else price
            rows.append((code, DAY + dt.timedelta(days=i), price * rng.uniform(1, 1.03), price * rng.uniform(0.97, 1), close))
    return spark.createDataFrame(rows, "stock_code string, trade_date date, high double, low double, close double"), rows


def smooth(xs, n, weight):
    out, y = [None] * len(xs), None
    first = next((i for i, x in enumerate(xs) if x is not None), len(xs))
    for i in range(first, len(xs)):
        if i == first + n - 1:
            y = sum(xs[first : i + 1]) / n
        elif i >= first + n:
            y += weight * (xs[i] - y)
        out[i] = y
    return out


def recurrences_expected(bars):
    close = [b[4] for b in bars]
    step = [None, *(b - a for a, b in zip(close, close[1:]))]
    tr = [None, *(max(b[2] - b[3], abs(b[2] - a), abs(b[3] - a)) for a, b in zip(close, bars[1:]))]
    out = {f"ema{n}": smooth(close, n, 2 / (n + 1)) for n in (5, 12, 13, 26, 34)} | {f"atr{n}": smooth(tr, n, 1 / n) for n in (5, 10, 14, 20)}
    out["macd"] = [None if b is None else a - b for a, b in zip(out["ema12"], out["ema26"])]
    out["macd_signal"] = smooth(out["macd"], 9, 0.2)
    out["macd_hist"] = [None if b is None else a - b for a, b in zip(out["macd"], out["macd_signal"])]
    up, down = (smooth([None if x is None else max(s * x, 0) for x in step], 14, 1 / 14) for s in (1, -1))
    out["rsi"] = rsi = [None if u is None else 100 * u / (u + d) if u + d > 0 else 50.0 for u, d in zip(up, down)]
    out["stoch_k"] = k = []
    for i, x in enumerate(rsi):
        w = rsi[max(0, i - 13) : i + 1]
        k.append(None if len(w) < 14 or None in w else 100 * (x - min(w)) / (max(w) - min(w)) if max(w) > min(w) else 0.0)
    out["stoch_d"] = [None if i < 2 or None in k[i - 2 : i + 1] else sum(k[i - 2 : i + 1]) / 3 for i in range(len(k))]
    return out


def test_recurrences_are_those_of_a_loop(long_panel):
    df, rows = long_panel
    got = {(r["stock_code"], r["trade_date"]): r for r in ti.recurrences(df).collect()}
    assert len(got) == len(rows)
    for code in ("a", "b", "c", "d", "gap"):
        own = [r for r in rows if r[0] == code and r[4] is not None]
        want = recurrences_expected(own)
        for name, values in want.items():
            for r, x in zip(own, values):
                assert got[code, r[1]][name] == (None if x is None else pytest.approx(x, rel=1e-9, abs=1e-7)), (code, name, r[1])
    assert all(got["gap", r[1]][n] is None for r in rows if r[4] is None for n in ti.RECURRENT)


def test_flat_prices_have_a_middle_rsi(spark):
    df = spark.createDataFrame([("a", DAY + dt.timedelta(days=i), 1.0, 1.0, 1.0) for i in range(40)], "stock_code string, trade_date date, high double, low double, close double")
    last = ti.recurrences(df).orderBy(F.desc("trade_date")).first()
    assert (last["rsi"], last["stoch_k"], last["stoch_d"], last["atr14"]) == (50.0, 0.0, 0.0, 0.0) and last["macd"] == pytest.approx(0, abs=1e-12)


def test_averages_that_chunks_cannot_hold_are_refused(long_panel):
    df = scans.numbered(long_panel[0], F.col("close").isNotNull())
    with pytest.raises(ValueError, match="do not suit"):
        scans.averages(df, {"slow": scans.ema("close", 500)})


@pytest.fixture(scope="module")
def series(spark):
    rng, rows = random.Random(5), []
    for code, n in (("a", 90), ("b", 3), ("c", 61)):
        for i in range(n):
            x = None if rng.random() < 0.2 else rng.choice([1e9, 0, -3]) + rng.random()
            rows.append((code, DAY + dt.timedelta(days=i), i + 1, x, float(rng.randint(0, 5)), rng.random()))
    return spark.createDataFrame(rows, "stock_code string, trade_date date, nth int, x double, y double, z double"), rows


@pytest.mark.parametrize("batch", [3, 10_000])
def test_zscores_and_their_total(spark, series, batch):
    df, rows = series
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {(r["stock_code"], r["nth"]): r for r in ti.with_zscores(df, {"a": F.col("x"), "b": F.col("y"), "c": F.col("z")}, 20, 8, ("t", {"a": 2.0, "c": -1.0}, 2)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

    def zed(values, i):
        w = [x for x in values[max(0, i - 19) : i + 1] if x is not None]
        if len(w) < 8 or values[i] is None:
            return None
        m = sum(w) / len(w)
        spread = math.sqrt(sum((x - m) ** 2 for x in w) / (len(w) - 1))
        return (values[i] - m) / spread if spread > 1e-12 else None

    assert len(got) == len(rows)
    for code in "abc":
        own, totals = [r for r in rows if r[0] == code], []
        for i in range(len(own)):
            want = {n: zed([r[k] for r in own], i) for n, k in (("a", 3), ("b", 4), ("c", 5))}
            totals.append(None if None in (want["a"], want["c"]) else 2 * want["a"] - want["c"])
            for n, x in {**want, "t": totals[-1], "t_z": zed(totals, i)}.items():
                assert got[code, i + 1][n] == (None if x is None else pytest.approx(x, rel=1e-6, abs=1e-9)), (code, i, n)


@pytest.mark.parametrize("batch", [4, 10_000])
def test_full_windows(spark, series, batch):
    df, rows = series
    wanted = [(s, "y", n) for s in ("sum", "m2", "max", "min", "rank", "upper", "lower", "first_max", "first_min") for n in (2, 5, 60)] + [("co", "y", "z", 5), ("sum", "x", 3)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))  # windows go on from one batch to the next
    try:
        got = {(r["stock_code"], r["nth"]): r for r in rolling.full_windows(df.repartition("stock_code"), wanted, "nth").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows)

    def between(v, q):
        v, at = sorted(v), q * (len(v) - 1)
        return v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at))

    for code in "abc":
        own = [r for r in rows if r[0] == code]
        for i in range(len(own)):
            for s, *fields, n in wanted:
                w, r = own[i - n + 1 : i + 1] if i >= n - 1 else None, got[code, i + 1][rolling.named((s, *fields), n)]
                if w is None or any(v[3] is None for v in w) and "x" in fields:
                    assert r is None
                    continue
                y, z = [v[3 if fields[0] == "x" else 4] for v in w], [v[5] for v in w]
                my, mz = sum(y) / n, sum(z) / n
                want = {"sum": sum(y), "m2": sum((v - my) ** 2 for v in y), "max": max(y), "min": min(y), "rank": (sum(v < y[-1] for v in y) + (y.count(y[-1]) + 1) / 2) / n, "upper": between(y, 0.8), "lower": between(y, 0.2),
                        "first_max": y.index(max(y)) + 1, "first_min": y.index(min(y)) + 1, "co": sum((a - my) * (b - mz) for a, b in zip(y, z))}[s]
                assert r == pytest.approx(want, rel=1e-12, abs=1e-9), (code, i, s, n)


def test_positions_and_running_sums(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 50), rng.choice([None, 1.5, -2.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, k int, x double").repartition(6)
    got = {r["i"]: (r["position"], r["s"]) for r in positions.in_order(df, [F.desc("k"), F.col("i")], {"s": F.col("x")}).collect()}
    total = 0.0
    for at, (i, _, x) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))):
        total += x or 0.0
        assert got[i] == (at + 1, pytest.approx(total))
    assert positions.in_order(df.where("false"), [F.col("k")]).collect() == []
    plan = positions.in_order(df, [F.col("i")])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("Window")[0]  # only the table of ranges is numbered in one place


def test_equity_does_not_underflow(spark):
    days = [(DAY + dt.timedelta(days=i), -0.9) for i in range(400)]
    df = spark.createDataFrame(days, "trade_date date, r double")
    last = sc.compounded(df, "r", 100.0).orderBy(F.desc("trade_date")).first()
    assert last["equity"] == 0.0 and last["log_equity"] == pytest.approx(math.log(100) + 400 * math.log(0.1))
    days = [(DAY + dt.timedelta(days=i), r) for i, r in enumerate((0.5, None, -1.5, -2.0, -1.0, 0.5))]
    got = [(r["equity"], r["log_equity"]) for r in sc.compounded(spark.createDataFrame(days, "trade_date date, r double"), "r", 10.0).orderBy("trade_date").collect()]
    assert [e for e, _ in got] == pytest.approx([15.0, 15.0, -7.5, 7.5, 0.0, 0.0]) and [x is None for _, x in got] == [False, False, True, False, True, True]


def test_components_cover_the_set(spark):
    names = factors.factor_names()
    df = spark.createDataFrame([(n,) for n in [*names, "WHO7", None]], "n string")
    got = {r["n"]: r["c"] for r in df.select("n", factors.component(F.col("n")).alias("c")).collect()}
    assert got["WHO7"] == "other" and got[None] is None and {got[n] for n in names} == {"trend", "quality", "risk"}
    assert (got["KMID2"], got["VWAP0"], got["STD5"], got["VSTD60"], got["CORD10"], got["IMXD20"]) == ("quality", "trend", "risk", "risk", "quality", "trend")


def test_update_log_and_coefficients(spark):
    log = spark.createDataFrame([(i, DAY + dt.timedelta(days=i // 2), "a" if i % 3 else "b") for i in range(9)], "log_id int, logged_at date, operation string")
    assert [r["log_id"] for r in store.update_log(log, 3).collect()] == [8, 7, 6]
    assert [r["log_id"] for r in store.update_log(log, 5, {"operation": "b"}).collect()] == [6, 3, 0] and store.update_log(log, 0).count() == 0
    card = spark.createDataFrame([("a", 0.1), ("b", -0.5), ("c", 0.5), ("d", None)], "feature_name string, coefficient double")
    assert [r["feature_name"] for r in sc.select_top(card, 2).collect()] == ["b", "c"] and [r["feature_name"] for r in sc.select_top(card, 9, 0.2).collect()] == ["b", "c"]


def test_quantiles_and_positions_of_groups(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["big", "big", "big", "big", None, "small"]), rng.choice([None, *range(30)])) for _ in range(700)] + [("lone", 4), ("empty", None)]
    df = spark.createDataFrame([(g, None if x is None else float(x)) for g, x in rows], "g string, x double").repartition(5)
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in positions.quantiles(df, ["g"], "x", {"a": 0.05, "b": 0.5, "c": 1.0}).collect()}
    assert set(got) == {"big", None, "small", "lone"}
    for g, found in got.items():
        v = sorted(x for k, x in rows if k == g and x is not None)
        for q, f in zip((0.05, 0.5, 1.0), found):
            at = q * (len(v) - 1)
            lo = int(at)
            assert f == pytest.approx(v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (at - lo))
    places = {}
    for r in positions.in_order(df, [F.col("x").asc_nulls_last()], {"s": F.col("x")}, group=("g",)).collect():
        places.setdefault(r["g"], []).append((r["position"], r["x"], r["s"]))
    for g, own in places.items():
        own.sort()
        assert [p for p, *_ in own] == list(range(1, len(own) + 1)) and [x for _, x, _ in own] == sorted((x for k, x in rows if k == g), key=lambda x: (x is None, x))
        assert own[-1][2] == pytest.approx(sum(x for k, x in rows if k == g and x is not None))


def test_one_position_at_a_time(spark):
    day = lambda i: None if i is None else DAY + dt.timedelta(days=i)
    rng, rows = random.Random(2), [("z", 3, None, 1.0), ("z", 5, 6, 2.0), ("z", 6, 9, 3.0), ("z", 7, 8, 4.0), ("y", 1, 1, 5.0), ("y", 1, 4, 6.0)]
    rows += [("a", i, i + rng.randint(0, 9), float(i)) for i in sorted(rng.sample(range(400), 150))]
    df = spark.createDataFrame([(k, day(a), day(b), x) for k, a, b, x in rows], "stock_code string, signal_date date, exit_date date, x double").repartition(3)
    want = []
    for k in "ayz":
        free = None
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2] is None, r[2] or 0)):
            if free is None or r[1] > free:
                want.append(r[3])
                free = r[2]
    assert sorted(r["x"] for r in sc.non_overlapping(df).collect()) == sorted(want) and sc.non_overlapping(df.where("false")).collect() == []


def test_an_upsert_goes_on_where_it_broke_off(spark, tmp_path, monkeypatch):
    path, staging, days = str(tmp_path / "set"), str(tmp_path / "staging"), [dt.date(2023, 5, 1), dt.date(2024, 5, 1)]
    row = lambda k, d, x, stamp: (k, d, x, stamp)
    kind = "stock_code string, trade_date date, close double, stamp int"
    store.write(spark.createDataFrame([row("a", d, 1.0, 1) for d in days], kind), path)
    first = spark.createDataFrame([row("a", d, 2.0, 2) for d in days], kind)
    own = store.swap
    monkeypatch.setattr(store, "swap", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.upsert(spark, path, first, ["stock_code", "trade_date"], "stamp", staging)
    monkeypatch.setattr(store, "swap", own)
    assert [r["close"] for r in spark.read.parquet(path).collect()] == [1.0, 1.0]
    second = spark.createDataFrame([row("b", days[0], 5.0, 3)], kind)  # another batch comes first; what was staged is not lost
    store.upsert(spark, path, second, ["stock_code", "trade_date"], "stamp", staging)
    spark.catalog.refreshByPath(path)
    assert sorted((r["stock_code"], r["trade_date"], r["close"]) for r in spark.read.parquet(path).collect()) == [("a", days[0], 2.0), ("a", days[1], 2.0), ("b", days[0], 5.0)]
    assert store.resume(spark, path, staging) is False
    store.upsert(spark, path, second, ["stock_code", "trade_date"], "stamp", staging)  # repeated, it changes nothing
    assert spark.read.parquet(path).count() == 3


@pytest.mark.parametrize("batch", [1, 7, 10_000])  # a date goes on over several batches, or a batch has many dates
def test_factors_of_a_date_together(spark, batch):
    rng, rows = random.Random(1), []
    for code in range(12):
        for i in range(30):
            x = rng.choice([None, 1e20, 3.0]) if rng.random() < 0.1 else round(rng.random(), 1)
            rows.append((f"s{code}", DAY + dt.timedelta(days=i), x, rng.random() if i % 5 else 1.0, None if code > 3 else 2.0, rng.uniform(1, 2)))
    wide = spark.createDataFrame(rows, "stock_code string, trade_date date, A double, B double, C double, close double").repartition("stock_code")
    plain = va.ic_by_date(va.frame_of(wide, ["A", "B", "C"], [1, 3]))
    key = lambda df: {(r["feature_name"], r["trade_date"], r["horizon"]): (r["n"], None if r["ic"] is None else round(r["ic"], 9), None if r["rank_ic"] is None else round(r["rank_ic"], 9)) for r in df.collect()}
    want = key(plain)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(batch))
    try:
        assert key(va.ic_of_set(wide, ["A", "B", "C"], [1, 3])) == want and len(want) > 80
        assert va.ic_of_set(wide.limit(0), ["A", "B", "C"], [1, 3]).count() == 0
    finally:
        spark.conf.set(setting, before)


def test_derivation_of_a_span_of_dates(spark):
    rng = random.Random(4)
    rows = [("a", dt.datetime(2024, 1, 1 + i % 9, 9 + i % 8, rng.randrange(60), rng.randrange(60)), i, rng.random(), 1.0) for i in range(900)]
    ticks = spark.createDataFrame(rows, "stock_code string, ts timestamp, seq int, price double, qty double")
    every = {tuple(r) for r in cl.resample(ticks).collect()}
    some = {tuple(r) for r in cl.derived(ticks, "2024-01-03", "2024-01-05").collect()}
    assert some and some < every and {r for r in every if 3 <= r[2].day <= 5} == some
    assert {tuple(r) for r in cl.derived(ticks).collect()} == every
