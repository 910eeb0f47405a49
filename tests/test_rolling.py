"""Rolling functions and slices of the history against pandas."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaloom.functions import rolling
from alphaloom.operators import backtest
from alphaloom.plans import slices
from alphaloom.plans.compile import evaluate


def series(seed, n=211, gaps=0.2, ties=True):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(0, 2, n), 1 if ties else 12)
    x[r.random(n) < gaps] = np.nan
    x[40:60] = 3.5  # a constant stretch
    x[90:130] = np.nan  # a long gap
    return x


def by_pandas(function, x, y, n):
    s, least = pd.Series(x), max(1, n // 2)
    of = s.rolling(n, min_periods=least)
    if function == "ts_rank":
        return of.apply(lambda w: pd.Series(w).rank(pct=True).iloc[-1], raw=False).where(s.notna())
    if function in ("ts_argmax", "ts_argmin"):
        pick = np.nanargmax if function == "ts_argmax" else np.nanargmin
        out = [np.nan] * len(s)
        for i in range(len(s)):
            w = x[max(0, i - n + 1) : i + 1]
            if (~np.isnan(w)).sum() >= least:
                out[i] = len(w) - 1 - pick(w)
        return pd.Series(out)
    if function == "decay_linear":
        out = [np.nan] * len(s)
        for i in range(len(s)):
            w = x[max(0, i - n + 1) : i + 1]
            if len(w) >= least and not np.isnan(w).any():
                out[i] = (w * np.arange(1, len(w) + 1)).sum() / (len(w) * (len(w) + 1) / 2)
        return pd.Series(out)
    if function in ("correlation", "covariance"):
        both = ~(np.isnan(x) | np.isnan(y))
        a, b = pd.Series(np.where(both, x, np.nan)), pd.Series(np.where(both, y, np.nan))
        w = a.rolling(n, min_periods=least)
        if function == "covariance":
            return w.cov(b)
        flat = (a.rolling(n, min_periods=1).max() == a.rolling(n, min_periods=1).min()) | (b.rolling(n, min_periods=1).max() == b.rolling(n, min_periods=1).min())
        return w.corr(b).mask(flat)
    sd = of.std()
    sd = sd.mask(of.max() == of.min(), 0.0).where(sd.notna())
    return {
        "ts_mean": lambda: of.mean(),
        "ts_sum": lambda: of.sum(),
        "ts_std": lambda: sd,
        "ts_zscore": lambda: (s - of.mean()) / sd.mask(sd == 0, 1e-8),
        "ts_max": lambda: of.max(),
        "ts_min": lambda: of.min(),
        "delay": lambda: s.shift(n),
        "delta": lambda: s - s.shift(n),
        "returns": lambda: (s.ffill() / s.ffill().shift(n).mask(lambda v: v == 0) - 1),
        "ahead": lambda: (s.ffill().shift(-n) / s.ffill().mask(lambda v: v == 0) - 1),
    }[function]()


EVERY = ("ts_mean", "ts_sum", "ts_std", "ts_zscore", "ts_max", "ts_min", "ts_rank", "ts_argmax", "ts_argmin", "decay_linear", "correlation", "covariance", "delay", "delta", "returns", "ahead")


def same(got, want, tolerance=1e-9):
    got, want = np.asarray(got, float), np.asarray(want, float)
    assert (np.isnan(got) == np.isnan(want)).all()
    assert np.allclose(got, want, rtol=tolerance, atol=tolerance, equal_nan=True)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 211, 300])
def test_windows_are_those_of_pandas(n):
    xs, ys = np.stack([series(i) for i in range(3)]), np.stack([series(i + 10, ties=False) for i in range(3)])
    none = np.full(3, np.nan)
    of = rolling.Slice({"x": xs, "y": ys}, np.zeros(3, int), {"x": none})
    for function in EVERY:
        got = of.compute(function, ["x", "y"] if function in ("correlation", "covariance") else ["x"], n)
        got = np.where(np.isfinite(got), got, np.nan)
        for row, x, y in zip(got, xs, ys, strict=True):
            want = by_pandas(function, x, y, n).to_numpy()
            same(row, np.where(np.isfinite(want), want, np.nan), 1e-4 if function == "ts_zscore" else 1e-9)


def test_digits_are_kept_at_a_high_level_and_after_a_jump():
    r = np.random.default_rng(1)
    spread = r.normal(0, 1e-3, 3000)
    level = np.where(np.arange(3000) < 1200, 1.0, 1e6)
    x, y = (level + spread)[None, :], (level + spread + r.normal(0, 1e-3, 3000))[None, :]
    of = rolling.Slice({"x": x, "y": y}, np.zeros(1, int), {})
    exact = lambda i, n, a: np.array(a[0, i - n + 1 : i + 1], dtype=np.longdouble)
    for n in (20, 252):
        got = {f: of.compute(f, ["x", "y"] if f[0] == "c" else ["x"], n)[0] for f in ("ts_std", "correlation", "ts_mean", "covariance")}
        for i in (1200 + n, 2222, 2999):
            a, b = exact(i, n, x), exact(i, n, y)
            da, db = a - a.mean(), b - b.mean()
            assert abs(got["ts_std"][i] - np.sqrt((da * da).sum() / (n - 1))) < 1e-9
            assert abs(got["covariance"][i] - (da * db).sum() / (n - 1)) < 1e-9
            assert abs(got["correlation"][i] - (da * db).sum() / np.sqrt((da * da).sum() * (db * db).sum())) < 1e-6
            assert abs(got["ts_mean"][i] - a.mean()) < 1e-8


def test_time_does_not_hang_on_the_window():
    x = np.random.default_rng(2).normal(size=(20, 5000))

    def seconds(function, n):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            rolling.Slice({"x": x, "y": x[::-1].copy()}, np.zeros(20, int), {}).compute(function, ["x", "y"] if function == "correlation" else ["x"], n)
            took.append(time.perf_counter() - began)
        return min(took)

    for function in ("ts_max", "ts_argmin", "ts_std", "ts_sum", "decay_linear", "correlation", "ts_rank"):
        assert seconds(function, 1000) < 4 * seconds(function, 20) + 0.05, function


def panel(spark, days, symbols, seed=0):
    rows = []
    for k in range(symbols):
        x, y = series(seed + k, days), series(seed + k + 50, days, ties=False)
        rows += [(i + 1, f"S{k}", None if np.isnan(a) else float(a), None if np.isnan(b) else float(b), 7) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "t int, symbol string, close double, volume double, own int").withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("t")))


@pytest.mark.parametrize("size", [16, 50, 4096])
def test_slices_change_nothing(spark, size, monkeypatch):
    monkeypatch.setattr(slices, "SLICE", size)
    monkeypatch.setattr(slices, "_TOGETHER", 100)
    grid = panel(spark, 211, 3)
    n = 13
    made = {f"m_{f}": slices.Rolling(f, ("close", "volume") if f in ("correlation", "covariance") else ("close",), n) for f in EVERY}
    got = slices.add(grid, made).toPandas().sort_values(["symbol", "t"])
    assert len(got) == 633 and list(got.columns) == [*grid.columns, *made] and (got.own == 7).all()
    for _, own in got.groupby("symbol"):
        x, y = own.close.to_numpy(float), own.volume.to_numpy(float)
        for f in EVERY:
            want = by_pandas(f, x, y, n).to_numpy()
            same(own[f"m_{f}"], np.where(np.isfinite(want), want, np.nan), 1e-4 if f == "ts_zscore" else 1e-9)


def test_windows_longer_than_a_slice_and_nested_ones(spark, monkeypatch):
    grid = panel(spark, 211, 2)
    formulas = {"a": "ts_mean(returns(close, 40), 60)", "b": "delay(ts_rank(close - ts_mean(close, 30), 45), 20)", "c": "rank(ts_std(close, 50)) + delta(close, 70)"}
    whole = evaluate(grid, formulas, ("own",)).orderBy("symbol", "t").toPandas()
    monkeypatch.setattr(slices, "SLICE", 10)
    cut = evaluate(grid, formulas, ("own",)).orderBy("symbol", "t").toPandas()
    assert list(whole.columns) == ["date", "t", "symbol", "own", "a", "b", "c"] and len(whole) == 422
    for c in formulas:
        same(cut[c], whole[c])
    ahead = backtest.forward_returns(grid, 25).orderBy("symbol", "t").toPandas()
    same(ahead[ahead.symbol == "S0"].fwd, by_pandas("ahead", series(0), None, 25))


def test_a_last_value_of_many_slices_ago_counts(spark, monkeypatch):
    monkeypatch.setattr(slices, "SLICE", 8)
    rows = [(t, "S", 4.0 if t == 3 else 5.0 if t == 90 else None) for t in range(1, 101)]
    grid = spark.createDataFrame(rows, "t int, symbol string, close double")
    got = {r.t: r.v for r in slices.add(grid, {"v": slices.Rolling("returns", ("close",), 2)}).collect()}
    assert [t for t in got if got[t] is not None] and all(got[t] == (None if t < 5 else 0.25 if t in (90, 91) else 0.0) for t in got)
    gone = grid.where("t <= 3 or t >= 90")  # not dense: whole slices are missing
    got = {r.t: r.v for r in slices.add(gone, {"v": slices.Rolling("returns", ("close",), 2)}).collect()}
    assert len(got) == 14 and got[90] is None or got[92] == 0.0
    empty = slices.add(grid.where("false"), {"v": slices.Rolling("ts_mean", ("close",), 2)})
    assert empty.count() == 0 and empty.columns == ["t", "symbol", "close", "v"]


def test_one_long_history_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be brought together
    days = 300_000
    grid = spark.range(days).select((F.col("id") + 1).cast("int").alias("t"), F.lit("ONE").alias("symbol"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("close"))
    out = slices.add(grid, {"m": slices.Rolling("ts_mean", ("close",), 5)}).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in out.groupBy("task").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == days and len(sizes) == 4 and max(sizes) < 0.5 * days
    x = pd.Series([r.close for r in grid.where("t <= 5000").orderBy("t").collect()])
    same([r.m for r in out.where("t <= 5000").orderBy("t").collect()], x.rolling(5, min_periods=2).mean())
