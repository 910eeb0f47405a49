import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaloom.config import Backtest
from alphaloom.operators import backtest, diagnose, memory, report, select, validate
from alphaloom.plans.compile import evaluate
from alphaloom.sources import bars

FIELDS = ("open", "high", "low", "close", "volume", "amount")


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(3)
    close = pd.DataFrame(rng.integers(1, 9, (30, 6)).astype(float), columns=list("abcdef"))
    close[rng.random(close.shape) < 0.15] = np.nan
    close["f"] = 5.0
    volume = pd.DataFrame(rng.random((30, 6)), columns=list("abcdef"))
    return close, volume


@pytest.fixture(scope="module")
def grid(spark, panel):
    close, volume = panel
    rows = [(pd.Timestamp("2024-01-01") + pd.Timedelta(days=i), s, *[None if np.isnan(close[s][i]) else float(close[s][i])] * 4, float(volume[s][i]), None) for i in close.index for s in close]
    rows = [(d.date(), *r) for d, *r in rows]
    return bars.grid(spark.createDataFrame(rows, "date date, symbol string, " + ", ".join(f"{f} double" for f in FIELDS))).cache()


def expected(close, volume):
    roll = lambda n, x=close: x.rolling(n, min_periods=max(1, n // 2))
    rank = close.rank(axis=1, pct=True)
    return {
        "rank(close)": rank,
        "zscore(close)": close.sub(close.mean(axis=1), axis=0).div(close.std(axis=1), axis=0),
        "scale(close)": close.div(close.abs().sum(axis=1), axis=0),
        "ts_mean(close, 4)": roll(4).mean(),
        "ts_std(close, 4)": roll(4).std(),
        "ts_rank(close, 4)": roll(4).rank(pct=True),
        "correlation(close, volume, 5)": close.rolling(5, min_periods=2).corr(volume),
        "covariance(close, volume, 5)": close.rolling(5, min_periods=2).cov(volume),
        "delta(close, 2)": close - close.shift(2),
        "returns(close, 2)": close.ffill() / close.ffill().shift(2) - 1,
        "decay_linear(volume, 4)": volume.rolling(4, min_periods=2).apply(lambda w: np.dot(w, np.arange(1, len(w) + 1)) / (len(w) * (len(w) + 1) / 2), raw=True),
        "clip(close, 2, 4)": close.clip(2, 4),
        "ts_mean(rank(delta(close, 1)), 3)": close.diff().rank(axis=1, pct=True).rolling(3, min_periods=1).mean(),
    }


def test_functions_match_pandas(grid, panel):
    want = expected(*panel)
    names = {f"f{i}": e for i, e in enumerate(want)}
    got = evaluate(grid, names).toPandas()
    for name, formula in names.items():
        mine = got.pivot(index="t", columns="symbol", values=name).astype(float).to_numpy()
        theirs = want[formula].astype(float).replace([np.inf, -np.inf], np.nan).to_numpy()
        if formula.startswith("correlation"):  # pandas gives noise or infinities for a constant leg
            mine, theirs = mine[:, :5], theirs[:, :5]
        if formula.startswith(("correlation", "returns")):
            np.testing.assert_allclose(mine[~np.isnan(mine) & ~np.isnan(theirs)], theirs[~np.isnan(mine) & ~np.isnan(theirs)], atol=1e-9, err_msg=formula)
        else:
            np.testing.assert_allclose(mine, theirs, atol=1e-9, err_msg=formula)


def test_no_look_ahead(grid):
    formulas = {f"f{i}": e for i, e in enumerate(expected(pd.DataFrame({"a": [1.0]}), pd.DataFrame({"a": [1.0]})))}
    cut = grid.withColumn("close", F.when(F.col("t") <= 20, F.col("close")).otherwise(F.lit(99.0)))
    one, other = (evaluate(g, formulas).where("t <= 20").orderBy("t", "symbol").toPandas() for g in (grid, cut))
    pd.testing.assert_frame_equal(one, other)


def test_backtest_against_a_loop(spark):
    config = Backtest(lookback_min_days=30)
    grid = bars.grid(bars.synthetic(spark, 90, 15)).cache()
    scores = backtest.scored(grid, {"m": "returns(close, 3)"}, config).cache()
    s = scores.toPandas()
    score, fwd = (s.pivot(index="t", columns="symbol", values=c) for c in ("score", "fwd"))
    want = []
    for t in list(range(1, 91, 5))[:-1]:
        x = score.loc[t].dropna().sort_index()
        if len(x) >= 6:
            up, down = x.nlargest(3).index, x.nsmallest(3).index
            want.append(fwd.loc[t, up].mean() - fwd.loc[t, down].mean() - 0.002)
    got = backtest.period_returns(backtest.legs(scores, config), config).orderBy("t").toPandas().period_return
    np.testing.assert_allclose(got, want, atol=1e-12)
    row = backtest.summary(scores, config).first()
    assert row.error is None and row.n_periods == len(want) and abs(row.mean_return - np.mean(want)) < 1e-6
    short = backtest.summary(scores, Backtest()).first()
    assert short.error.startswith("dates: ") and short.sharpe is None


METRICS = "factor string, error string, sharpe double, ic_mean double, ic_std double, icir double, turnover double, coverage double, max_drawdown double, expression string"


def test_classes_and_parents(spark):
    rows = [
        ("a", None, 0.5, 0.02, 0.1, 0.2, 0.5, 0.4, -0.1, "rank(close)"),
        ("b", None, 3.5, 0.001, 0.01, 0.1, 0.5, 0.4, -0.1, "rank(low)"),
        ("c", None, 0.5, 0.001, 0.5, 0.1, 0.5, 0.4, -0.1, "rank(open)"),
        ("d", "failed", None, None, None, None, None, None, None, "x"),
        ("e", None, 0.1, 0.01, 0.1, 0.1, 0.5, 0.4, -0.1, "volume"),
        ("f", None, 0.9, 0.02, 0.1, 0.2, 0.5, 0.4, -0.1, "rank(high)"),
    ]
    metrics = spark.createDataFrame(rows, METRICS)
    pairs = spark.createDataFrame([("e", "f", 0.9)], "a string, b string, corr double")
    done = diagnose.classify(metrics, pairs).cache()
    assert {r.factor: r.classification for r in done.collect()} == {"a": "promising", "b": "overfit", "c": "unstable", "d": "invalid", "e": "duplicate", "f": "duplicate"}
    assert diagnose.counts(done).first().n_duplicate == 2 and diagnose.best(done).first().best_factor == "b"
    assert select.parent_scores(done).count() == 5
    assert {r.factor for r in report.pareto(metrics).collect()} == {"b"}
    assert select.pick_diverse(["x", "y", "z"], {frozenset("xy"): 0.9}) == ["x", "z"]
    # Pairs that are asked for give the same choice, and only those of factors that were taken are.
    asked, known = [], {frozenset("xy"): 0.9, frozenset("yz"): 0.2, frozenset("xz"): 0.1}
    ask = lambda n: asked.append(n) or {p: v for p, v in known.items() if n in p}
    assert select.pick_diverse(["x", "y", "z"], {}, ask=ask) == ["x", "z"] and asked == ["x", "z"]
    assert memory.concentration([4, 0]) == 1


def test_stop_rules():
    assert report.should_stop(10, 5, 0, [])[0] and report.should_stop(1, 5, 5, [])[0]
    assert report.should_stop(3, 5, 0, [0.5, 0.5, 0.5])[1] == "stalled"
    assert report.should_stop(2, 5, 0, [0.5, 0.51])[0] and not report.should_stop(2, 5, 0, [0.5, 0.4])[0]


def test_validation(grid):
    specs = [{"name": "a", "expression": "rank(close)"}, {"name": "b", "expression": "delay(close, -1)"}, {"name": "c", "expression": "log(close - close)"}, {"name": "d", "expression": "ts_mean(volume, 300)"}]
    got = validate.validate(grid, specs)
    assert [c.ok for c in got] == [True, False, False, False] and got[3].warnings
    assert "delay" in validate.correction_prompt(got)
