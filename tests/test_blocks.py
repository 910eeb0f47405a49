"""Blocked correlations, the frontier's sweeps, the token join and the legs' limits."""

import contextlib
import io

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import backtest, frontier, memory, ordinal, report


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("block", [2, 256])
def test_spearman_pairs_of_series_with_gaps_and_ties(spark, block, monkeypatch):
    monkeypatch.setattr(ordinal, "BLOCK", block)
    r = np.random.default_rng(0)
    table = np.round(r.normal(size=(9, 40)), 1)
    table[3:][r.random((6, 40)) < 0.3] = np.nan
    table[8, 4:] = np.nan  # too few dates with any
    days = pd.date_range("2024-01-01", periods=40).date
    rows = [(f"f{i}", d, float(v)) for i, own in enumerate(table) for d, v in zip(days, own, strict=True) if not np.isnan(v)]
    got = {(x.a, x.b): x["corr"] for x in ordinal.spearman_pairs(spark.createDataFrame(rows, "factor string, date date, ic double")).collect()}
    want = {}
    for i in range(9):
        for j in range(i + 1, 9):
            both = ~(np.isnan(table[i]) | np.isnan(table[j]))
            if both.sum() >= 5:
                x, y = (pd.Series(table[k][both]).rank(method="first") for k in (i, j))
                want[f"f{i}", f"f{j}"] = round(float(x.corr(y)), 4)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1.01e-4 for k in want)
    assert ordinal.spearman_pairs(spark.createDataFrame([], "factor string, date date, ic double")).count() == 0


def test_no_row_is_made_for_a_pair_and_date(spark):
    ics = spark.range(300).select(F.concat(F.lit("f"), F.col("id")).alias("factor"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("n"))
    ics = ics.select("factor", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")).alias("date"), F.rand(3).alias("ic"))
    out = ordinal.spearman_pairs(ics)
    assert out.count() == 300 * 299 // 2 and "Join" not in plan_of(out)


def frontier_by_hand(points):
    return sorted(p for p in points if not any(q[0] >= p[0] and q[1] <= p[1] and q[2] >= p[2] and q != p for q in points))


@pytest.mark.parametrize("sweep", [7, 40, 100_000])
def test_the_frontier_is_that_of_all_pairs(spark, sweep, monkeypatch):
    monkeypatch.setattr(frontier, "SWEEP", sweep)
    r = np.random.default_rng(sweep)
    for points in (r.integers(0, 6, (200, 3)), np.c_[np.zeros(60), r.integers(0, 30, (60, 2))], r.normal(size=(150, 3))):
        points = sorted({tuple(map(float, p)) for p in points})
        if len(points) > 60:  # a sphere's points: most dominate none
            points += [tuple(map(float, p / np.linalg.norm(p))) for p in np.abs(r.normal(size=(40, 3))) * [1, -1, 1]]
        got = frontier.undominated(spark.createDataFrame(points * 2, "s double, t double, d double"), "s", "t", "d")
        assert sorted(map(tuple, got.collect())) == frontier_by_hand(sorted(set(points)))
        assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_many_points_that_none_dominates(spark):
    n = 60_000
    angle = F.col("id") / n * 1.5
    points = spark.range(n).select(F.sin(angle).alias("s"), F.sin(angle).alias("t"), F.cos(angle * 0).alias("d"))
    assert frontier.undominated(points, "s", "t", "d").count() == n  # s rises with t
    assert report.pareto(points.select(F.col("s").alias("sharpe"), F.col("t").alias("turnover"), F.lit(None).cast("double").alias("max_drawdown"), F.lit(None).cast("string").alias("error"))).count() == n


def test_similar_formulas_are_those_of_all_pairs(spark):
    r = np.random.default_rng(4)
    words = ["rank", "close", "open", "ts_mean", "delta", "20", "5", "volume", "high", "low", "zscore", "10"]
    made = lambda n: [f"{'('.join(r.choice(words, r.integers(1, 8)))}" for _ in range(n)] + ["", "()", "close"]
    left, right = made(60), made(60)
    one, other = spark.createDataFrame([(x,) for x in left], "expression string"), spark.createDataFrame([(x,) for x in right], "pattern string")
    for bound in (0.5, 0.6, 0.7):
        sets = lambda x: {t for t in x.replace("(", " ").replace(")", " ").split() if t}
        want = {(x, y) for x in left for y in right if sets(x) and sets(y) and len(sets(x) & sets(y)) / len(sets(x) | sets(y)) > bound}
        got = memory.similar(one, other, bound)
        assert {(g.expression, g.pattern) for g in got.collect()} == want and got.count() == len(want)
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_both_legs_are_limited_before_the_shuffle(spark):
    rows = [(f, f"2024-01-{d:02d}", d, f"S{s:02d}", float((s * d * 7) % 13), 0.1, 1.0) for f in "ab" for d in range(1, 14) for s in range(20)]
    scores = spark.createDataFrame(rows, "factor string, date string, t int, symbol string, score double, fwd double, close double")
    legs = backtest.legs(scores)
    plan = plan_of(legs)
    assert plan.count("WindowGroupLimit") >= 4 and plan.count("Partial") >= 2
    got = legs.where("factor = 'a' and t = 6").collect()
    ranked = sorted(((-r[4], r[3]) for r in rows if r[0] == "a" and r[2] == 6))
    assert [x.symbol for x in sorted((g for g in got if g.side == "long"), key=lambda g: g.place)] == [s for _, s in ranked[:4]]
    ranked = sorted(((r[4], r[3]) for r in rows if r[0] == "a" and r[2] == 6))
    assert [x.symbol for x in sorted((g for g in got if g.side == "short"), key=lambda g: g.place)] == [s for _, s in ranked[:4]]
