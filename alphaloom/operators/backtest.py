"""Long/short backtests of many factors in one plan: every step is keyed by factor.

scores: factor, date, t, symbol, score, fwd, as scored() makes them. fwd is the return over the next holding_days
dates of the panel; the score of a date is known on it, so nothing looks ahead.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.config import Backtest
from alphaloom.plans import slices
from alphaloom.plans.compile import evaluate, long_form
from alphaloom.plans.expr import ExpressionError, parse
from alphaloom.plans.stored import stored

YEAR = 252
MIN_SYMBOLS = MIN_REBALANCES = MIN_PERIODS = 10
MIN_PAIRS = 10


def forward_returns(grid: DataFrame, days: int) -> DataFrame:
    """grid with fwd: the relative change of the padded close over the next `days` dates."""
    return slices.add(grid, {"fwd": slices.Rolling("ahead", ("close",), days)})


def scored(grid: DataFrame, factors: dict[str, str], config: Backtest = Backtest()) -> DataFrame:
    """The scores of all factors, written once: legs, returns, ICs and dates are read from them, and the windows run in one job."""
    wide = evaluate(forward_returns(grid, config.holding_days), factors, ("close", "fwd"))
    return stored(long_form(wide, list(factors), ("close", "fwd")))


def calendar(scores: DataFrame, config: Backtest = Backtest()) -> DataFrame:
    """date and t of the dates on which positions change: every holding_days-th from the first, but for the last of them."""
    h = config.holding_days
    last = scores.agg(F.max("t").alias("n")).select(((F.floor((F.col("n") - 1) / h)) * h + 1).alias("last"))
    days = scores.select("date", "t").distinct().where((F.col("t") - 1) % h == 0)
    return days.join(F.broadcast(last), F.col("t") < F.col("last")).select("date", "t")  # last is one row


def universe(scores: DataFrame, config: Backtest = Backtest()) -> DataFrame:
    """factor, n_symbols (with a score and a close on some date each), n_long, n_short."""
    seen = scores.groupBy("factor", "symbol").agg(F.count("score").alias("s"), F.count("close").alias("c"))
    n = seen.where("s > 0 and c > 0").groupBy("factor").agg(F.count("*").alias("n_symbols"))
    leg = lambda share: F.greatest(F.lit(1), F.floor(F.col("n_symbols") * share)).cast("int")
    return n.select("factor", "n_symbols", leg(config.long_pct).alias("n_long"), leg(config.short_pct).alias("n_short"))


def legs(scores: DataFrame, config: Backtest = Backtest(), sizes: DataFrame | None = None) -> DataFrame:
    """factor, date, t, side (long or short), place, symbol, score, fwd: the best and the worst scores of each rebalancing date, ties to the lower symbol. Dates with fewer scores than both legs need are left out. sizes: universe(), if it is known."""
    sizes = stored(universe(scores, config)) if sizes is None else sizes
    most = sizes.agg(F.max("n_long"), F.max("n_short")).first()
    days = calendar(scores, config).select("t")
    at = scores.join(F.broadcast(days), "t", "left_semi").where(F.col("score").isNotNull()).select("factor", "date", "t", "symbol", "score", "fwd")
    enough = at.groupBy("factor", "date").agg(F.count("*").alias("n")).join(F.broadcast(sizes), "factor").where(F.col("n") >= F.col("n_long") + F.col("n_short"))
    # Each leg is limited by a number before its rows are shuffled, and then by its factor's own size.
    sides = []
    for side, order, size, limit in (("long", F.desc("score"), "n_long", most[0]), ("short", F.asc("score"), "n_short", most[1])):
        place = F.row_number().over(Window.partitionBy("factor", "date").orderBy(order, "symbol"))
        first = at.withColumn("place", place).where(F.col("place") <= (limit or 0))
        sides.append(first.join(enough.select("factor", "date", size), ["factor", "date"]).where(F.col("place") <= F.col(size)).select("factor", "date", "t", F.lit(side).alias("side"), "place", "symbol", "score", "fwd"))
    return sides[0].unionByName(sides[1])


def period_returns(positions: DataFrame, config: Backtest = Backtest()) -> DataFrame:
    """factor, date, t, long_return, short_return, period_return (long less short less costs), symbols. A date without forward returns is left out."""
    side = lambda s: F.avg(F.when(F.col("side") == s, F.col("fwd")))
    grouped = positions.groupBy("factor", "date", "t").agg(side("long").alias("long_return"), side("short").alias("short_return"), F.count("fwd").alias("n"), F.collect_set("symbol").alias("symbols"))
    cost = config.cost_bps / 10000 * 4
    return grouped.where("n > 0").select("factor", "date", "t", "long_return", "short_return", (F.col("long_return") - F.col("short_return") - cost).alias("period_return"), "symbols")


def turnover(periods: DataFrame) -> DataFrame:
    """factor, date, turnover: the share of names, of both legs together, that changed since the period before; none for the first."""
    before = F.lag("symbols").over(Window.partitionBy("factor").orderBy("t"))
    t = periods.select("factor", "date", "symbols", before.alias("before")).where("before is not null")
    return t.select("factor", "date", (1 - F.size(F.array_intersect("before", "symbols")) / F.size(F.array_union("before", "symbols"))).alias("turnover"))


def drawdown(periods: DataFrame) -> DataFrame:
    """factor, date, t, cumulative, drawdown: from the highest value so far, which starts with the first period's. A period loses 99 % at most."""
    by = Window.partitionBy("factor").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    cum = periods.select("factor", "date", "t", F.exp(F.sum(F.log1p(F.greatest(F.col("period_return"), F.lit(-0.99)))).over(by)).alias("cumulative"))
    top = cum.withColumn("top", F.max("cumulative").over(by))
    return top.select("factor", "date", "t", "cumulative", ((F.col("cumulative") - F.col("top")) / F.greatest("top", F.lit(1e-8))).alias("drawdown"))


def daily_ic(scores: DataFrame) -> DataFrame:
    """factor, date, t, ic: correlation of the average ranks of score and fwd, of dates with more than ten pairs; constant ranks have none."""
    pairs = scores.where(F.col("score").isNotNull() & F.col("fwd").isNotNull())
    by = Window.partitionBy("factor", "date")

    def ranks(c: str):
        order = by.orderBy(c)
        return F.rank().over(order) + (F.count("*").over(order.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2

    ranked = pairs.select("factor", "date", "t", ranks("score").alias("x"), ranks("fwd").alias("y"))
    each = ranked.groupBy("factor", "date", "t").agg(F.count("*").alias("n"), F.covar_samp("x", "y").alias("c"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"))
    return each.where(F.col("n") > MIN_PAIRS).select("factor", "date", "t", F.try_divide("c", F.col("sx") * F.col("sy")).alias("ic")).where("ic is not null")


def ic_summary(ics: DataFrame) -> DataFrame:
    out = ics.groupBy("factor").agg(F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_std"), F.count("*").alias("n_dates"))
    return out.select("factor", "ic_mean", "ic_std", F.when(F.col("ic_std") > 0, F.col("ic_mean") / F.col("ic_std")).otherwise(0.0).alias("icir"), "n_dates")


def summary(scores: DataFrame, config: Backtest = Backtest(), ics: DataFrame | None = None) -> DataFrame:
    """A row for each factor: its metrics, rounded as reports show them, or an error and no metrics. ics: daily_ic(), if it is known."""
    sizes = stored(universe(scores, config))
    periods = stored(period_returns(legs(scores, config, sizes), config))
    h = config.holding_days
    returns = periods.groupBy("factor").agg(
        F.count("*").alias("n_periods"),
        F.avg("period_return").alias("mean_return"),
        F.stddev_pop("period_return").alias("std_return"),
        (F.product(1 + F.col("period_return")) - 1).alias("total"),
        F.avg("long_return").alias("long_return"),
        F.avg("short_return").alias("short_return"),
    )
    changed = turnover(periods).groupBy("factor").agg(F.avg("turnover").alias("turnover"))
    fallen = drawdown(periods).groupBy("factor").agg(F.min("drawdown").alias("max_drawdown"))
    dates = scores.groupBy("factor").agg(F.max("t").alias("n_dates"))
    all_ = dates.join(sizes, "factor", "left")
    for part in (returns, changed, fallen, ic_summary(daily_ic(scores) if ics is None else ics).drop("n_dates")):
        all_ = all_.join(part, "factor", "left")
    n = F.coalesce("n_symbols", F.lit(0))
    rebalances = F.ceil(F.col("n_dates") / h)
    periods_n = F.coalesce("n_periods", F.lit(0))
    short_of = lambda what, n, least: F.concat(F.lit(f"{what}: "), n, F.lit(f" < {least}"))
    error = (
        F.when(F.col("n_dates") < config.lookback_min_days, short_of("dates", F.col("n_dates"), config.lookback_min_days))
        .when(n < MIN_SYMBOLS, short_of("symbols", n, MIN_SYMBOLS))
        .when(rebalances < MIN_REBALANCES, short_of("rebalancing dates", rebalances, MIN_REBALANCES))
        .when(periods_n < MIN_PERIODS, short_of("periods with returns", periods_n, MIN_PERIODS))
    )
    sharpe = F.when(F.col("std_return") > 0, F.col("mean_return") / F.col("std_return") * math.sqrt(YEAR / h)).otherwise(0.0)
    years = F.greatest(F.col("n_periods") * h / YEAR, F.lit(0.25))
    annual = F.when(F.col("total") <= -1, -1.0).otherwise(F.pow(1 + F.col("total"), 1 / years) - 1)
    metric = lambda c, places: F.when(F.col("error").isNull(), F.round(c, places))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return all_.withColumn("error", error).select(
        "factor",
        "error",
        metric(F.col("mean_return"), 6).alias("mean_return"),
        metric(F.col("std_return"), 6).alias("std_return"),
        metric(sharpe, 4).alias("sharpe"),
        metric(annual, 4).alias("annual_return"),
        metric(F.col("max_drawdown"), 4).alias("max_drawdown"),
        metric(zero(F.col("turnover")), 4).alias("turnover"),
        metric(F.lit(config.long_pct + config.short_pct), 4).alias("coverage"),
        metric(zero(F.col("ic_mean")), 4).alias("ic_mean"),
        metric(zero(F.col("ic_std")), 4).alias("ic_std"),
        metric(zero(F.col("icir")), 4).alias("icir"),
        metric(F.col("long_return"), 4).alias("long_return"),
        metric(F.col("short_return"), 4).alias("short_return"),
        F.when(F.col("error").isNull(), F.col("n_periods")).cast("long").alias("n_periods"),
    )


def position_log(positions: DataFrame, most: int = 20) -> DataFrame:
    """factor, date, side, place, symbol, score of the first `most` of each leg."""
    return positions.where(F.col("place") <= most).select("factor", "date", "side", "place", "symbol", F.round("score", 6).alias("score"))


def run_batch(grid: DataFrame, factors: dict[str, str], config: Backtest = Backtest()) -> DataFrame:
    """summary() of the factors whose formulas can be read, and a row with an error and no metrics for each of the others: one bad formula doesn't end the batch."""
    good, bad = {}, []
    for name, formula in factors.items():
        try:
            parse(formula)
            good[name] = formula
        except ExpressionError as e:
            bad.append((name, f"formula: {e}"))
    rows = grid.sparkSession.createDataFrame(bad, "factor string, error string")
    return summary(scored(grid, good, config), config).unionByName(rows, allowMissingColumns=True) if good else rows
