"""The queries over weekly bars by brand, and the SQL for each. They answer over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom import oracle
from alphaloom.config import Backtest
from alphaloom.functions.panel import rounded
from alphaloom.operators import backtest, diagnose, memory, report, select, validate
from alphaloom.operators.variants import TRANSFORMS
from alphaloom.plans.compile import evaluate
from alphaloom.plans.expr import FIELDS, parse, text
from alphaloom.plans.stored import new_path, stored
from alphaloom.sources import bars as source
from alphaloom.sources import store
from alphaloom.streaming.bars import windowed_bars

Query = Callable[[SparkSession, str], DataFrame]

FUNCTIONS = {
    "rank": "rank(delta(close, 5))",
    "zscore": "zscore(close)",
    "scale": "scale(delta(close, 1), 2)",
    "ts_mean": "ts_mean(close, 10)",
    "ts_std": "ts_std(close, 10)",
    "ts_max": "ts_max(high, 10)",
    "ts_min": "ts_min(low, 10)",
    "ts_sum": "ts_sum(volume, 10)",
    "ts_zscore": "ts_zscore(close, 20)",
    "ts_rank": "ts_rank(close, 10)",
    "ts_argmax": "ts_argmax(close, 10)",
    "ts_argmin": "ts_argmin(close, 10)",
    "correlation": "correlation(close, volume, 20)",
    "covariance": "covariance(close, volume, 20)",
    "decay_linear": "decay_linear(close, 10)",
    "adv": "adv(20)",
    "delay": "delay(close, 3)",
    "delta": "delta(close, 3)",
    "returns": "returns(close, 5)",
    "sign": "sign(delta(close, 1))",
    "log": "log(volume)",
    "abs": "abs(delta(close, 1))",
    "power": "power(close, 0.5)",
    "signed_power": "signed_power(delta(close, 1), 0.5)",
    "min": "min(open, close)",
    "max": "max(open, close)",
    "clip": "clip(delta(close, 1), -50, 50)",
}
#: The seed formulas.
TEMPLATES = {
    "momentum": "returns(close, 10)",
    "risk_adj_momentum": "returns(close, 10) / ts_std(returns(close, 1), 20)",
    "mean_reversion": "-(close - ts_mean(close, 20)) / ts_std(close, 20)",
    "volume_breakout": "volume / ts_mean(volume, 20)",
    "price_volume_corr": "correlation(close, volume, 20)",
    "turnover_signal": "rank(volume / ts_mean(volume, 20))",
    "range_signal": "(high - low) / close",
    "gap_signal": "(open - delay(close, 1)) / delay(close, 1)",
}
#: What shares are taken of: the seeds, and quotients of which many or some are infinite.
SHARED = TEMPLATES | {"falls": "1 / (sign(delta(close, 5)) + 1)", "still": "delta(close, 1) / (volume - delay(volume, 1))"}
CONFIG = Backtest()

_panels: dict[tuple[str, str], DataFrame] = {}


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense grid of a data folder, written once for all queries of a session; forget() lets go of it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _panels:
        bars = source.from_trades(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/part.parquet"))
        _panels[key] = stored(source.grid(stored(bars)))
    return _panels[key]


def forget() -> None:
    """What follows computes its panel anew."""
    _panels.clear()


def value(expression: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evaluate(panel(spark, sf_dir), {"value": expression}).select("date", "symbol", rounded(F.col("value"), 6).alias("value"))

    return run


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.scored(panel(spark, sf_dir), TEMPLATES, CONFIG)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.summary(scores(spark, sf_dir), CONFIG)


def factors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "factor string, expression string")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = scores(spark, sf_dir)
    ics = stored(backtest.daily_ic(of))
    return diagnose.classify(backtest.summary(of, CONFIG, ics), diagnose.spearman_pairs(ics))


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.legs(scores(spark, sf_dir), CONFIG)


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.period_returns(_positions(spark, sf_dir), CONFIG)


def _leg(side: str) -> Query:
    return lambda s, d: _positions(s, d).where(F.col("side") == side).select("factor", "date", "place", "symbol", rounded(F.col("score"), 6).alias("score"))


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = source.from_trades(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/part.parquet"))
    return bars.select("date", "symbol", *(rounded(F.col(f)).alias(f) for f in FIELDS))


def _amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = panel(spark, sf_dir).where("close is not null").select(F.date_format("date", "yyyyMMdd").alias("date"), "symbol", "open", "high", "low", F.col("close").cast("string").alias(" Close "), "volume")
    return source.normalise(raw).select("date", "symbol", rounded(F.col("amount"), 2).alias("amount"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search's history in small: the summary of every seed under two runs, the second with a flipped copy of each."""
    out = stored(summary(spark, sf_dir)).join(factors(spark), "factor")
    again = out.select(F.concat("factor", F.lit("_v1")).alias("factor"), F.concat(F.lit(" "), F.col("expression"), F.lit("  ")).alias("expression"), F.col("sharpe"))
    return out.select(F.lit("run_1").alias("run"), "factor", "expression", "sharpe").unionByName(again.select(F.lit("run_2").alias("run"), "factor", "expression", "sharpe"))


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library of formulas, one for each part (factor, brand, expression, rationale): its form and fields follow from the part's key, its window from the part's size, and every second size has a rationale."""
    part, key = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    field = lambda i: F.get(F.array(*map(F.lit, FIELDS)), i.cast("int"))
    f, g, n = field(key % 6), field(F.floor(key / 6) % 6), (F.col("p_size") + 1).cast("string")
    forms = [("ts_mean(", f, ", ", n, ")"), ("rank(delta(", f, ", ", n, "))"), ("correlation(", f, ", ", g, ", ", n, ")"), (f, " / ts_mean(", g, ", ", n, ")"), ("(", f, " - delay(", g, ", ", n, ")) / ts_std(", f, ", ", n, ")")]
    made = F.get(F.array(*(F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in form)) for form in forms)), (key % 5).cast("int"))
    return part.select(F.concat(F.lit("p"), key.cast("string")).alias("factor"), F.col("p_brand").alias("brand"), made.alias("expression"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("rationale"), key.alias("key"))


def _of_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's first formula."""
    return formulas(spark, sf_dir).groupBy(F.col("brand").alias("factor")).agg(F.min_by("expression", "key").alias("expression"))


def _jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = stored(formulas(spark, sf_dir).select("expression"))
    found = memory.similar(every, every.select(F.col("expression").alias("pattern")), 0.55).where("expression < pattern")
    return found.select("expression", "pattern", rounded(F.col("jaccard")).alias("jaccard"))


def _from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of five years and three brands, from a store of all of them."""
    path = new_path(spark)
    store.write(panel(spark, sf_dir).where("close is not null").select("date", "symbol", *FIELDS), path, 8)
    kept = store.read(spark, path, start="19940101", universe="Brand#11,Brand#23,Brand#55").where(F.col("date") < F.lit("1999-01-01").cast("date"))
    return kept.select("date", "symbol", *(rounded(F.col(c)).alias(c) for c in FIELDS))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = windowed_bars(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return bars.select(F.col("start").cast("date").alias("date"), "symbol", *(rounded(F.col(c)).alias(c) for c in ("open", "high", "low", "close")), "volume")


def _advised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seed with metrics, class, advice and formula, as an iteration leaves it."""
    return stored(diagnose.advise(classified(spark, sf_dir)).join(factors(spark), "factor"))


def _iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two iterations: all seeds, and copies of those of a positive Sharpe."""
    first = stored(summary(spark, sf_dir).join(factors(spark), "factor").select("factor", "expression", "sharpe"))
    again = first.where("sharpe > 0").select(F.concat("factor", F.lit("_v1_flip_sign")).alias("factor"), "expression", F.col("sharpe") / 2)
    return first.withColumn("iteration", F.lit(1)).unionByName(again.toDF("factor", "expression", "sharpe").withColumn("iteration", F.lit(2)))


def _nodes(spark: SparkSession) -> DataFrame:
    rows = [("momentum", "returns(close, 10)", 1, "weak", *[None] * 5), ("unknown", "close", 1, None, 0.25, *[None] * 4)]
    return spark.createDataFrame(rows, "id string, expression string, iteration int, classification string, sharpe double, ic_mean double, turnover double, annual_return double, max_drawdown double")


def _boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _advised(spark, sf_dir)
    failed = memory.failures(memory.failures(None, known), known)
    return select.memory_boost(known, ["open", "amount"], memory.successes(None, known), failed).select("factor", rounded(F.col("boost"), 6).alias("boost"))


def _numbered(rows: DataFrame, value_: str) -> DataFrame:
    return rows.select("factor", (F.row_number().over(Window.partitionBy("factor").orderBy("date")) - 1).alias("period"), rounded(F.col(value_), 6).alias(value_))


def _complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.complexity(formulas(spark, sf_dir))


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.ingest(memory.empty(spark), formulas(spark, sf_dir))["successes"]


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = TEMPLATES | {"broken": "no_such(close", "ahead": "delay(close, -1)"}
    return backtest.run_batch(panel(spark, sf_dir), tried, CONFIG).select("factor", F.col("error").isNotNull().alias("failed"), "sharpe")


QUERIES: dict[str, Query] = {f"fn_{n}": value(e) for n, e in FUNCTIONS.items()} | {f"tpl_{n}": value(e) for n, e in TEMPLATES.items()}
QUERIES |= {
    "bars": _bars,
    "dense_grid": lambda s, d: panel(s, d).select("date", "t", "symbol", F.col("close").isNull().alias("missing")),
    "amount_derived": _amount,
    "forward_returns": lambda s, d: backtest.forward_returns(panel(s, d), CONFIG.holding_days).select("date", "symbol", rounded(F.col("fwd"), 6).alias("fwd")),
    "bt_calendar": lambda s, d: backtest.calendar(scores(s, d), CONFIG),
    "bt_long_leg": _leg("long"),
    "bt_short_leg": _leg("short"),
    "bt_period_returns": lambda s, d: _periods(s, d).select("factor", "date", *(rounded(F.col(c)).alias(c) for c in ("long_return", "short_return", "period_return"))),
    "bt_turnover": lambda s, d: backtest.turnover(_periods(s, d)).select("factor", "date", rounded(F.col("turnover"), 6).alias("turnover")),
    "bt_daily_ic": lambda s, d: backtest.daily_ic(scores(s, d)).select("factor", "date", rounded(F.col("ic"), 6).alias("ic")),
    "bt_ic_summary": lambda s, d: backtest.ic_summary(backtest.daily_ic(scores(s, d))).select("factor", "n_dates", *(rounded(F.col(c)).alias(c) for c in ("ic_mean", "ic_std", "icir"))),
    "bt_drawdown": lambda s, d: backtest.drawdown(_periods(s, d)).select("factor", "date", rounded(F.ln("cumulative")).alias("log_cumulative"), rounded(F.col("drawdown")).alias("drawdown")),
    "bt_positions": lambda s, d: backtest.position_log(_positions(s, d)),
    # Annual returns of these panels are astronomical; their logarithm is the same on both sides to the last place shown.
    "bt_summary": lambda s, d: summary(s, d).withColumn("log_annual_return", F.when(F.col("annual_return") > -1, rounded(F.log1p("annual_return")))).drop("annual_return"),
    "dx_spearman_pairs": lambda s, d: diagnose.spearman_pairs(backtest.daily_ic(scores(s, d))),
    "dx_structural_pairs": lambda s, d: diagnose.structural_pairs(_of_brands(s, d)),
    "dx_classify": lambda s, d: classified(s, d).select("factor", "classification"),
    "dx_counts": lambda s, d: diagnose.counts(classified(s, d)),
    "dx_best": lambda s, d: diagnose.best(classified(s, d)),
    "rp_top_n": lambda s, d: report.top_distinct(_named(s, d), 5).select("factor", "expression", "sharpe"),
    "rp_pareto": lambda s, d: report.pareto(summary(s, d)).select("factor", "sharpe", "turnover", "max_drawdown"),
    "rp_tags": lambda s, d: report.tags(summary(s, d)).select("factor", F.array_join("tags", ",").alias("tags")),
    "kb_field_usage": lambda s, d: memory.field_usage(formulas(s, d)),
    "kb_token_jaccard": _jaccard,
    "ps_parent_score": lambda s, d: select.parent_scores(classified(s, d)).select("factor", "parent_score"),
    "lib_dedup": lambda s, d: report.library(_named(s, d)).select("run", "factor", "sharpe", "slug"),
    "stream_bars": _events,
    "store_bars": _from_store,
    "val_complexity": _complexity,
    "val_shares": lambda s, d: validate.numeric_shares(panel(s, d), SHARED).select("factor", rounded(F.col("missing"), 6).alias("missing"), rounded(F.col("infinite"), 6).alias("infinite"), rounded(F.col("huge"), 6).alias("huge")),
    "bt_batch_errors": _batch,
    "bt_detail_returns": lambda s, d: _numbered(_periods(s, d), "period_return"),
    "bt_detail_ics": lambda s, d: _numbered(backtest.daily_ic(scores(s, d)), "ic"),
    "dx_advice": lambda s, d: _advised(s, d).select("factor", F.array_join("notes", "; ").alias("notes"), F.array_join("suggestions", "; ").alias("suggestions")),
    "dx_latest": lambda s, d: diagnose.latest(_iterations(s, d)).select("factor", "iteration"),
    "rp_distinct_first": lambda s, d: report.distinct_first(_iterations(s, d)).select("factor", "iteration", "sharpe"),
    "lib_stats": lambda s, d: report.library_stats(report.library(_named(s, d))),
    "kb_successes": lambda s, d: memory.successes(memory.successes(None, _iterations(s, d)), _iterations(s, d)),
    "kb_failures": lambda s, d: memory.failures(memory.failures(None, k := _advised(s, d)), k),
    "kb_turnover_log": lambda s, d: memory.logs(_advised(s, d), diagnose.structural_pairs(factors(s)))["high_turnover_structures"].select("factor", "turnover"),
    "kb_stability_log": lambda s, d: memory.logs(_advised(s, d), diagnose.structural_pairs(factors(s)))["stability_improvements"].select("factor"),
    "kb_pair_log": lambda s, d: memory.logs(_advised(s, d), diagnose.spearman_pairs(backtest.daily_ic(scores(s, d))))["high_correlation_pairs"],
    "kb_field_diversity": lambda s, d: memory.field_diversity(memory.field_usage(formulas(s, d))),
    "kb_ingest": _ingested,
    "kb_transform_effect": lambda s, d: memory.transform_effect(_iterations(s, d).withColumn("transformation", F.lit(None).cast("string")), list(TRANSFORMS)),
    "ps_memory_boost": _boost,
    "evo_upsert": lambda s, d: memory.upsert_nodes(_nodes(s), summary(s, d).join(factors(s), "factor"), 2).select("id", "expression", "iteration", "classification", "sharpe", "turnover"),
}


def _after(cte: str, query: str) -> str:
    return f"{cte}\n{query}"


def sql() -> dict[str, str]:
    panel_ = f"WITH {oracle.PANEL.strip()}"
    bt = oracle.backtest_sql(TEMPLATES, CONFIG.holding_days, CONFIG.cost_bps, CONFIG.long_pct, CONFIG.short_pct)
    six = lambda *cs: ", ".join(f"{oracle.rounded(c)} AS {c}" for c in cs)
    quoted = ", ".join(f"('{n}', '{e}')" for n, e in TEMPLATES.items())
    names = f"fx(factor, expression) AS (VALUES {quoted})"
    pairs = """pr AS (SELECT a.factor AS a, b.factor AS b, row_number() OVER (PARTITION BY a.factor, b.factor ORDER BY round(a.ic, 9), date) AS x, row_number() OVER (PARTITION BY a.factor, b.factor ORDER BY round(b.ic, 9), date) AS y
  FROM ics a JOIN ics b USING (date) WHERE a.factor < b.factor),
sp AS (SELECT a, b, round(coalesce(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), 0.0), 4) AS corr FROM pr GROUP BY a, b HAVING count(*) >= 5)"""
    classes = f"""{bt},
{pairs},
cls AS (SELECT *, CASE WHEN coverage < 0.1 THEN 'invalid' WHEN abs(sharpe) > 3 AND abs(ic_mean) < 0.01 THEN 'overfit'
  WHEN ic_std > 0 AND abs(ic_mean) > 0 AND ic_std / abs(ic_mean) > 20 THEN 'unstable'
  WHEN factor IN (SELECT a FROM sp WHERE corr > 0.85 UNION SELECT b FROM sp WHERE corr > 0.85) THEN 'duplicate'
  WHEN abs(sharpe) < 0.3 AND abs(ic_mean) < 0.02 AND abs(icir) < 0.3 THEN 'weak'
  WHEN abs(ic_mean) >= 0.01 AND abs(icir) >= 0.05 AND sharpe >= 0.3 AND turnover <= 0.85 AND coverage >= 0.25 THEN 'promising' ELSE 'weak' END AS classification FROM summary)"""
    named = f"""{bt},
{names},
hist AS (SELECT 'run_1' AS run, factor, expression, sharpe FROM summary JOIN fx USING (factor)
  UNION ALL SELECT 'run_2', factor || '_v1', ' ' || expression || '  ', sharpe FROM summary JOIN fx USING (factor))"""
    out = {f"fn_{n}": oracle.value_sql(e) for n, e in FUNCTIONS.items()} | {f"tpl_{n}": oracle.value_sql(e) for n, e in TEMPLATES.items()}
    hist = f"""{bt},
{names},
its AS (SELECT factor, expression, sharpe, 1 AS iteration FROM summary JOIN fx USING (factor) UNION ALL SELECT factor || '_v1_flip_sign', expression, sharpe / 2, 2 FROM summary JOIN fx USING (factor) WHERE sharpe > 0)"""
    notes = """array_to_string(list_filter([CASE classification WHEN 'invalid' THEN 'no usable backtest: metrics missing' WHEN 'overfit' THEN 'extreme Sharpe without rank IC' WHEN 'unstable' THEN 'IC varies far more than its mean'
  WHEN 'duplicate' THEN 'moves with another factor' WHEN 'weak' THEN 'little signal' ELSE 'signal at an acceptable trading cost' END, CASE WHEN turnover > 0.8 THEN 'high turnover' END, CASE WHEN max_drawdown < -0.5 THEN 'deep drawdown' END], lambda q: q IS NOT NULL), '; ')"""
    # By the rules for each class: what is promising but costly, what is weak, a twin, unstable or overfit.
    advice = """array_to_string(list_filter([CASE WHEN classification = 'promising' AND turnover > 0.6 THEN 'reduce-turnover' END, CASE classification WHEN 'weak' THEN 'combine-factors with a promising one' WHEN 'duplicate' THEN 'remove it or merge it with its twin'
  WHEN 'unstable' THEN 'adjust-smoothing; adjust-lookback' WHEN 'overfit' THEN 'simplify' END], lambda q: q IS NOT NULL), '; ')"""
    known = f"""{classes},
{names},
adv AS (SELECT cls.*, expression, {notes} AS notes, {advice} AS suggestions FROM cls JOIN fx USING (factor)),
tok AS (SELECT factor, expression, list_distinct(list_filter(regexp_split_to_array(expression, '[()\\s,/*+\\-]+'), lambda q: q <> '')) AS p FROM fx),
jac AS (SELECT a.factor AS factor, b.factor AS other, CAST(len(list_intersect(a.p, b.p)) AS DOUBLE) / len(list_distinct(list_concat(a.p, b.p))) AS j FROM tok a CROSS JOIN tok b)"""
    library = f"""fx AS (SELECT 'p' || p_partkey AS factor, p_brand AS brand, p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN p_type END AS rationale, CASE p_partkey % 5 WHEN 0 THEN 'ts_mean(' || f || ', ' || n || ')' WHEN 1 THEN 'rank(delta(' || f || ', ' || n || '))'
  WHEN 2 THEN 'correlation(' || f || ', ' || g || ', ' || n || ')' WHEN 3 THEN f || ' / ts_mean(' || g || ', ' || n || ')' ELSE '(' || f || ' - delay(' || g || ', ' || n || ')) / ts_std(' || f || ', ' || n || ')' END AS expression
  FROM (SELECT *, {list(FIELDS)}[p_partkey % 6 + 1] AS f, {list(FIELDS)}[(p_partkey // 6) % 6 + 1] AS g, CAST(p_size + 1 AS VARCHAR) AS n FROM part))"""

    def share(name: str, formula: str) -> str:
        """The shares of one formula. A quotient's are told by its two parts."""
        root = parse(formula)
        rest = f"{oracle.rounded('avg(CASE WHEN value IS NULL AND NOT ends THEN 1.0 ELSE 0.0 END)')} AS missing, {oracle.rounded('avg(CASE WHEN ends THEN 1.0 ELSE 0.0 END)')} AS infinite, {oracle.rounded('coalesce(avg(CASE WHEN abs(value) > 1e6 THEN 1.0 WHEN value IS NOT NULL THEN 0.0 END), 0.0)')} AS huge"
        if root.name != "/":
            return f"SELECT '{name}' AS factor, {rest} FROM (SELECT *, false AS ends FROM ({oracle.value_sql(formula)}))"
        parts = oracle.factors_sql({"x": text(root.args[0]), "y": text(root.args[1])})
        return f"SELECT '{name}' AS factor, {rest} FROM ({parts} SELECT x / nullif(y, 0) AS value, coalesce(x <> 0 AND y = 0, false) AS ends FROM f)"

    shares = " UNION ALL ".join(share(n, e) for n, e in SHARED.items())
    out |= {
        "val_complexity": f"""WITH {library}, c AS (SELECT factor, i, CASE substr(expression, i, 1) WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END AS s FROM (SELECT *, unnest(range(1, length(expression) + 1)) AS i FROM fx)),
d AS (SELECT factor, greatest(max(o), 0) AS depth FROM (SELECT factor, sum(s) OVER (PARTITION BY factor ORDER BY i) AS o FROM c) GROUP BY factor)
SELECT factor, length(expression) AS length, len(regexp_extract_all(expression, '[a-z_0-9]+\\(')) AS n_calls, CAST(depth AS INTEGER) AS depth FROM fx JOIN d USING (factor)""",
        "val_shares": shares,
        "bt_batch_errors": _after(bt, "SELECT factor, false AS failed, sharpe FROM summary UNION ALL VALUES ('broken', true, NULL), ('ahead', true, NULL)"),
        "bt_detail_returns": _after(bt, f"SELECT factor, CAST(row_number() OVER (PARTITION BY factor ORDER BY date) - 1 AS INTEGER) AS period, {six('period_return')} FROM periods"),
        "bt_detail_ics": _after(bt, f"SELECT factor, CAST(row_number() OVER (PARTITION BY factor ORDER BY date) - 1 AS INTEGER) AS period, {six('ic')} FROM ics"),
        "dx_advice": _after(known, "SELECT factor, notes, suggestions FROM adv"),
        "dx_latest": _after(hist, "SELECT factor, iteration FROM its WHERE iteration = (SELECT max(iteration) FROM its)"),
        "rp_distinct_first": _after(hist, "SELECT factor, iteration, sharpe FROM (SELECT *, row_number() OVER (PARTITION BY trim(expression) ORDER BY iteration, factor) AS n FROM its) WHERE n = 1"),
        "lib_stats": _after(named, "SELECT count(*) AS n_factors, count(DISTINCT run) AS n_runs, count(*) FILTER (sharpe > 0) AS n_positive, max(sharpe) AS best_sharpe, min(sharpe) AS worst_sharpe FROM (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(expression, '\\s+', ' ', 'g')) ORDER BY sharpe DESC, run DESC, factor) AS n FROM hist) WHERE n = 1"),
        "kb_successes": _after(hist, "SELECT expression AS pattern, round((round(sum(sharpe) / count(*), 4) * count(*) + sum(sharpe)) / (2 * count(*)), 4) AS avg_sharpe, 2 * count(*) AS times_seen FROM its WHERE abs(sharpe) > 0.2 GROUP BY expression"),
        "kb_failures": _after(known, "SELECT expression AS pattern, 2 * count(*) AS times_failed FROM adv WHERE classification IN ('invalid', 'weak') GROUP BY expression"),
        "kb_turnover_log": _after(known, "SELECT factor, turnover FROM adv WHERE turnover > 0.8"),
        "kb_stability_log": _after(known, "SELECT factor FROM adv WHERE contains(suggestions, 'reduce-turnover') OR contains(suggestions, 'adjust-smoothing')"),
        "kb_pair_log": _after(f"{bt},\n{pairs}", "SELECT a, b, corr FROM sp WHERE corr > 0.8"),
        "kb_field_diversity": f"""WITH {library}, u AS (SELECT field, count(*) FILTER (contains(expression, field)) AS n FROM fx CROSS JOIN (VALUES {', '.join(f"('{f}')" for f in FIELDS)}) v(field) GROUP BY field), t AS (SELECT sum(n) AS total FROM u)
SELECT field, n, round(n / total, 4) AS share, CASE WHEN total <= 3 THEN 'unknown' WHEN n / total > 0.25 THEN 'over' WHEN n / total < 0.08 THEN 'under' ELSE 'even' END AS state FROM u, t""",
        "kb_ingest": f"WITH {library} SELECT expression AS pattern, 0.0::DOUBLE AS avg_sharpe, count(*) AS times_seen FROM fx WHERE rationale <> '' GROUP BY expression",
        "kb_transform_effect": _after(hist, "SELECT 'flip-sign' AS transformation, count(*) AS success_count, round(avg(sharpe), 4) AS avg_sharpe FROM its WHERE iteration = 2 AND abs(sharpe) > 0.2 HAVING count(*) > 0"),
        "ps_memory_boost": _after(known, f"""SELECT factor, {oracle.rounded("CASE WHEN contains(expression, 'open') THEN 0.05 ELSE 0.0 END + CASE WHEN contains(expression, 'amount') THEN 0.05 ELSE 0.0 END + CASE WHEN EXISTS (SELECT 1 FROM jac JOIN adv o ON jac.other = o.factor WHERE jac.factor = adv.factor AND j > 0.6 AND abs(o.sharpe) > 0.2) THEN 0.03 ELSE 0.0 END - 0.075 * (SELECT count(*) FROM jac JOIN adv o ON jac.other = o.factor WHERE jac.factor = adv.factor AND j > 0.7 AND o.classification IN ('invalid', 'weak'))")} AS boost FROM adv"""),
        "evo_upsert": _after(f"{bt},\n{names}", "SELECT s.factor AS id, expression, CASE s.factor WHEN 'momentum' THEN 1 ELSE 2 END AS iteration, CASE s.factor WHEN 'momentum' THEN 'weak' ELSE 'backtested' END AS classification, sharpe, turnover FROM summary s JOIN fx USING (factor) UNION ALL VALUES ('unknown', 'close', 1, NULL, 0.25, NULL)"),
    }
    return out | {
        "bars": _after(panel_, f"SELECT date, symbol, {six(*FIELDS)} FROM bars"),
        "dense_grid": _after(panel_, "SELECT date, t, symbol, close IS NULL AS missing FROM grid"),
        "amount_derived": _after(panel_, f"SELECT date, symbol, {oracle.rounded('close * volume', 2)} AS amount FROM bars"),
        "forward_returns": _after(bt, f"SELECT date, symbol, {six('fwd')} FROM ff"),
        "bt_calendar": _after(bt, "SELECT date, t FROM cal"),
        "bt_long_leg": _after(bt, f"SELECT factor, date, CAST(place AS INTEGER) AS place, symbol, {six('score')} FROM legs WHERE side = 'long'"),
        "bt_short_leg": _after(bt, f"SELECT factor, date, CAST(place AS INTEGER) AS place, symbol, {six('score')} FROM legs WHERE side = 'short'"),
        "bt_period_returns": _after(bt, f"SELECT factor, date, {six('long_return', 'short_return', 'period_return')} FROM periods"),
        "bt_turnover": _after(bt, f"SELECT factor, date, {six('turnover')} FROM turn"),
        "bt_daily_ic": _after(bt, f"SELECT factor, date, {six('ic')} FROM ics"),
        "bt_ic_summary": _after(bt, f"SELECT factor, n_dates, {six('ic_mean', 'ic_std', 'icir')} FROM icsum"),
        "bt_drawdown": _after(bt, f"SELECT factor, date, {oracle.rounded('ln(cumulative)')} AS log_cumulative, {six('drawdown')} FROM dd"),
        "bt_positions": _after(bt, f"SELECT factor, date, side, CAST(place AS INTEGER) AS place, symbol, {six('score')} FROM legs WHERE place <= 20"),
        "bt_summary": _after(bt, f"SELECT * EXCLUDE (annual_return), CASE WHEN annual_return > -1 THEN {oracle.rounded('ln(1 + annual_return)')} END AS log_annual_return FROM summary"),
        "dx_spearman_pairs": _after(f"{bt},\n{pairs}", "SELECT a, b, corr FROM sp"),
        "dx_structural_pairs": f"""WITH {library}, p AS (SELECT brand AS factor, list_distinct(string_split(arg_min(expression, key), '(')) AS p FROM fx GROUP BY brand)
SELECT a.factor AS a, b.factor AS b, round(CAST(len(list_intersect(a.p, b.p)) AS DOUBLE) / len(list_distinct(list_concat(a.p, b.p))), 4) AS corr FROM p a JOIN p b ON a.factor < b.factor""",
        "dx_classify": _after(classes, "SELECT factor, classification FROM cls"),
        "dx_counts": _after(classes, "SELECT count(*) AS n_total, " + ", ".join(f"count(*) FILTER (classification = '{c}') AS n_{c}" for c in diagnose.CLASSES) + " FROM cls"),
        "dx_best": _after(classes, "SELECT arg_min(factor, row(-sharpe, factor)) AS best_factor, max(sharpe) AS best_sharpe, round(coalesce(avg(sharpe) FILTER (classification = 'promising'), 0.0), 4) AS avg_promising_sharpe FROM cls"),
        "rp_top_n": _after(named, "SELECT factor, expression, sharpe FROM (SELECT *, row_number() OVER (PARTITION BY trim(expression) ORDER BY sharpe DESC, factor) AS n FROM hist) WHERE n = 1 ORDER BY sharpe DESC, factor LIMIT 5"),
        "rp_pareto": _after(bt, """SELECT factor, sharpe, turnover, max_drawdown FROM summary p WHERE NOT EXISTS (SELECT 1 FROM summary q WHERE q.sharpe >= p.sharpe AND q.turnover <= p.turnover AND q.max_drawdown >= p.max_drawdown
  AND (q.sharpe > p.sharpe OR q.turnover < p.turnover OR q.max_drawdown > p.max_drawdown))"""),
        "rp_tags": _after(bt, """SELECT factor, array_to_string(list_filter([CASE WHEN sharpe >= 0.5 THEN 'high-sharpe' END, CASE WHEN abs(sharpe) < 0.2 THEN 'low-sharpe' END, CASE WHEN abs(ic_mean) >= 0.02 THEN 'high-ic' END,
  CASE WHEN abs(ic_mean) < 0.01 THEN 'low-ic' END, CASE WHEN turnover > 0.85 THEN 'high-turnover' END, CASE WHEN turnover < 0.5 THEN 'low-turnover' END, CASE WHEN max_drawdown < -0.5 THEN 'high-drawdown' END], lambda q: q IS NOT NULL), ',') AS tags FROM summary"""),
        "kb_field_usage": f"WITH {library} SELECT field, count(*) FILTER (contains(expression, field)) AS n FROM fx CROSS JOIN (VALUES {', '.join(f"('{f}')" for f in FIELDS)}) v(field) GROUP BY field",
        "kb_token_jaccard": f"""WITH {library}, p AS (SELECT expression, list_distinct(list_filter(regexp_split_to_array(expression, '[()\\s,/*+\\-]+'), lambda q: q <> '')) AS p FROM (SELECT DISTINCT expression FROM fx)),
j AS (SELECT a.expression AS expression, b.expression AS pattern, CAST(len(list_intersect(a.p, b.p)) AS DOUBLE) / len(list_distinct(list_concat(a.p, b.p))) AS j FROM p a JOIN p b ON a.expression < b.expression)
SELECT expression, pattern, round(j, 6) AS jaccard FROM j WHERE j > 0.55""",
        "store_bars": _after(panel_, f"SELECT date, symbol, {six(*FIELDS)} FROM bars WHERE date >= DATE '1994-01-01' AND date < DATE '1999-01-01' AND symbol IN ('Brand#11', 'Brand#23', 'Brand#55')"),
        "ps_parent_score": _after(classes, """SELECT factor, round(sharpe + CASE classification WHEN 'promising' THEN 0.08 WHEN 'unstable' THEN -0.05 WHEN 'duplicate' THEN -0.08 WHEN 'overfit' THEN -0.12 ELSE 0.0 END
  + least(abs(ic_mean), 0.05) + least(abs(icir), 1.0) * 0.03 - CASE WHEN turnover > 0.85 THEN least((turnover - 0.85) * 0.25, 0.1) ELSE 0.0 END
  - CASE WHEN max_drawdown < -0.5 THEN least((abs(max_drawdown) - 0.5) * 0.15, 0.1) ELSE 0.0 END, 4) AS parent_score FROM cls WHERE classification <> 'invalid'"""),
        "lib_dedup": _after(named, """SELECT run, factor, sharpe, trim(regexp_replace(lower(factor), '[^a-z0-9]+', '-', 'g'), '-') AS slug
  FROM (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(expression, '\\s+', ' ', 'g')) ORDER BY sharpe DESC, run DESC, factor) AS n FROM hist) WHERE n = 1"""),
        "stream_bars": """SELECT CAST(date_trunc('day', ts) AS DATE) AS date, event_type AS symbol, round(arg_min(value, row(ts, event_id)), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low,
  round(arg_max(value, row(ts, event_id)), 6) AS close, count(*) AS volume FROM events WHERE value IS NOT NULL GROUP BY ALL""",
    }
