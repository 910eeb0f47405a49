"""Which factors move together, and what each is: metrics in, classes and advice out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.config import Classification
from alphaloom.operators.ordinal import spearman_pairs

__all__ = ["advise", "best", "classify", "counts", "latest", "spearman_pairs", "structural_pairs"]
CLASSES = ("invalid", "overfit", "unstable", "duplicate", "weak", "promising")


def _jaccard(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def structural_pairs(factors: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """a, b, corr: how many pieces between opening parentheses two formulas share, of the pairs that aren't in known (a, b)."""
    pieces = factors.select("factor", F.array_distinct(F.split("expression", r"\(")).alias("p"))
    a, b = (pieces.select(F.col("factor").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
    pairs = a.join(b, F.col("a") < F.col("b"))
    if known is not None:
        pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
    return pairs.select("a", "b", F.round(_jaccard(F.col("pa"), F.col("pb")), 4).alias("corr"))


def classify(metrics: DataFrame, pairs: DataFrame, config: Classification = Classification()) -> DataFrame:
    """metrics with classification: the first of the tests that holds, in the order of CLASSES, else weak. A factor is a duplicate if it is in a pair of high correlation."""
    c = config
    high = pairs.where(F.col("corr") > c.duplicate_corr)
    twin = high.select(F.col("a").alias("factor")).union(high.select(F.col("b").alias("factor"))).distinct().withColumn("twin", F.lit(True))
    s, ic, icir = F.col("sharpe"), F.abs("ic_mean"), F.abs("icir")
    bad = lambda x: F.col(x).isNull() | F.isnan(x) | (F.abs(F.col(x)) == float("inf"))
    named = (
        F.when(F.col("error").isNotNull() | F.col("coverage").isNull() | (F.col("coverage") < c.coverage_min) | bad("ic_mean") | bad("icir") | bad("sharpe"), "invalid")
        .when((F.abs(s) > c.overfit_sharpe) & (ic < c.overfit_ic), "overfit")
        .when((F.col("ic_std") > 0) & (ic > 0) & (F.try_divide(F.col("ic_std"), ic) > c.unstable_ratio), "unstable")
        .when(F.col("twin"), "duplicate")
        .when((F.abs(s) < c.weak_sharpe) & (ic < c.weak_ic) & (icir < c.weak_icir), "weak")
        .when((ic >= c.promising_ic) & (icir >= c.promising_icir) & (s >= c.promising_sharpe) & (F.col("turnover") <= c.promising_turnover) & (F.col("coverage") >= c.promising_coverage), "promising")
        .otherwise("weak")
    )
    return metrics.join(twin, "factor", "left").withColumn("classification", named).drop("twin")


def advise(classified: DataFrame) -> DataFrame:
    """classified with notes and suggestions: arrays of text that follow from the class and the metrics."""
    k = F.col("classification")
    notes = F.array_compact(
        F.array(
            F.when(k == "invalid", F.concat(F.lit("no usable backtest: "), F.coalesce("error", F.lit("metrics missing")))),
            F.when(k == "overfit", F.lit("extreme Sharpe without rank IC")),
            F.when(k == "unstable", F.lit("IC varies far more than its mean")),
            F.when(k == "duplicate", F.lit("moves with another factor")),
            F.when(k == "weak", F.lit("little signal")),
            F.when(k == "promising", F.lit("signal at an acceptable trading cost")),
            F.when(F.col("turnover") > 0.8, F.lit("high turnover")),
            F.when(F.col("max_drawdown") < -0.5, F.lit("deep drawdown")),
        )
    )
    advice = F.array_compact(
        F.array(
            F.when((k == "promising") & (F.col("turnover") > 0.6), F.lit("reduce-turnover")),
            F.when(k == "weak", F.lit("combine-factors with a promising one")),
            F.when(k == "duplicate", F.lit("remove it or merge it with its twin")),
            F.when(k == "unstable", F.lit("adjust-smoothing")),
            F.when(k == "unstable", F.lit("adjust-lookback")),
            F.when(k == "overfit", F.lit("simplify")),
        )
    )
    return classified.withColumn("notes", notes).withColumn("suggestions", advice)


def counts(classified: DataFrame) -> DataFrame:
    """One row: n_total and the number of each class."""
    return classified.agg(F.count("*").alias("n_total"), *(F.count(F.when(F.col("classification") == c, 1)).alias(f"n_{c}") for c in CLASSES))


def best(classified: DataFrame) -> DataFrame:
    """One row: best_factor and best_sharpe, ties to the first by name, and avg_promising_sharpe (0 if there is none). Factors without a Sharpe don't take part."""
    known = classified.where(F.col("sharpe").isNotNull())
    return known.agg(
        F.min_by("factor", F.struct(-F.col("sharpe"), F.col("factor"))).alias("best_factor"),
        F.max("sharpe").alias("best_sharpe"),
        F.round(F.coalesce(F.avg(F.when(F.col("classification") == "promising", F.col("sharpe"))), F.lit(0.0)), 4).alias("avg_promising_sharpe"),
    )


def latest(history: DataFrame) -> DataFrame:
    """The rows of the last iteration."""
    last = history.agg(F.max("iteration").alias("last"))
    return history.join(F.broadcast(last), F.col("iteration") == F.col("last"), "left_semi")
