"""Parents of the next generation: scored in Spark, picked one by one on the driver from the few that are left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.config import Selection
from alphaloom.operators.memory import similar

#: What a class adds to a parent's score.
BONUS = {"promising": 0.08, "weak": 0.0, "unstable": -0.05, "duplicate": -0.08, "overfit": -0.12}


def parent_scores(classified: DataFrame) -> DataFrame:
    """classified with parent_score, of valid factors with a Sharpe; boost, if there is such a column, is added."""
    valid = classified.where((F.col("classification") != "invalid") & F.col("sharpe").isNotNull() & ~F.isnan("sharpe"))
    bonus = F.lit(0.0)
    for name, b in BONUS.items():
        bonus = F.when(F.col("classification") == name, b).otherwise(bonus)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    boost = zero(F.col("boost")) if "boost" in classified.columns else F.lit(0.0)
    over = F.when(F.col("turnover") > 0.85, F.least((F.col("turnover") - 0.85) * 0.25, F.lit(0.10))).otherwise(0.0)
    deep = F.when(F.col("max_drawdown") < -0.5, F.least((F.abs("max_drawdown") - 0.5) * 0.15, F.lit(0.10))).otherwise(0.0)
    score = F.col("sharpe") + boost + bonus + F.least(zero(F.abs("ic_mean")), F.lit(0.05)) + F.least(zero(F.abs("icir")), F.lit(1.0)) * 0.03 - over - deep
    return valid.withColumn("parent_score", F.round(score, 4))


def memory_boost(classified: DataFrame, under_used: list[str], successful: DataFrame, failed: DataFrame) -> DataFrame:
    """classified with boost: 0.05 for each under-used field in the formula, 0.03 if it is like a success, less 0.075 for each twice-failed pattern it is very like. The memory may be of any size: patterns are found by their rare tokens."""
    like = similar(classified, successful, 0.6).select("expression", F.lit(0.03).alias("good")).distinct()
    unlike = similar(classified, failed.where("times_failed >= 2"), 0.7).groupBy("expression").agg((F.count("*") * 0.075).alias("bad"))
    fresh = sum((F.when(F.col("expression").contains(f), 0.05).otherwise(0.0) for f in under_used), F.lit(0.0))
    joined = classified.join(like, "expression", "left").join(unlike, "expression", "left")
    return joined.select(*classified.columns, (fresh + F.coalesce("good", F.lit(0.0)) - F.coalesce("bad", F.lit(0.0))).alias("boost"))


def pick_diverse(ranked: list[str], corr: dict[frozenset, float], config: Selection = Selection(), ask: Callable[[str], dict[frozenset, float]] | None = None) -> list[str]:
    """Parents from names by falling score: each is taken unless it goes with one that has been; the bound is relaxed, and then dropped, while there are too few.

    corr: how factors go together. ask: gives the pairs of a factor, for which it is asked once, when the factor is taken
    first; they are added to corr, so that the pairs of the few that are taken are all that is ever held.
    """
    asked: set[str] = set()

    def take(bound: float) -> list[str]:
        taken: list[str] = []
        for name in ranked:
            if len(taken) < config.max_parents and all(abs(corr.get(frozenset((name, t)), 0.0)) <= bound for t in taken):
                taken.append(name)
                if ask and name not in asked:
                    asked.add(name)
                    corr.update(ask(name))
        return taken

    for bound in (config.max_corr, *config.relaxed):
        taken = take(bound)
        if len(taken) >= min(config.min_parents, len(ranked)):
            return taken
    return taken + [n for n in ranked if n not in taken][: max(0, min(config.min_parents, config.max_parents) - len(taken))]
