"""The closed loop: check formulas, backtest them, tell what they are, remember it, choose parents, and write the next formulas."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.config import Config
from alphaloom.operators import backtest, diagnose, memory, report, select, validate, variants
from alphaloom.plans.expr import ExpressionError, parse
from alphaloom.plans.stored import passing, stored
from alphaloom.sources import bars, records


@dataclass
class Iteration:
    """results: a row for each factor, with metrics, class, notes and suggestions; pairs: a, b, corr; scores and ics: of the factors whose formulas can be read, None if there are none."""

    results: DataFrame
    pairs: DataFrame
    scores: DataFrame | None = None
    ics: DataFrame | None = None


def _readable(formula: str) -> bool:
    try:
        parse(formula)
    except ExpressionError:
        return False
    return True


def evaluate_batch(grid: DataFrame, specs: list[dict], config: Config = Config()) -> Iteration:
    """The specs' factors backtested and classified together, from scores that are computed once. Where ICs say nothing of how two factors go together, their formulas do."""
    spark = grid.sparkSession
    table = records.factor_table(spark, specs)
    good = {s["name"]: s["expression"] for s in specs if _readable(s["expression"])}
    bad = spark.createDataFrame([(s["name"], "formula can't be read") for s in specs if s["name"] not in good], "factor string, error string")
    scores = ics = None
    found = spark.createDataFrame([], "a string, b string, corr double")
    if not good:
        metrics = backtest.run_batch(grid, {s["name"]: s["expression"] for s in specs}, config.backtest)
        metrics = metrics.select("factor", "error", *(F.lit(None).cast("double").alias(c) for c in ("sharpe", "ic_mean", "ic_std", "icir", "annual_return", "turnover", "max_drawdown", "coverage", "long_return", "short_return")))
    else:
        scores = backtest.scored(grid, good, config.backtest)
        ics = stored(backtest.daily_ic(scores))
        metrics = backtest.summary(scores, config.backtest, ics).unionByName(bad, allowMissingColumns=True)
        found = stored(diagnose.spearman_pairs(ics))
    pairs = stored(found.unionByName(diagnose.structural_pairs(table.select(F.col("name").alias("factor"), "expression"), found)))
    named = metrics.join(table.select(F.col("name").alias("factor"), "expression", "parent", "transformation"), "factor")
    return Iteration(stored(diagnose.advise(diagnose.classify(named, pairs, config.classification))), pairs, scores, ics)


def parents_of(done: Iteration, known: dict[str, DataFrame], config: Config = Config(), remember: bool = True) -> tuple[list[variants.Parent], dict[frozenset, float]]:
    """Parents for the next formulas, and how these go together with others; remember: whether the memory has a say. What is collected is a row a factor of one iteration, and the pairs of those that are taken on the way."""
    boosted = done.results
    if remember:
        usage = memory.field_diversity(known["field_usage"])
        under = [r["field"] for r in usage.where("state = 'under'").collect()]  # six rows at most
        boosted = select.memory_boost(done.results, under, known["successes"], known["failures"])
    ranked = select.parent_scores(boosted).orderBy(F.desc("parent_score"), "factor").collect()
    corr: dict[frozenset, float] = {}
    of = lambda name: {frozenset((r["a"], r["b"])): r["corr"] for r in done.pairs.where((F.col("a") == name) | (F.col("b") == name)).collect()}
    chosen = select.pick_diverse([r["factor"] for r in ranked], corr, config.selection, of)
    by = {r["factor"]: r for r in ranked}
    more = ("ic_mean", "icir", "annual_return", "max_drawdown", "classification")
    made = [variants.Parent(n, by[n]["expression"], by[n]["sharpe"], by[n]["turnover"] or 0.0, by[n]["long_return"], by[n]["short_return"], list(by[n]["suggestions"]), {m: by[n][m] for m in more}, list(by[n]["notes"])) for n in chosen]
    return made, corr


def run(spark: SparkSession, grid: DataFrame, specs: list[dict], folder: str, config: Config = Config(), when: str = "") -> dict:
    """Iterations until a stop rule holds, into the folder (a path of any file system Spark knows): history and memory as tables, final_summary.json and search.md; the summary is returned.

    An iteration counts once its state is committed, which names the version of the memory, the history's last
    iteration, the lineage, the best so far and the next formulas. A search that was cut off goes on from there, whatever
    specs it is given: what it had begun is written anew, so that it ends as if nothing had happened. One that has ended
    only writes its reports again. Tables that an iteration writes for itself are deleted at its end.
    """
    state = records.committed(spark, f"{folder}/state") or {"iteration": 0, "memory": 0, "tree": None, "best": [], "specs": specs, "stopped": None}
    trial = bars.grid(bars.toy(spark))
    while not state["stopped"]:
        with passing():
            state = _iterated(spark, grid, trial, state, folder, config)
        records.commit(spark, f"{folder}/state", state, state["iteration"])
    with passing():
        return _finish(spark, folder, state, config, when)


def _iterated(spark: SparkSession, grid: DataFrame, trial: DataFrame, state: dict, folder: str, config: Config) -> dict:
    """The state after one more iteration, whose tables are written."""
    iteration, specs, best = state["iteration"] + 1, state["specs"], list(state["best"])
    checked = validate.validate(trial, specs, config.validation)
    usable = [s for s, c in zip(specs, checked, strict=True) if c.ok]
    tree = variants.grow_tree(state["tree"], [], [{"transformation": "seed", **s} for s in specs], iteration)
    out = {"iteration": iteration, "memory": state["memory"], "tree": tree, "best": best, "specs": [], "stopped": None}
    if not usable:
        return {**out, "stopped": "no-candidate"}
    done = evaluate_batch(grid, usable, config)
    records.append_iteration(done.results, f"{folder}/history", iteration)
    memory.save(memory.learn(memory.load(spark, f"{folder}/memory", state["memory"]), done.results, done.pairs, iteration), f"{folder}/memory", iteration)
    known = memory.load(spark, f"{folder}/memory", iteration)
    n, top = diagnose.counts(done.results).first(), diagnose.best(done.results).first()
    if top["best_factor"]:
        best.append({"iteration": iteration, "factor": top["best_factor"], "sharpe": top["best_sharpe"]})
    stop, why = report.should_stop(iteration, n["n_total"], n["n_invalid"], [b["sharpe"] for b in best], config.stopping)
    out["memory"] = iteration
    if stop:
        return {**out, "stopped": why}
    parents, corr = parents_of(done, known, config)
    new = variants.generate(parents, corr, config.transforms)
    tree = variants.grow_tree(tree, [p.name for p in parents], new, iteration + 1)
    return {**out, "tree": tree, "specs": new, "stopped": None if new else "no-candidate"}


def summarize(spark: SparkSession, folder: str, state: dict, config: Config = Config()) -> tuple[dict, list[dict], list[dict]]:
    """The closing summary of the iterations so far, the lineage's nodes with their metrics, and the frontier."""
    every = records.read_history(spark, f"{folder}/history")
    best = state["best"]
    if every is None or not state["memory"]:
        return {"stopped": state["stopped"], "iterations": 0, "best_factors": []}, [], []
    every = stored(every.where(F.col("iteration") <= state["iteration"]))
    ranked = [{"factor": r["factor"], "expression": r["expression"], "sharpe": r["sharpe"]} for r in report.top_distinct(every, 5).collect()]
    columns = ("factor", "sharpe", "turnover", "max_drawdown")
    front = [r.asDict() for r in report.pareto(report.distinct_first(every)).select(*columns).orderBy(F.desc("sharpe"), "factor").collect()]
    summary = report.final_summary([{"iteration": b["iteration"], "sharpe": b["sharpe"]} for b in best], ranked, front, config.stopping) if best else {"best_factors": []}
    summary |= {"stopped": state["stopped"], "best_factors": ranked}
    # A node for each formula of the search takes the metrics of its last iteration.
    of = "id string, expression string, iteration int, classification string, sharpe double, ic_mean double, turnover double, annual_return double, max_drawdown double"
    nodes = spark.createDataFrame([(n["id"], n["expression"], n["iteration"], *[None] * 6) for n in (state["tree"] or {"nodes": []})["nodes"]], of)
    last = every.groupBy("factor").agg(F.max("iteration").alias("iteration"))
    latest = every.join(last, ["factor", "iteration"])
    known = {r["id"]: r.asDict() for r in memory.upsert_nodes(nodes, latest).collect()}
    classes = {r["factor"]: r["classification"] for r in latest.select("factor", "classification").collect()}
    told = [{**n, **known[n["id"]], "classification": classes.get(n["id"])} for n in (state["tree"] or {"nodes": []})["nodes"]]
    return summary, told, front


def _finish(spark: SparkSession, folder: str, state: dict, config: Config, when: str) -> dict:
    summary, nodes, front = summarize(spark, folder, state, config)
    edges = (state["tree"] or {"edges": []})["edges"]
    if not nodes:
        nodes, edges = report.graph_of_bests(state["best"])
    records.write_text(spark, f"{folder}/final_summary.json", json.dumps(summary, indent=2, ensure_ascii=False))
    records.write_text(spark, f"{folder}/search.md", report.document(nodes, edges, front, config, when))
    records.clean(folder)
    return summary


def shorter(config: Config, iterations: int) -> Config:
    return replace(config, stopping=replace(config.stopping, max_iterations=iterations))
