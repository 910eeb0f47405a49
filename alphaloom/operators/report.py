"""What comes out of a search: the best factors, the Pareto frontier, tags, the library, stop rules and the lineage graph."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.config import Config, Stopping, Tags
from alphaloom.operators import frontier
from alphaloom.plans.stored import stored


def top_distinct(results: DataFrame, n: int = 10) -> DataFrame:
    """The n best results by Sharpe, one for each distinct formula (white space at its ends aside)."""
    key = F.trim("expression")
    by = Window.partitionBy(key).orderBy(F.desc("sharpe"), "factor")
    return results.where("sharpe is not null").withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n").orderBy(F.desc("sharpe"), "factor").limit(n)


def distinct_first(results: DataFrame) -> DataFrame:
    """One result for each distinct formula: that of the earliest iteration."""
    by = Window.partitionBy(F.trim("expression")).orderBy("iteration", "factor")
    return results.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def pareto(results: DataFrame) -> DataFrame:
    """Results that none dominates: as good in Sharpe (high), turnover (low) and drawdown (near 0) and better in one. Missing values count as 0.

    results: a summary, a row for each factor. Points are made distinct first, so that copies of a point cost nothing.
    """
    value = lambda c: F.coalesce(c, F.lit(0.0))
    valid = stored(results.where("error is null").withColumns({"_s": value("sharpe"), "_t": value("turnover"), "_d": value("max_drawdown")}))
    front = frontier.undominated(valid, "_s", "_t", "_d")
    return valid.join(front, ["_s", "_t", "_d"], "left_semi").drop("_s", "_t", "_d")


def tags(results: DataFrame, config: Tags = Tags()) -> DataFrame:
    """results with tags, an array of what stands out."""
    when = lambda test, name: F.when(test, F.lit(name))
    s, ic, to, dd = F.col("sharpe"), F.abs("ic_mean"), F.col("turnover"), F.col("max_drawdown")
    return results.withColumn(
        "tags",
        F.array_compact(
            F.array(
                when(s >= config.high_sharpe, "high-sharpe"),
                when(F.abs(s) < config.low_sharpe_abs, "low-sharpe"),
                when(ic >= config.high_ic_abs, "high-ic"),
                when(ic < config.low_ic_abs, "low-ic"),
                when(to > config.high_turnover, "high-turnover"),
                when(to < config.low_turnover, "low-turnover"),
                when(dd < config.high_drawdown, "high-drawdown"),
            )
        ),
    )


def library(results: DataFrame, min_sharpe: float | None = None) -> DataFrame:
    """The best result of each formula over all runs, white space aside, the newest run on ties, by falling Sharpe; with a slug of the name.

    results: run, factor, expression, sharpe.
    """
    known = results.where("sharpe is not null and expression is not null")
    if min_sharpe is not None:
        known = known.where(F.col("sharpe") >= min_sharpe)
    keyed = known.withColumn("key", F.trim(F.regexp_replace("expression", r"\s+", " ")))
    by = Window.partitionBy("key").orderBy(F.desc("sharpe"), F.desc("run"), "factor")
    kept = keyed.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n", "key")
    slug = F.regexp_replace(F.regexp_replace(F.lower("factor"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return kept.withColumn("slug", slug).orderBy(F.desc("sharpe"), "factor")


def library_stats(kept: DataFrame) -> DataFrame:
    return kept.agg(F.count("*").alias("n_factors"), F.countDistinct("run").alias("n_runs"), F.count(F.when(F.col("sharpe") > 0, 1)).alias("n_positive"), F.max("sharpe").alias("best_sharpe"), F.min("sharpe").alias("worst_sharpe"))


def should_stop(iterations: int, n_total: int, n_invalid: int, best_sharpes: list[float], config: Stopping = Stopping()) -> tuple[bool, str]:
    """Whether the search ends, and a code for why; the first rule that holds decides.

    exhausted: the iterations are used up; no-candidate: all are invalid; stalled: the last best Sharpes lie within
    stall_range; small-gain: the last step gained less than diminishing; else continue.
    """
    recent = best_sharpes[-config.stall_iterations :]
    gains = [b - a for a, b in zip(best_sharpes[-2:], best_sharpes[-1:], strict=False)]
    rules = {
        "exhausted": iterations >= config.max_iterations,
        "no-candidate": n_total == n_invalid,
        "stalled": len(recent) == config.stall_iterations and max(recent) - min(recent) < config.stall_range,
        "small-gain": len(best_sharpes) > 1 and 0 <= gains[-1] < config.diminishing,
    }
    reason = next((name for name, holds in rules.items() if holds), "continue")
    return reason != "continue", reason


def final_summary(history: list[dict], best: list[dict], front: list[dict], config: Stopping = Stopping()) -> dict:
    """The closing report of a search. history: {iteration, sharpe} of the best factor by iteration; best: {factor, sharpe} of the library."""
    ranked = sorted(best, key=lambda x: -x["sharpe"])[:5]
    gain = history[-1]["sharpe"] - history[0]["sharpe"] if len(history) >= 3 else 0.0
    top = ranked[0]["sharpe"] if ranked else 0.0
    worth = top >= config.worth_keeping or gain > 0.1
    why = f"best Sharpe {top:.4f}" + (f", gained {gain:.4f} over {len(history)} iterations" if gain else "")
    return {"iterations": len(history), "optimization_log": history, "best_factors": [{"factor": b["factor"], "sharpe": b["sharpe"]} for b in ranked], "pareto_frontier": front, "worth_keeping": worth, "worth_keeping_rationale": why}


def mermaid(nodes: list[dict], edges: list[dict]) -> str:
    """The lineage graph: nodes (id, sharpe) and edges (from, to, transformation)."""
    key = lambda s: "n_" + re.sub(r"\W", "_", s)
    lines = ["graph TD"]
    for n in nodes:
        shown = f"S={n['sharpe']:.3f}" if n.get("sharpe") is not None else "no metrics"
        lines.append(f'    {key(n["id"])}["{n["id"]}<br/>{shown}"]')
    lines += [f"    {key(e['from'])} -->|{e['transformation']}| {key(e['to'])}" for e in edges]
    return "\n".join(lines) + "\n"


def graph_of_bests(best: list[dict]) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of a search of which only each iteration's best (iteration, factor, sharpe) is known: a chain."""
    nodes = [{"id": f"{b['iteration']}: {b['factor']}", "sharpe": b["sharpe"], "iteration": b["iteration"]} for b in best]
    return nodes, [{"from": a["id"], "to": z["id"], "transformation": "next best"} for a, z in zip(nodes, nodes[1:], strict=False)]


def _table(head: list[str], rows: list[list]) -> list[str]:
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:.4f}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return [line(head), line(["-"] * len(head)), *(line(r) for r in rows), ""]


def document(nodes: list[dict], edges: list[dict], front: list[dict], config: Config = Config(), when: str = "") -> str:
    """The report of a search as Markdown: its settings, the lineage graph, the Pareto frontier, the factors by Sharpe and what each transform has done. A node without metrics is shown without."""
    b = config.backtest
    out = ["# Factor search", "", *([f"Written {when}.", ""] if when else []), "## Settings", ""]
    out += _table(["setting", "value"], [[k, getattr(b, k)] for k in ("universe", "start_date", "end_date", "holding_days", "cost_bps", "n_quantiles", "long_pct", "short_pct", "lookback_min_days", "exclude_st")])
    out += ["## Lineage", "", "```mermaid", mermaid(nodes, edges).rstrip(), "```", "", "## Pareto frontier", "", "Factors that none betters in Sharpe, turnover and drawdown together.", ""]
    out += _table(["factor", "sharpe", "turnover", "max_drawdown"], [[x.get(c) for c in ("factor", "sharpe", "turnover", "max_drawdown")] for x in front])
    out += ["## Factors", ""]
    ranked = sorted(nodes, key=lambda n: (n.get("sharpe") is None, -(n.get("sharpe") or 0.0), n["id"]))
    out += _table(["factor", "expression", "sharpe", "ic_mean", "turnover", "classification", "iteration"], [[n.get(c) for c in ("id", "expression", "sharpe", "ic_mean", "turnover", "classification", "iteration")] for n in ranked])
    sharpe = {n["id"]: n.get("sharpe") for n in nodes}
    by: dict[str, list[float]] = {}
    for e in edges:
        a, z = sharpe.get(e["from"]), sharpe.get(e["to"])
        by.setdefault(e["transformation"], []).extend([z - a] if a is not None and z is not None else [])
    out += ["## Transforms", ""]
    out += _table(["transform", "tried", "mean change of Sharpe"], [[t, len(x), sum(x) / len(x) if x else None] for t, x in sorted(by.items())])
    return "\n".join(out)


def write_json(path: str, value) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
