"""The commands: python -m alphaloom.commands COMMAND. Factors, reports and answers are JSON files, tables are folders."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom import config as settings
from alphaloom.operators import backtest, memory, report, search, validate, variants
from alphaloom.plans.stored import stored
from alphaloom.sources import bars, records


def _config(args: argparse.Namespace) -> settings.Config:
    config = settings.load(args.config) if args.config else settings.Config()

    def chosen(section, names: dict[str, str]):
        given = {k: getattr(args, option, None) for k, option in names.items()}
        return replace(section, **{k: v for k, v in given.items() if v is not None})

    same = lambda *names: {n: n for n in names}
    test = chosen(config.backtest, same("cost_bps", "holding_days", "long_pct", "short_pct", "lookback_min_days", "start_date", "end_date", "universe", "n_quantiles"))
    if getattr(args, "include_st", False):
        test = replace(test, exclude_st=False)
    selection = chosen(config.selection, same("min_parents", "max_parents"))
    transforms = chosen(config.transforms, {"min_per_parent": "min_transforms", "max_per_parent": "max_transforms", "max_candidates": "max_candidates"})
    stopping = chosen(config.stopping, same("max_iterations"))
    return replace(config, backtest=test, selection=selection, transforms=transforms, stopping=stopping)


def _members(spark: SparkSession, args: argparse.Namespace, raw: DataFrame) -> DataFrame | None:
    """The symbols of the universe: those that --members (a CSV file with a header, or a Parquet folder: symbol, and universe if it holds several) has for it, or the data's own column universe. None if neither is there; a universe that is asked for must be."""
    if args.members:
        table = spark.read.option("header", True).csv(args.members) if args.members.endswith(".csv") else spark.read.parquet(args.members)
        of = table.where(F.col("universe") == args.universe) if args.universe and "universe" in table.columns else table
        return of.select(F.col("symbol").cast("string").alias("symbol")).distinct()
    if args.universe and "universe" not in raw.columns:
        raise ValueError(f"--universe {args.universe}: give its symbols by --members, or data with a column universe")
    return raw.where(F.col("universe") == args.universe).select("symbol").distinct() if args.universe else None


def _grid(spark: SparkSession, args: argparse.Namespace, config: settings.Config) -> DataFrame:
    """The panel of --data (a CSV file, or a Parquet folder), or a synthetic one, written once. Dates and universe hold for data only."""
    if not args.data:
        return stored(bars.grid(stored(bars.synthetic(spark))))
    raw = bars.from_csv(spark, args.data) if args.data.endswith(".csv") else bars.from_parquet(spark, args.data)
    b = config.backtest
    kept = bars.select(raw, b.start_date, b.end_date, _members(spark, args, raw), b.exclude_st)
    return stored(bars.grid(stored(kept.drop("universe", "is_st"))))


def _show(value, path: str | None) -> None:
    if path:
        report.write_json(path, value)
    else:
        json.dump(value, sys.stdout, indent=2, ensure_ascii=False, default=str)
        print()


def _validate(spark, args, config):
    specs = records.read_factors(args.factors)
    results = validate.validate(bars.grid(bars.toy(spark)), specs, config.validation)
    if args.passed:
        report.write_json(args.passed, validate.passed(specs, results))
    if args.correction:
        print(validate.correction_prompt(results))
    return validate.batch_summary(results)


def _backtest(spark, args, config):
    specs = records.read_factors(args.factors)
    grid = _grid(spark, args, config)
    done = search.evaluate_batch(grid, specs, config)
    if args.history:
        records.append_iteration(done.results, args.history, records.next_iteration(records.read_history(spark, args.history)))
    if args.details and done.scores is not None:
        legs = backtest.legs(done.scores, config.backtest)
        records.write_details(args.details, grid, backtest.period_returns(legs, config.backtest), done.ics, backtest.position_log(legs))
    return [r.asDict() for r in done.results.orderBy("factor").collect()]


def _diagnose(spark, args, config):
    from alphaloom.operators import diagnose

    last = diagnose.latest(records.read_history(spark, args.history))
    return {**diagnose.counts(last).first().asDict(), **diagnose.best(last).first().asDict(), "factors": [r.asDict() for r in last.select("factor", "classification", "notes", "suggestions").orderBy("factor").collect()]}


def _learned(spark: SparkSession, history: str) -> search.Iteration:
    """The last iteration of a history; how its factors go together is told by their formulas."""
    from alphaloom.operators import diagnose

    every = records.read_history(spark, history)
    if every is None:
        raise ValueError(f"{history}: no history there")
    last = diagnose.latest(every)
    return search.Iteration(last, stored(diagnose.structural_pairs(last.select("factor", "expression"))))


def _memory(spark, args, config):
    known = memory.load(spark, args.memory)
    if args.init:
        memory.save(memory.empty(spark), args.memory)
    if args.learn:
        last = _learned(spark, args.learn)
        memory.save(memory.learn(known, last.results, last.pairs, records.next_iteration(known["best_history"])), args.memory)
    if args.ingest:
        known = memory.load(spark, args.memory)
        memory.save(memory.ingest(known, records.factor_table(spark, records.read_factors(args.ingest))), args.memory)
    known = memory.load(spark, args.memory)
    good, bad = memory.summary(known["successes"], known["failures"])
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  five rows, six fields, one row an iteration
    counts = {f"n_{n}": t.count() for n, t in known.items() if n not in ("field_usage", "best_history")}
    best = rows(known["best_history"].orderBy("iteration"))
    return {"iterations_completed": len(best), **counts, "successes": rows(good), "failures": rows(bad), "fields": rows(memory.field_diversity(known["field_usage"])), "best": best}


def _parents(spark, args, config):
    return search.parents_of(_learned(spark, args.history), memory.load(spark, args.memory), config, not args.no_active_memory)


def _generate(spark, args, config):
    parents, corr = _parents(spark, args, config)
    if args.answer:
        with open(args.answer, encoding="utf-8-sig") as f:
            return variants.read_suggestions(f.read(), parents, config.transforms)
    return variants.generate(parents, corr, config.transforms)


def _suggest(spark, args, config):
    parents, _ = _parents(spark, args, config)
    return {"prompt": variants.prompt(parents, memory.told(memory.load(spark, args.memory)), config.transforms.max_candidates, args.query or "")}


def _stall(spark, args, config):
    from alphaloom.operators import diagnose

    n = diagnose.counts(_learned(spark, args.history).results).first()
    best = [s for _, s in memory.best_so_far(memory.load(spark, args.memory))]
    stop, why = report.should_stop(len(best), n["n_total"], n["n_invalid"], best, config.stopping)
    return {"should_stop": stop, "reason": why, "iterations": len(best)}


def _summary(spark, args, config):
    """The summary of a search's folder as it stands, ended or not; without a committed state, of its history and memory."""
    state = records.committed(spark, f"{args.folder}/state")
    if state is None:
        best = memory.load(spark, f"{args.folder}/memory")["best_history"].orderBy("iteration").collect()
        state = {"iteration": records.next_iteration(records.read_history(spark, f"{args.folder}/history")) - 1, "memory": 1, "tree": None, "best": [r.asDict() for r in best], "stopped": None}
    return search.summarize(spark, args.folder, state, config)[0] | {"query": args.query or ""}


def _search(spark, args, config):
    return search.run(spark, _grid(spark, args, config), records.read_factors(args.factors), args.folder, config)


def _library(spark, args, config):
    kept = report.library(records.scan_runs(spark, args.runs), args.min_sharpe)
    return {"stats": report.library_stats(kept).first().asDict(), "factors": [r.asDict() for r in kept.collect()]}


COMMANDS = {"validate": _validate, "backtest": _backtest, "diagnose": _diagnose, "memory": _memory, "generate": _generate, "suggest": _suggest, "stall": _stall, "summary": _summary, "search": _search, "library": _library}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="alphaloom", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    at = ["history", "memory"]
    wants = {"validate": ["factors"], "backtest": ["factors"], "diagnose": ["history"], "memory": ["memory"], "generate": at, "suggest": at, "stall": at, "summary": ["folder"], "search": ["factors", "folder"], "library": ["runs"]}
    may = {"validate": ["passed"], "backtest": ["history", "details"], "memory": ["ingest", "learn"], "generate": ["answer"], "suggest": ["query"], "summary": ["query"]}
    panel = {"data": str, "start-date": str, "end-date": str, "universe": str, "members": str, "cost-bps": float, "holding-days": int, "n-quantiles": int, "long-pct": float, "short-pct": float, "lookback-min-days": int}
    picked = {"min-parents": int, "max-parents": int, "min-transforms": int, "max-transforms": int, "max-candidates": int}
    typed = {"backtest": panel, "search": panel | picked | {"max-iterations": int}, "generate": picked, "suggest": picked, "stall": {"max-iterations": int}, "library": {"min-sharpe": float}}
    marks = {"backtest": ["include-st"], "search": ["include-st"], "validate": ["correction"], "memory": ["init"], "generate": ["no-active-memory"], "suggest": ["no-active-memory"]}
    for name in COMMANDS:
        c = commands.add_parser(name)
        for option in ("config", "output", *may.get(name, ())):
            c.add_argument(f"--{option}")
        for option in wants[name]:
            c.add_argument(f"--{option}", required=True)
        for option, kind in typed.get(name, {}).items():
            c.add_argument(f"--{option}", type=kind)
        for option in marks.get(name, ()):
            c.add_argument(f"--{option}", action="store_true")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    _show(COMMANDS[args.command](spark or SparkSession.builder.getOrCreate(), args, _config(args)), args.output)


if __name__ == "__main__":
    main()
