import json
import random
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from alphaloom import commands
from alphaloom.config import Backtest, Config
from alphaloom.operators import backtest, diagnose, memory, report, search, validate
from alphaloom.plans import stored
from alphaloom.sources import bars, records

SPECS = [
    {"name": "momentum", "expression": "returns(close, 10)", "rationale": "trend"},
    {"name": "range", "expression": "(high - low) / close"},
    {"name": "broken", "expression": "no_such(close"},
    {"name": "late", "expression": "delay(close, -1)"},
]


@pytest.fixture(scope="module")
def grid(spark):
    return bars.grid(bars.synthetic(spark, 300, 20)).cache()


def test_a_bad_formula_does_not_end_the_batch(grid):
    rows = {r.factor: r for r in backtest.run_batch(grid, {s["name"]: s["expression"] for s in SPECS}).collect()}
    assert set(rows) == {"momentum", "range", "broken", "late"}
    assert rows["momentum"].error is None and rows["momentum"].sharpe is not None
    assert rows["broken"].error.startswith("formula: ") and rows["late"].error.startswith("formula: ") and rows["late"].sharpe is None
    assert [r.error[:7] for r in backtest.run_batch(grid, {"x": "?"}).collect()] == ["formula"]


def test_factor_lists_and_summaries(spark, tmp_path):
    path = tmp_path / "factors.json"
    path.write_text("﻿" + json.dumps([*SPECS, SPECS[0]]), encoding="utf-8")
    specs = records.read_factors(str(path))
    assert len(specs) == 5 and records.factor_table(spark, specs).count() == 4
    for bad in ("{}", '[{"name": "x"}]', "[1]"):
        path.write_text(bad)
        with pytest.raises(ValueError, match="factor|list"):
            records.read_factors(str(path))
    results = validate.validate(bars.grid(bars.toy(spark, 60)), SPECS)
    told = validate.batch_summary(results)
    assert (told["total"], told["passed"], told["failed"]) == (4, 2, 2) and [r["ok"] for r in told["results"]] == [True, True, False, False]
    assert told["results"][0]["eval_time_ms"] > 0 == told["results"][2]["eval_time_ms"]


def test_history_grows_by_iterations_and_replaces_its_own(spark, tmp_path):
    path = str(tmp_path / "history")
    assert records.read_history(spark, path) is None and records.next_iteration(None) == 1
    rows = lambda *names: spark.createDataFrame([(n, 1.0) for n in names], "factor string, sharpe double")
    records.append_iteration(rows("a", "b"), path, 1)
    records.append_iteration(rows("c"), path, records.next_iteration(records.read_history(spark, path)))
    records.append_iteration(rows("d", "e"), path, 2)
    assert sorted((r.iteration, r.factor) for r in records.read_history(spark, path).collect()) == [(1, "a"), (1, "b"), (2, "d"), (2, "e")]
    assert sorted(r.factor for r in diagnose.latest(records.read_history(spark, path)).collect()) == ["d", "e"]


def test_details_are_four_tables(spark, grid, tmp_path):
    config = Backtest()
    scores = backtest.scored(grid, {"momentum": "returns(close, 10)"}, config)
    legs = backtest.legs(scores, config)
    records.write_details(str(tmp_path), grid, backtest.period_returns(legs, config), backtest.daily_ic(scores), backtest.position_log(legs))
    read = lambda n: spark.read.option("header", True).csv(str(tmp_path / n))
    assert read("market_data").count() == 300 * 20
    periods = read("portfolio_returns").select(F.col("period").cast("int").alias("p")).agg(F.min("p"), F.max("p"), F.count("*")).first()
    assert periods[0] == 0 and periods[1] == periods[2] - 1
    assert read("ic_series").columns == ["factor", "period", "ic"] and read("positions").columns == ["factor", "date", "symbol", "score", "side"]


def test_runs_are_scanned_newest_first(spark, tmp_path):
    best = lambda *x: json.dumps({"best_factors": [{"factor": f, "expression": e, "sharpe": s} for f, e, s in x], "worth_keeping": True})
    files = {"run_1": best(("a", "x  +1", 0.5), ("b", "y", 0.9)), "run_2": best(("c", "x +1", 0.5)), "run_3": "not json", "run_4": json.dumps({"best_factors": []}), "other": best(("z", "z", 9.0))}
    for name, text in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "final_summary.json").write_text(text)
    (tmp_path / "run_5").mkdir()
    found = records.scan_runs(spark, str(tmp_path))
    assert [(r.run, r.factor) for r in found.collect()] == [("run_2", "c"), ("run_1", "a"), ("run_1", "b")]
    assert [(r.run, r.factor) for r in report.library(found).collect()] == [("run_1", "b"), ("run_2", "c")]
    (tmp_path / "run_1" / "candidates.json").write_text("[]")
    assert records.clean(str(tmp_path / "run_1")) == ["candidates.json"] and not (tmp_path / "run_1" / "candidates.json").exists() and (tmp_path / "run_1" / "final_summary.json").exists()


def test_memory_is_kept_by_versions(spark, tmp_path):
    path = str(tmp_path / "memory")
    known = memory.load(spark, path)
    assert {n: t.count() for n, t in known.items()} == {n: 6 if n == "field_usage" else 0 for n in memory.TABLES}
    schema = "factor string, expression string, error string, sharpe double, turnover double, classification string, suggestions array<string>"
    results = spark.createDataFrame([("a", "rank(close)", None, 0.5, 0.9, "promising", ["reduce-turnover"]), ("b", "volume", None, 0.1, 0.2, "weak", []), ("c", "x", "bad", None, None, "invalid", [])], schema)
    pairs = spark.createDataFrame([("a", "b", 0.95), ("a", "c", -0.95)], "a string, b string, corr double")
    for i in (1, 2):
        assert memory.save(memory.learn(memory.load(spark, path), results, pairs, i), path) == i
    known = memory.load(spark, path)
    rows = lambda n, *c: sorted(tuple(r) for r in known[n].select(*c).collect())
    assert rows("successes", "pattern", "avg_sharpe", "times_seen") == [("rank(close)", 0.5, 2)] and rows("failures", "pattern", "times_failed") == [("volume", 2), ("x", 2)]
    assert rows("best_history", "iteration", "factor", "sharpe") == [(1, "a", 0.5), (2, "a", 0.5)] and rows("error_log", "iteration", "factor") == [(1, "c"), (2, "c")]
    assert rows("high_correlation_pairs", "iteration", "a", "b") == [(1, "a", "b"), (2, "a", "b")] and rows("high_turnover_structures", "factor") == rows("stability_improvements", "factor") == [("a",), ("a",)]
    assert dict(rows("field_usage", "field", "n"))["close"] == 2
    more = memory.ingest(known, spark.createDataFrame([("rank(close)", "why"), ("low", ""), ("low", None)], "expression string, rationale string"))
    assert [tuple(r) for r in more["successes"].collect()] == [("rank(close)", round(1.0 / 3, 4), 3)] and {r.field: r.n for r in more["field_usage"].collect()}["low"] == 2


def test_what_transforms_have_done(spark):
    rows = [("a_v1_flip_sign", 0.5, None), ("b", -0.3, "flip-sign"), ("c_v2_simplify", 0.1, None), ("d", 0.4, "custom"), ("e_llm_Long-Only", 0.8, None)]
    got = memory.transform_effect(spark.createDataFrame(rows, "factor string, sharpe double, transformation string"), ["flip-sign", "simplify", "long-only"])
    assert sorted(tuple(r) for r in got.collect()) == [("flip-sign", 2, 0.1), ("long-only", 1, 0.8)]


def test_nodes_take_metrics(spark):
    schema = "id string, expression string, iteration int, classification string, sharpe double, ic_mean double, turnover double, annual_return double, max_drawdown double"
    nodes = spark.createDataFrame([("a", "x", 1, "weak", 0.1, None, None, None, None), ("b", "y", 1, None, None, None, None, None, None), ("d", "w", 2, "", 0.7, None, None, None, None)], schema)
    results = spark.createDataFrame([("a", "x", None, 0.5, 0.1, 0.2, 0.3, -0.1), ("b", "y", "failed", None, None, None, None, None), ("c", "z", None, 0.9, 0.1, 0.2, 0.3, -0.1)], "factor string, expression string, error string, sharpe double, ic_mean double, turnover double, annual_return double, max_drawdown double")
    got = {r.id: (r.expression, r.iteration, r.classification, r.sharpe) for r in memory.upsert_nodes(nodes, results, 3).collect()}
    assert got == {"a": ("x", 1, "weak", 0.5), "b": ("y", 1, None, None), "c": ("z", 3, "backtested", 0.9), "d": ("w", 2, None, 0.7)}


def test_frontier_is_that_of_brute_force(spark):
    r = random.Random(3)
    rows = [(f"f{i}", None, r.randrange(12) / 10, r.randrange(12) / 10, -r.randrange(12) / 10) for i in range(400)] + [("x", "bad", 9.0, 0.0, 0.0), ("y", None, None, None, None)]
    points = [(f, *(v or 0.0 for v in p)) for f, e, *p in rows if e is None]
    beats = lambda q, p: q[1] >= p[1] and q[2] <= p[2] and q[3] >= p[3] and q[1:] != p[1:]
    want = sorted(p[0] for p in points if not any(beats(q, p) for q in points))
    got = report.pareto(spark.createDataFrame(rows, "factor string, error string, sharpe double, turnover double, max_drawdown double").repartition(5))
    assert sorted(x.factor for x in got.collect()) == want


def test_pairs_with_the_same_and_with_other_dates(spark):
    r = random.Random(5)
    series = {f: {d: round(r.uniform(-1, 1), 3) for d in range(1, 29) if not (f == "c" and d % 3 == 0)} for f in "abc"}
    rows = [(f, f"2024-01-{d:02}", v) for f, x in series.items() for d, v in x.items()]
    got = {(x.a, x.b): x["corr"] for x in diagnose.spearman_pairs(spark.createDataFrame(rows, "factor string, date string, ic double")).collect()}

    def by_hand(a, b):
        days = sorted(set(series[a]) & set(series[b]))
        ranks = [{d: i for i, d in enumerate(sorted(days, key=lambda d: (series[f][d], d)))} for f in (a, b)]
        n = len(days)
        return round(1 - 6 * sum((ranks[0][d] - ranks[1][d]) ** 2 for d in days) / (n**3 - n), 4)

    assert got == {p: by_hand(*p) for p in (("a", "b"), ("a", "c"), ("b", "c"))}


def test_repeated_cells_give_the_same_panel_every_time(spark):
    rows = [("2024-01-01", "a", 2.0, 3.0, 1.0, 2.0, 5.0, None), ("2024-01-01", "a", 1.0, 3.0, 1.0, 2.0, None, 7.0), ("2024-01-02", "a", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "date string, symbol string, open double, high double, low double, close double, volume double, amount double").withColumn("date", F.col("date").cast("date"))
    got = {tuple(bars.grid(df.repartition(n)).where("t = 1").first()) for n in (1, 2, 3)}
    assert len(got) == 1 and list(got)[0][3:] == (1.0, 3.0, 1.0, 2.0, 5.0, 7.0)


def test_special_treatment_is_left_out(spark):
    raw = spark.createDataFrame([("20240101", "a", *["1"] * 5, "true"), ("20240101", "b", *["1"] * 5, "false"), ("20240101", "c", *["1"] * 5, None)], "date string, symbol string, open string, high string, low string, close string, volume string, is_st string")
    got = bars.normalise(raw)
    assert sorted(r.symbol for r in bars.select(got, exclude_st=True).collect()) == ["b", "c"] and bars.select(got).count() == 3 and bars.select(got.drop("is_st"), exclude_st=True).count() == 3


def test_search_runs_to_its_end_and_commands_read_what_it_left(spark, grid, tmp_path, capsys):
    config = search.shorter(replace(Config(), transforms=replace(Config().transforms, max_candidates=3)), 2)
    folder = str(tmp_path / "runs" / "run_1")
    left = lambda: set(Path(stored.shared_dir(spark).removeprefix("file:"), "alphaloom").glob("*"))
    before = left()
    told = search.run(spark, grid, SPECS, folder, config)
    assert left() == before  # what iterations store for themselves is gone
    assert told["stopped"] in ("exhausted", "small-gain", "stalled", "no-candidate") and told["best_factors"]
    assert json.loads((tmp_path / "runs" / "run_1" / "final_summary.json").read_text())["stopped"] == told["stopped"]
    page = (tmp_path / "runs" / "run_1" / "search.md").read_text()
    assert all(h in page for h in ("## Settings", "graph TD", "## Pareto frontier", "## Transforms"))
    out = str(tmp_path / "out.json")

    def command(*args):
        commands.main([*args, "--output", out], spark)
        return json.loads((tmp_path / "out.json").read_text())

    (tmp_path / "factors.json").write_text(json.dumps(SPECS))
    assert command("validate", "--factors", str(tmp_path / "factors.json"), "--passed", str(tmp_path / "passed.json"))["passed"] == 2
    assert len(json.loads((tmp_path / "passed.json").read_text())) == 2
    at = ("--history", f"{folder}/history", "--memory", f"{folder}/memory")
    assert command("diagnose", *at[:2])["n_total"] > 0 and command("memory", *at[2:], "--ingest", str(tmp_path / "factors.json"))["fields"]
    assert isinstance(command("generate", *at), list) and "JSON array" in command("suggest", *at)["prompt"]
    assert command("library", "--runs", str(tmp_path / "runs"))["stats"]["n_runs"] == 1


def test_a_search_that_is_cut_off_ends_as_if_nothing_had_happened(spark, grid, tmp_path, monkeypatch):
    config = search.shorter(replace(Config(), transforms=replace(Config().transforms, max_candidates=2)), 2)
    specs = SPECS[:2]

    def left(folder):
        rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
        known = memory.load(spark, f"{folder}/memory")
        history = records.read_history(spark, f"{folder}/history")
        files = [(folder / n).read_text() for n in ("final_summary.json", "search.md")]
        return files, rows(history, "iteration", "factor", "sharpe", "classification"), {n: rows(t, *sorted(t.columns)) for n, t in known.items()}, records.committed(spark, f"{folder}/state")

    whole = tmp_path / "whole"
    search.run(spark, grid, specs, str(whole), config)
    want = left(whole)
    assert want[3]["iteration"] == 2 and len(want[1]) > 2

    class Killed(Exception):
        pass

    # After each write of the second iteration, and of the reports, the loop is killed once.
    cut = tmp_path / "cut"
    search.run(spark, grid, specs, str(cut), search.shorter(config, 1))
    first = json.loads((whole / "state" / "00000001.json").read_text())
    for where in ("append_iteration", "save", "commit", "write_text"):
        records.commit(spark, f"{cut}/state", first, 1)
        (cut / "state" / "00000002.json").unlink(missing_ok=True)
        of = memory if where == "save" else records
        made = getattr(of, where)
        calls = []

        def dies(*args, made=made, calls=calls, where=where, **kw):
            made(*args, **kw)
            calls.append(1)
            if where != "write_text" or len(calls) == 2:  # of reports: the state's file first, then the summary
                raise Killed

        monkeypatch.setattr(of, where, dies)
        with pytest.raises(Killed):
            search.run(spark, grid, [{"name": "other", "expression": "close"}], str(cut), config)
        monkeypatch.setattr(of, where, made)
        search.run(spark, grid, [{"name": "other", "expression": "close"}], str(cut), config)
        assert left(cut) == want, where
    assert search.run(spark, grid, specs, str(cut), config) == json.loads(want[0][0])  # one that has ended stays as it is


def test_commands_from_bars_to_summary(spark, tmp_path):
    """A small sample from one command to the next, with every flag that changes what is computed."""
    out = str(tmp_path / "out.json")

    def command(*args):
        commands.main([*map(str, args), "--output", out], spark)
        return json.loads((tmp_path / "out.json").read_text())

    data = bars.synthetic(spark, 300, 30).withColumn("date", F.date_format("date", "yyyyMMdd")).withColumn("universe", F.when(F.col("symbol") < "STK0020", "big").otherwise("small"))
    data.coalesce(1).write.option("header", True).csv(str(tmp_path / "csv"))
    next((tmp_path / "csv").glob("part-*.csv")).rename(tmp_path / "bars.csv")
    factors = tmp_path / "factors.json"
    factors.write_text(json.dumps([{"name": "test_mom", "expression": "returns(close,5)", "description": "Momentum", "rationale": "Test", "generation": "initial"}, {"name": "bad", "expression": "close +"}]))
    wide = ("--start-date", "20200101", "--end-date", "20301231")
    test = ("backtest", "--factors", factors, "--data", tmp_path / "bars.csv", *wide)
    history = tmp_path / "history"
    rows = {r["factor"]: r for r in command(*test, "--history", history, "--details", tmp_path / "details")}
    assert rows["test_mom"]["error"] is None and rows["bad"]["error"] and spark.read.option("header", True).csv(str(tmp_path / "details" / "market_data")).count() == 9000

    def symbols(*more):
        command(*test, *more, "--details", tmp_path / "d")
        return spark.read.option("header", True).csv(str(tmp_path / "d" / "market_data")).select("symbol").distinct().count()

    (tmp_path / "members.csv").write_text("universe,symbol\n" + "".join(f"X,STK{i:04d}\n" for i in range(12)) + "Y,STK0029\n")
    assert symbols("--universe", "big") == 20 and symbols("--universe", "X", "--members", tmp_path / "members.csv") == 12 and symbols("--members", tmp_path / "members.csv") == 13
    with pytest.raises(ValueError, match="--members"):
        data.drop("universe").write.parquet(str(tmp_path / "plain"))
        command("backtest", "--factors", factors, "--data", tmp_path / "plain", *wide, "--universe", "big")
    assert command(*test, "--start-date", "20230101")[1]["error"].startswith("dates: ")
    shorter = command(*test, "--holding-days", 10, "--cost-bps", 0, "--long-pct", 0.1, "--short-pct", 0.3, "--lookback-min-days", 20, "--n-quantiles", 10, "--include-st")[1]
    assert shorter["coverage"] == 0.4 and shorter["n_periods"] < rows["test_mom"]["n_periods"] / 1.9

    known = tmp_path / "memory"
    assert command("memory", "--memory", known, "--init")["iterations_completed"] == 0
    learned = command("memory", "--memory", known, "--learn", history)
    assert learned["iterations_completed"] == 1 and learned["best"][0]["factor"] == "test_mom" and learned["n_error_log"] == 1
    at = ("--history", history, "--memory", known)
    assert command("stall", *at)["reason"] == "continue" and command("stall", *at, "--max-iterations", 1) == {"should_stop": True, "reason": "exhausted", "iterations": 1}
    assert len(command("generate", *at, "--min-transforms", 1, "--max-transforms", 1)) == 1 and len(command("generate", *at, "--max-candidates", 2)) == 2
    assert command("generate", *at, "--max-parents", 1, "--min-parents", 1, "--no-active-memory")
    asked = command("suggest", *at, "--query", "steady momentum")["prompt"]
    assert all(x in asked for x in ("steady momentum", "returns(close, 5)" if "returns(close, 5)" in asked else "returns(close,5)", "max drawdown", "error: bad", "best of iteration 1: test_mom", "ts_argmax", "turnover"))
    told = command("summary", "--folder", tmp_path)
    assert told["best_factors"][0]["factor"] == "test_mom" and told["iterations"] == 1 and told["stopped"] is None


def test_transforms_are_filled_up_in_their_order():
    from alphaloom.config import Transforms
    from alphaloom.operators.variants import Parent, choose

    assert choose(Parent("p", "rank(close)", 0.5, 0.5)) == ["adjust-lookback", "adjust-normalization", "adjust-clipping", "asymmetric", "reduce-turnover"]
    assert choose(Parent("p", "x", -0.5, 0.9)) == ["flip-sign", "reduce-turnover", "adjust-smoothing", "adjust-lookback", "adjust-normalization"]
    assert choose(Parent("p", "x", 0.1, 0.5, 0.01, -0.02)) == ["adjust-lookback", "adjust-normalization", "adjust-clipping", "long-only", "short-only"]
    assert choose(Parent("p", "x", 0.1, 0.5, suggestions=["Simplify it", "lengthen the lookback"]), Transforms(max_per_parent=9)) == ["adjust-lookback", "adjust-normalization", "adjust-clipping", "simplify", "adjust-smoothing", "asymmetric"]
    # What the rules named but the bound cut off isn't padded with: reduce-turnover is the first that they didn't name.
    assert choose(Parent("p", "x", 0.1, 0.1), Transforms(max_per_parent=2, min_per_parent=4)) == ["adjust-lookback", "adjust-normalization", "reduce-turnover", "adjust-smoothing"]
    assert len(choose(Parent("p", "x"), Transforms(max_per_parent=12, min_per_parent=12))) == 10


def test_passing_tables_end_with_their_block(spark):
    there = lambda df: [Path(f.removeprefix("file:")).exists() for f in df.inputFiles()]
    table = spark.range(9)
    kept = stored.stored(table)
    with pytest.raises(ZeroDivisionError), stored.passing():
        outer = stored.stored(table)
        with stored.passing():
            inner = stored.stored(outer)
            assert inner.count() == 9
        assert all(there(outer)) and not any(there(inner))
        raise ZeroDivisionError
    assert all(there(kept)) and not any(there(outer)) and stored.stored(kept).count() == 9


def test_advice_follows_the_class(spark):
    rows = [(k, k, t) for k, t in (("promising", 0.5), ("promising", 0.61), ("weak", 0.9), ("duplicate", 0.9), ("unstable", 0.9), ("overfit", 0.9), ("invalid", None))]
    df = spark.createDataFrame(rows, "factor string, classification string, turnover double").withColumns({"error": F.lit("no data"), "max_drawdown": F.lit(-0.1), "sharpe": F.lit(-0.9)})
    got = [(r.classification, r.suggestions) for r in diagnose.advise(df).collect()]
    assert got[0] == ("promising", []) and got[1] == ("promising", ["reduce-turnover"]) and got[6] == ("invalid", [])
    assert got[2][1][0].startswith("combine-factors") and "merge" in got[3][1][0] and got[4][1] == ["adjust-smoothing", "adjust-lookback"] and got[5][1] == ["simplify"]


def test_pairs_without_ics_are_told_by_their_formulas(spark):
    found = spark.createDataFrame([("a", "b", 0.5)], "a string, b string, corr double")
    factors = spark.createDataFrame([("a", "rank(close)"), ("b", "rank(open)"), ("c", "rank(close)")], "factor string, expression string")
    assert sorted(tuple(r) for r in diagnose.structural_pairs(factors, found).collect()) == [("a", "c", 1.0), ("b", "c", round(1 / 3, 4))]
