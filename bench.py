"""Wall time of the headline queries; one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from alphaloom import queries as q
    from alphaloom.operators import backtest

    batch = {**q.TEMPLATES, **{f"b{i}": e for i, e in enumerate(list(q.FUNCTIONS.values())[:12])}}

    def twenty(s, d):
        return backtest.summary(backtest.scored(q.panel(s, d), batch, q.CONFIG), q.CONFIG)

    run = {"bars": q.QUERIES["bars"], "batch_20_factors": twenty}
    run |= {n: q.QUERIES[n] for n in ("fn_ts_rank", "fn_correlation", "fn_rank", "bt_summary", "bt_daily_ic", "dx_classify", "rp_pareto", "stream_bars")}

    def seconds(f) -> float:
        began = time.time()
        f(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 3)

    took = {name: seconds(f) for name, f in run.items()}
    # The queries share the panel that the first of them writes; cold ones write their own.
    cold = {}
    for name in ("fn_ts_rank", "fn_correlation", "fn_rank", "bt_summary"):
        q.forget()
        cold[name] = seconds(run[name])
    said = {"metric": "total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cold": cold}
    if "--large" in sys.argv:
        said["large"] = large(spark, batch)
    print(json.dumps(said))
    spark.stop()


def large(spark: SparkSession, batch: dict[str, str]) -> dict[str, float]:
    """Seconds over a generated panel of 2,000 dates and 1,000 symbols: the batch together, wide windows, and its factors one by one (no sharing of parts, no common windows); and over one symbol of 10 million bars."""
    from alphaloom.operators import backtest
    from alphaloom.plans import slices
    from alphaloom.plans.compile import evaluate
    from alphaloom.plans.stored import stored
    from alphaloom.sources import bars

    grid = stored(bars.grid(stored(bars.synthetic(spark, 2000, 1000))))
    long = stored(spark.range(10_000_000).selectExpr("cast(id + 1 as int) AS t", "'ONE' AS symbol", "date_add(date'2000-01-01', cast(id / 400 as int)) AS date", "pmod(xxhash64(id), 1000) / 7.0D AS close"))

    def seconds(df) -> float:
        began = time.time()
        df().write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 1)

    out = {"evaluate_20": seconds(lambda: evaluate(grid, batch)), "backtest_20": seconds(lambda: backtest.summary(backtest.scored(grid, batch)))}
    for name in ("ts_mean", "ts_rank", "ts_std", "ts_max"):
        out[f"{name}_252"] = seconds(lambda name=name: evaluate(grid, {"x": f"{name}(close, 252)"}))
    out["one_symbol_10m_ts_std_20"] = seconds(lambda: slices.add(long, {"x": slices.Rolling("ts_std", ("close",), 20)}))
    out["evaluate_20_one_by_one"] = round(sum(seconds(lambda n=n, e=e: evaluate(grid, {n: e})) for n, e in batch.items()), 1)
    return out


if __name__ == "__main__":
    main()
