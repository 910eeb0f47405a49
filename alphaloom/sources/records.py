"""What a search reads and leaves: lists of factors, the history of its iterations, tables of details, and its runs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.plans.stored import drop

FACTOR = "name string, expression string, description string, rationale string, generation string, parent string, transformation string"
#: The files of an iteration that a finished run doesn't keep.
INTERMEDIATE = ("candidates.json", "validated_factors_passed.json", "next_candidates.json", "transform_prompt.md", "llm_response.json")
_BEST = "struct<best_factors:array<struct<factor:string,expression:string,sharpe:double>>,worth_keeping:boolean,query:string>"


def read_factors(path: str) -> list[dict]:
    """The specs of a JSON array, with or without a byte order mark. Anything but an array of objects that name a factor and its expression is an error."""
    with open(path, encoding="utf-8-sig") as f:
        found = json.load(f)
    if not isinstance(found, list):
        raise ValueError(f"{path}: a list of factors is wanted, not {type(found).__name__}")
    for i, spec in enumerate(found):
        if not isinstance(spec, dict) or not spec.get("name") or not spec.get("expression"):
            raise ValueError(f"{path}: factor {i} has no name or no expression")
    return found


def factor_table(spark: SparkSession, specs: list[dict]) -> DataFrame:
    """The specs as rows (FACTOR); of repeated names the first counts."""
    names = [c.split()[0] for c in FACTOR.split(", ")]
    distinct = {s["name"]: s for s in reversed(specs)}
    return spark.createDataFrame([tuple(None if s.get(n) is None else str(s[n]) for n in names) for s in reversed(distinct.values())], FACTOR)


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names of what is in a folder; none if it isn't there."""
    at, fs = _at(spark, path)
    return sorted(str(x.getPath().getName()) for x in fs.listStatus(at)) if fs.exists(at) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: it is written beside its place and then moved there."""
    at, fs = _at(spark, path)
    beside, _ = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if not fs.rename(beside, at):  # where there is a file already
        fs.delete(at, False)
        if not fs.rename(beside, at):
            raise OSError(f"{path} can't be written")


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _at(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").removeprefix("\ufeff")
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, state: dict, number: int) -> None:
    """The state as number `number` of the folder: one file that names what belongs together, moved to its place when all of that is written."""
    write_text(spark, f"{path.rstrip('/')}/{number:08d}.json", json.dumps(state, ensure_ascii=False))


def committed(spark: SparkSession, path: str) -> dict | None:
    """The last state of the folder, None before the first."""
    found = [n for n in names(spark, path) if n.endswith(".json")]
    return json.loads(read_text(spark, f"{path.rstrip('/')}/{found[-1]}")) if found else None


def read_history(spark: SparkSession, path: str) -> DataFrame | None:
    """All iterations of the folder, or None before the first."""
    return spark.read.option("mergeSchema", True).parquet(path) if exists(spark, path) else None


def next_iteration(history: DataFrame | None) -> int:
    """One more than the last iteration."""
    return 1 if history is None else (history.agg(F.max("iteration")).first()[0] or 0) + 1


def append_iteration(results: DataFrame, path: str, iteration: int) -> None:
    """results added to the history as this iteration; what it held for the iteration is replaced, other iterations aren't read or written."""
    results.drop("iteration").write.mode("overwrite").parquet(f"{path.rstrip('/')}/iteration={iteration}")


def write_details(path: str, bars: DataFrame, periods: DataFrame, ics: DataFrame, positions: DataFrame) -> dict[str, DataFrame]:
    """Four tables as CSV folders: market_data, portfolio_returns (factor, period, return), ic_series (factor, period, ic) and positions (factor, date, symbol, score, side). Periods count from 0 within a factor."""
    nth = lambda: (F.row_number().over(Window.partitionBy("factor").orderBy("date")) - 1).alias("period")
    tables = {
        "market_data": bars,
        "portfolio_returns": periods.select("factor", nth(), F.col("period_return").alias("return")),
        "ic_series": ics.select("factor", nth(), "ic"),
        "positions": positions.select("factor", "date", "symbol", "score", "side"),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/{name}")
    return tables


def scan_runs(spark: SparkSession, path: str) -> DataFrame:
    """run, worth_keeping, query, factor, expression, sharpe of the best factors in the final_summary.json of every run_* folder, newest run first by name; files that can't be read, and runs without best factors, are left out.

    Files are read as rows by the executors, so that their number doesn't matter to the driver.
    """
    files = spark.read.option("pathGlobFilter", "final_summary.json").option("recursiveFileLookup", True).text(path, wholetext=True)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"/(run_[^/]*)/final_summary\.json$", 1)
    found = files.select(run.alias("run"), F.from_json(F.regexp_replace("value", "^﻿", ""), _BEST).alias("s")).where("run <> '' and s.best_factors is not null")
    rows = found.select("run", F.coalesce("s.worth_keeping", F.lit(False)).alias("worth_keeping"), F.coalesce("s.query", F.lit("")).alias("query"), F.explode("s.best_factors").alias("b"))
    return rows.select("run", "worth_keeping", "query", "b.factor", F.coalesce("b.expression", "b.factor").alias("expression"), "b.sharpe").orderBy(F.desc("run"), "factor")


def clean(path: str) -> list[str]:
    """Deletes the intermediate files of a run's folder, and tells which there were."""
    spark = SparkSession.active()
    there = [n for n in INTERMEDIATE if n in names(spark, path)]
    for name in there:
        drop(spark, f"{path.rstrip('/')}/{name}")
    return there


def drop_history(spark: SparkSession, path: str) -> None:
    drop(spark, path)
