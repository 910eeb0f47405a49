"""Bars, and the dense panel on which windows run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.plans.expr import FIELDS

NUMBERS = ("open", "high", "low", "close", "volume", "amount")


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars of a CSV file with a header, its columns in any order, all read as text: date (yyyyMMdd), symbol and numbers, which normalise() reads; is_st and universe if there are such columns."""
    return normalise(spark.read.option("header", True).csv(path))


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalise(spark.read.parquet(path))


def normalise(raw: DataFrame) -> DataFrame:
    """date, symbol and six doubles. Column names in any case and with blanks; text that is no number and NaN are null; amount is close * volume where it is missing; rows without open, high, low or close go."""
    named = raw.select(*(F.col(f"`{c}`").alias(c.strip().lower()) for c in raw.columns))
    if "amount" not in named.columns:
        named = named.withColumn("amount", F.lit(None).cast("double"))
    date = F.coalesce(F.try_to_date(F.col("date").cast("string"), "yyyyMMdd"), F.try_to_date(F.col("date").cast("string"), "yyyy-MM-dd"))
    numbers = [F.col(f).try_cast("double").alias(f) for f in NUMBERS]
    marks = [m for m in ("is_st", "universe") if m in named.columns]
    df = named.select(date.alias("date"), F.col("symbol").cast("string").alias("symbol"), *numbers, *(F.col(m).try_cast("boolean" if m == "is_st" else "string").alias(m) for m in marks))
    df = df.select("date", "symbol", *(F.when(~F.isnan(f), F.col(f)).alias(f) for f in NUMBERS), *marks)
    df = df.withColumn("amount", F.coalesce("amount", F.col("close") * F.col("volume")))
    return df.na.drop(subset=["date", "symbol", "open", "high", "low", "close"])


def select(bars: DataFrame, start: str | None = None, end: str | None = None, universe: DataFrame | None = None, exclude_st: bool = False) -> DataFrame:
    """Bars from start to end (yyyyMMdd, inclusive) of the universe's symbols; these predicates reach the scan. exclude_st: without those that a column is_st marks, if there is one."""
    if start:
        bars = bars.where(F.col("date") >= F.to_date(F.lit(start), "yyyyMMdd"))
    if end:
        bars = bars.where(F.col("date") <= F.to_date(F.lit(end), "yyyyMMdd"))
    if exclude_st and "is_st" in bars.columns:
        bars = bars.where(~F.coalesce("is_st", F.lit(False)))
    return bars if universe is None else bars.join(universe, "symbol", "left_semi")


def from_trades(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Weekly bars by brand from line items: price is extended price over quantity, in the order of shipping date, order, line and price."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    trades = lineitem.where(F.col("l_quantity") > 0).select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", price.alias("price"))
    sold = trades.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    key = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "price")
    week = F.date_trunc("week", "l_shipdate").cast("date")
    return sold.groupBy(week.alias("date"), F.col("p_brand").alias("symbol")).agg(
        F.min_by("price", key).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", key).alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("amount"),
    )


def grid(bars: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """date, t, symbol and fields of every date and symbol of bars; t numbers the dates from 1. Of repeated cells the row counts that comes first by its values, field by field those that aren't null.

    The dates are few (one row each), so numbering them in one task is cheap; the symbols are checked before they are sent along.
    """
    fields = list(FIELDS) if fields is None else fields
    dates = bars.select("date").distinct().withColumn("t", F.row_number().over(Window.orderBy("date")))
    symbols = bars.select("symbol").distinct()
    # By their values and not as they come: rows have no order of their own, and a rerun must give the same.
    cells = bars.groupBy("date", "symbol").agg(*(F.min_by(f, F.struct(F.col(f).isNull(), *fields)).alias(f) for f in fields))
    # A symbol's dates are spread over rows by arrays of the calendar, each of some thousand dates: as many rows as the panel has.
    calendar = dates.groupBy(F.floor(F.col("t") / 4096)).agg(F.array_sort(F.collect_list(F.struct("t", "date"))).alias("days"))
    days = symbols.crossJoin(F.broadcast(calendar.select("days"))).select("symbol", F.explode("days").alias("d")).select("d.date", "d.t", "symbol")
    return days.join(cells, ["date", "symbol"], "left").select("date", "t", "symbol", *fields)


def toy(spark: SparkSession, days: int = 252, symbols: int = 5) -> DataFrame:
    """The small panel on which formulas are tried: a year of five symbols."""
    return synthetic(spark, days, symbols)


def synthetic(spark: SparkSession, days: int = 500, symbols: int = 100, seed: int = 42) -> DataFrame:
    """Random-walk bars on business days from 2022-01-03: a market, a sector and an own part. The same for a seed."""
    day = spark.range(days).select((F.col("id") + 1).cast("int").alias("t"), (F.randn(seed) * 0.01).alias("market"))
    day = day.withColumn("date", F.date_add(F.lit("2022-01-03").cast("date"), (F.col("t") - 1 + 2 * F.floor((F.col("t") - 1) / 5)).cast("int")))
    rows = spark.range(symbols).select(F.format_string("STK%04d", F.col("id")).alias("symbol"), (0.5 + F.rand(seed + 1)).alias("beta"), (F.randn(seed + 2) * 1e-4).alias("drift"))
    cells = rows.crossJoin(F.broadcast(day)).withColumn("r", F.col("drift") + F.col("beta") * F.col("market") + F.randn(seed + 3) * 0.015)
    walk = Window.partitionBy("symbol").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("close", 50 * F.exp(F.sum("r").over(walk)))
    cells = cells.withColumn("open", F.col("close") * (1 + F.randn(seed + 4) * 0.003))
    cells = cells.withColumn("high", F.greatest("open", "close") * (1 + F.abs(F.randn(seed + 5)) * 0.004)).withColumn("low", F.least("open", "close") * (1 - F.abs(F.randn(seed + 6)) * 0.004))
    cells = cells.withColumn("volume", F.round(F.exp(13 + F.randn(seed + 7) * 0.4)))
    return cells.select("date", "symbol", "open", "high", "low", "close", "volume", (F.col("close") * F.col("volume")).alias("amount"))
