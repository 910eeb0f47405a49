"""The bar store and its data source, infinities, and complexity of formulas."""

import pytest
from pyspark.sql import functions as F

from alphaloom.operators import validate
from alphaloom.plans.compile import evaluate
from alphaloom.sources import bars, store


@pytest.fixture
def kept(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = bars.synthetic(spark, 100, 12).withColumn("is_st", F.when(F.col("symbol") == "STK0003", True))
    store.write(rows, path, 4)
    return path, rows


def test_the_store_returns_what_was_written(spark, kept):
    path, rows = kept
    same = lambda df: sorted((str(r.date), r.symbol, r.close) for r in df.collect())
    assert same(store.read(spark, path)) == same(rows)
    assert same(store.read(spark, path, start="20220201", end="20220331")) == same(bars.select(rows, "20220201", "20220331"))
    assert same(store.read(spark, path, universe="STK0001, STK0011")) == same(rows.where("symbol in ('STK0001', 'STK0011')"))
    assert same(store.read(spark, path, exclude_st=True)) == same(rows.where("symbol <> 'STK0003'"))
    assert store.read(spark, path, universe="none").count() == 0
    some = (F.col("date") >= F.lit("2022-03-10").cast("date")) & (F.col("symbol") == "STK0007")
    assert same(store.read(spark, path).where(some)) == same(rows.where(some))
    assert same(store.read(spark, path).where("symbol > 'STK0009' and close > 50")) == same(rows.where("symbol > 'STK0009' and close > 50"))


def test_parts_that_are_not_wanted_are_not_opened(spark, kept, tmp_path):
    path, rows = kept
    wanted = sorted({r[0] for r in rows.where("symbol = 'STK0007' and date between '2022-03-01' and '2022-03-31'").select("date").distinct().collect()})
    spoiled = 0
    for file in (tmp_path / "store").glob("month=*/range=*/*.parquet"):
        if "month=202203/range=2/" not in str(file):  # the seventh of twelve symbols in ranges of three
            file.write_bytes(b"not parquet")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
            spoiled += 1
    assert spoiled > 10
    by_option = store.read(spark, path, start="20220301", end="20220331", universe="STK0007")
    assert sorted(r.date for r in by_option.collect()) == wanted
    by_filter = store.read(spark, path).where((F.col("date") >= F.lit("2022-03-01").cast("date")) & (F.col("date") <= F.lit("2022-03-31").cast("date")) & (F.col("symbol") == "STK0007"))
    assert sorted(r.date for r in by_filter.collect()) == wanted
    with pytest.raises(Exception, match="[Pp]arquet"):
        store.read(spark, path).count()


def test_infinities_are_told_from_missing_values(spark):
    rows = [(t, "S", x, y) for t, (x, y) in enumerate([(1.0, 0.0), (0.0, 0.0), (None, 0.0), (2.0, 1.0), (-1.0, 2.0), (0.0, None), (3.0, 0.0), (1.0, 1.0)], 1)]
    grid = spark.createDataFrame(rows, "t int, symbol string, close double, volume double").withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("t")))
    made = {
        "q": "close / volume",
        "l": "log(close)",
        "p": "power(close, -1)",
        "s": "close / volume + log(close)",
        "d": "delay(close / volume, 1)",
        "e": "delta(close / volume, 1)",
        "r": "returns(close, 1)",
        "m": "ts_mean(close / volume, 2)",
    }
    out = evaluate(grid, made, told=True).orderBy("t").collect()
    ends = {f: [r.t for r in out if r[f"{f} infinite"]] for f in made}
    assert ends == {"q": [1, 7], "l": [2, 6], "p": [2, 6], "s": [1, 7], "d": [2, 8], "e": [1, 2, 7, 8], "r": [4, 7], "m": []}
    assert all(r[f] is None for r in out for f in made if r[f"{f} infinite"])
    plain = evaluate(grid, made).orderBy("t").collect()
    assert [[r[f] for f in made] for r in plain] == [[r[f] for f in made] for r in out]


def test_a_formula_of_many_infinities_fails(spark):
    grid = bars.grid(bars.toy(spark, 100))
    checked = validate.validate(grid, [{"name": "falls", "expression": "1 / (sign(delta(close, 5)) + 1)"}, {"name": "fine", "expression": "delta(close, 5) / close"}])
    assert any("infinite" in e for e in checked[0].errors) and checked[1].ok


def test_complexity_is_that_of_the_parser(spark):
    of = ["rank(close)", "close", "(close - ts_mean(close, 20)) / ts_std(close, 20)", "rank(ts_mean(delta(close, 1), 5)) * -(open)", ""]
    got = {r.factor: (r.length, r.n_calls, r.depth) for r in validate.complexity(spark.createDataFrame([(e, e) for e in of], "factor string, expression string")).collect()}
    from alphaloom.plans.expr import calls, parse

    assert got == {e: (len(e), calls(parse(e)) if e else 0, validate.parentheses(e)) for e in of}
