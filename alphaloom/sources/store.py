"""Bars kept by month and range of symbols, and the data source that reads them: parts that a query can't need aren't opened.

spark.dataSource.register(BarStore); spark.read.format("alphaloom_bars").option("path", ...).load(). Options: start and
end (yyyyMMdd, inclusive), universe (symbols, comma-separated), exclude_st (true: without what is_st marks). Filters on
date and symbol are pushed down where spark.sql.python.filterPushdown.enabled is set, and prune parts as the options do.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from alphaloom.plans.stored import on_executors
from alphaloom.sources.records import write_text

SCHEMA = "date date, symbol string, open double, high double, low double, close double, volume double, amount double, is_st boolean"
_RANGES = "_ranges.json"


def write(bars: DataFrame, path: str, ranges: int = 16) -> None:
    """bars (of SCHEMA; is_st may be missing) to the folder, replacing what it holds: a folder for each month and range of symbols, about so many ranges of as many symbols each.

    Ranges are cut from the list of symbols, of which only the cuts come to the driver.
    """
    spark = bars.sparkSession
    if "is_st" not in bars.columns:
        bars = bars.withColumn("is_st", F.lit(None).cast("boolean"))
    symbols = bars.select("symbol").where("symbol is not null").distinct().withColumn("nth", F.row_number().over(Window.orderBy("symbol")))
    each = max(1, -(-symbols.count() // ranges))
    cuts = [r["symbol"] for r in symbols.where((F.col("nth") - 1) % each == 0).orderBy("symbol").collect()]
    part = F.array_size(F.filter(F.array(*map(F.lit, cuts)).cast("array<string>"), lambda c: c <= F.col("symbol"))) - 1
    rows = bars.where("date is not null and symbol is not null").withColumns({"month": F.date_format("date", "yyyyMM"), "range": part})
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows.select(*names, "month", "range").repartition("month", "range").sortWithinPartitions("month", "range", "symbol", "date").write.mode("overwrite").partitionBy("month", "range").parquet(path)
    write_text(spark, f"{path.rstrip('/')}/{_RANGES}", json.dumps(cuts))


class _Part(InputPartition):
    def __init__(self, file: str):
        super().__init__(file)
        self.file = file


def _day(text) -> date:
    return text.date() if isinstance(text, datetime) else text if isinstance(text, date) else datetime.strptime(str(text), "%Y%m%d").date()


class BarReader(DataSourceReader):
    """Files by month and range, of which those are read that the bounds on dates and the wanted symbols leave."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.first = _day(options["start"]) if options.get("start") else None
        self.last = _day(options["end"]) if options.get("end") else None
        self.symbols = {s.strip() for s in options["universe"].split(",") if s.strip()} if options.get("universe") else None
        self.exclude_st = str(options.get("exclude_st", "false")).lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the bounds that filters give; all of them are returned, as parts hold other rows too."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "date" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.first = max(x for x in (self.first, _day(f.value)) if x)
            if column == "date" and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.last = min(x for x in (self.last, _day(f.value)) if x)
            if column == "symbol" and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = own if self.symbols is None else self.symbols & own
            yield f

    def partitions(self) -> list[_Part]:
        from bisect import bisect_right

        from pyarrow import fs

        at, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        with at.open_input_stream(f"{root.rstrip('/')}/{_RANGES}") as f:
            cuts = json.loads(f.read())
        wanted = None if self.symbols is None else {bisect_right(cuts, s) - 1 for s in self.symbols}
        out = []
        for info in at.get_file_info(fs.FileSelector(root, recursive=True)):
            keys = dict(x.split("=", 1) for x in info.path.split("/") if "=" in x)
            if not info.path.endswith(".parquet") or not {"month", "range"} <= keys.keys():
                continue
            month, part = keys["month"], int(keys["range"])
            if self.first and month < self.first.strftime("%Y%m") or self.last and month > self.last.strftime("%Y%m") or wanted is not None and part not in wanted:
                continue
            out.append(_Part(info.path))
        return out or [_Part("")]

    def read(self, partition: _Part):
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyarrow import fs

        if not partition.file:
            return
        at = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        with at.open_input_file(partition.file) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=names):
                keep = pc.is_valid(batch["date"])
                for bound, test in ((self.first, pc.greater_equal), (self.last, pc.less_equal)):
                    keep = pc.and_(keep, test(batch["date"], bound)) if bound else keep
                if self.symbols is not None:
                    import pyarrow as pa

                    keep = pc.and_(keep, pc.is_in(batch["symbol"], pa.array(sorted(self.symbols), pa.string())))
                if self.exclude_st:
                    keep = pc.and_(keep, pc.invert(pc.fill_null(batch["is_st"], False)))
                yield batch.filter(keep)


class BarStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "alphaloom_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BarReader:
        return BarReader(self.options)


def read(spark, path: str, **options: str) -> DataFrame:
    """The store's bars, with the options of this module."""
    on_executors(spark)
    spark.dataSource.register(BarStore)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else a source that takes filters is refused
    given = {k: str(v) for k, v in options.items() if v is not None}
    return spark.read.format(BarStore.name()).options(path=path, **given).load()
