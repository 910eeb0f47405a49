"""Rolling functions over a panel cut along time: a symbol's history is spread over as many tasks as it has slices.

A slice is SLICE dates of a symbol. It is led by copies of the rows before it that its windows read, and followed by those
after it if a function looks ahead; a row is copied to a neighbour at most. Functions that pad read the last value
however old it is, so each slice is also given the last values before its rows: the last of each slice are found first,
one row a slice, and handed on over the symbol's slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alphaloom.functions import rolling
from alphaloom.plans.stored import on_executors

#: Dates in a slice; a slice and what leads it are held by a task as one array a column.
SLICE = 4096
#: Rows that are computed together, so that short slices share numpy's calls.
_TOGETHER = 65_536
_SLICE, _OWN = "_slice", "_own"


@dataclass(frozen=True)
class Rolling:
    """A rolling function of columns over n dates."""

    function: str
    columns: tuple[str, ...]
    n: int


def add(df: DataFrame, made: dict[str, Rolling]) -> DataFrame:
    """df (t, symbol, ...; one row at most for a date and symbol, t counting dates from 1) with a double column for each of made, null where it has no finite value. One shuffle of df's rows."""
    on_executors(df.sparkSession)
    reached = [rolling.reach(w.function, w.n) for w in made.values()]
    before, after = max(r[0] for r in reached), max(r[1] for r in reached)
    size = max(SLICE, before, after)
    names = sorted({c for w in made.values() for c in w.columns})
    carried = sorted({w.columns[0] for w in made.values() if w.function in rolling.PADDED})
    number, place = F.floor((F.col("t") - 1) / size), (F.col("t") - 1) % size
    to = lambda k, own: F.struct(k.alias(_SLICE), F.lit(own).alias(_OWN))
    copies = [to(number, True)]
    copies += [F.when(place >= size - before, to(number + 1, False))] if before else []
    copies += [F.when((place < after) & (number > 0), to(number - 1, False))] if after else []
    rows = df.select("*", F.inline(F.array_compact(F.array(*copies))))
    if carried:
        rows = rows.unionByName(_carries(df, carried, number, place, size, before), allowMissingColumns=True)
    by = ["symbol", _SLICE]
    out = T.StructType([*df.schema, *(T.StructField(c, T.DoubleType()) for c in made)])
    run = _Run(made, names, carried, size, before, [f.name for f in df.schema])
    return rows.repartition(*by).sortWithinPartitions(*by, "t").mapInArrow(run, out)


def _carries(df: DataFrame, columns: list[str], number, place, size: int, before: int) -> DataFrame:
    """symbol, slice and the columns' last values before the slice's first row here, copies included; no t and no mark of its own."""
    ends = place < size - before  # what the next slice gets no copy of
    last = lambda c, where: F.max_by(F.when(where, F.col(c)), F.when(where & F.col(c).isNotNull(), F.col("t")))
    each = df.groupBy("symbol", number.alias(_SLICE)).agg(*(last(c, F.lit(True)).alias(f"all {c}") for c in columns), *(last(c, ends).alias(f"cut {c}") for c in columns))
    of_symbol = Window.partitionBy("symbol").orderBy(_SLICE)
    # Slices without a row at all don't occur in a dense panel; in another the one before may be further back, and all of its values count.
    near = F.lag(_SLICE).over(of_symbol) == F.col(_SLICE) - 1
    older = of_symbol.rowsBetween(Window.unboundedPreceding, -2)
    since = lambda c: F.coalesce(F.when(near, F.lag(f"cut {c}").over(of_symbol)).otherwise(F.lag(f"all {c}").over(of_symbol)), F.last(f"all {c}", ignorenulls=True).over(older))
    return each.select("symbol", _SLICE, *(since(c).alias(c) for c in columns))


class _Run:
    """Batches of rows by symbol, slice and date to the slices' own rows with the new columns."""

    def __init__(self, made: dict[str, Rolling], names: list[str], carried: list[str], size: int, before: int, kept: list[str]):
        self.made, self.names, self.carried, self.size, self.before, self.kept = made, names, carried, size, before, kept

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= _TOGETHER:
                rows = pa.Table.from_batches(held).combine_chunks()
                starts = self.starts(rows)
                if len(starts) > 1:  # the last slice may go on
                    yield from self.computed(rows.slice(0, int(starts[-1])), starts[:-1])
                    rows = rows.slice(int(starts[-1]))
                held = rows.to_batches()
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from self.computed(rows, self.starts(rows))

    @staticmethod
    def starts(rows: pa.Table) -> np.ndarray:
        """Where each slice begins."""
        changed = np.zeros(rows.num_rows, bool)
        changed[0] = True
        for name in ("symbol", _SLICE):
            column = rows[name].combine_chunks()
            differs = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)), False).to_numpy(zero_copy_only=False)
            changed[1:] |= differs
        return np.nonzero(changed)[0]

    def computed(self, rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        number = lambda name: rows[name].combine_chunks().to_numpy(zero_copy_only=False)
        series = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, rows.num_rows]))
        t, slices = number("t").astype(float), number(_SLICE)
        dated = ~np.isnan(t)
        at = np.where(dated, t - 1 - slices * self.size + self.before, 0).astype(int)
        low = int(at[dated].min()) if dated.any() else 0
        width = int(at[dated].max()) - low + 1 if dated.any() else 0
        columns, before = {}, {}
        for name in self.names:
            values = number(name).astype(float)
            columns[name] = np.full((len(starts), width), np.nan)
            columns[name][series[dated], at[dated] - low] = values[dated]
            if name in self.carried:
                before[name] = np.full(len(starts), np.nan)
                before[name][series[~dated]] = values[~dated]
        # Windows may begin in another slice: then at least `before` dates lead.
        first = slices[starts] * self.size - self.before + low
        last = np.full(len(starts), -1)
        np.maximum.at(last, series[dated], at[dated] - low)
        of = rolling.Slice(columns, first, before, last)
        own = rows[_OWN].combine_chunks().fill_null(False)
        keep = own.to_numpy(zero_copy_only=False)
        out = rows.filter(own).select(self.kept)
        for name, w in self.made.items():
            values = of.compute(w.function, list(w.columns), w.n)[series[keep], at[keep] - low]
            out = out.append_column(name, pa.array(values, pa.float64(), mask=~np.isfinite(values)))
        yield from out.combine_chunks().to_batches()
