"""Points that no other point betters, for any number of them: sweeps with staircases instead of a join of all with all.

Points are cut by their first value into rows and by their second into columns. A point that dominates another lies in
a row and a column that aren't worse. If both are better, only the best third value of that cell matters, a table of
rows x columns; if the column is the same, a sweep of the column finds it, and if the row is, one of the row. A sweep
goes through points by falling first (or rising second) value and keeps the staircase of the other two, in which one
search tells whether a point is dominated.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.plans.stored import on_executors, stored

#: Points in a row or column, some; those that are swept in one task.
SWEEP = 100_000
_MOST = 1000


class Staircase:
    """The least second and largest third values so far: by rising x the largest y of any point up to there."""

    def __init__(self):
        self.x: list[float] = []
        self.y: list[float] = []

    def dominates(self, x: float, y: float) -> bool:
        i = bisect_right(self.x, x)
        return i > 0 and self.y[i - 1] >= y

    def add(self, x: float, y: float) -> None:
        i = j = bisect_right(self.x, x)
        if i and self.x[i - 1] == x:
            i -= 1
        while j < len(self.x) and self.y[j] <= y:
            j += 1
        self.x[i:j], self.y[i:j] = [x], [y]


def _swept(group: str, x: str, y: str):
    """The points of each group that no earlier one dominates in x (low) and y (high); rows come by group, best ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stairs = None, Staircase()
        for batch in batches:
            values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (group, x, y)]
            keep = []
            for g, a, b in zip(*values, strict=True):
                if g != last:
                    last, stairs = g, Staircase()
                first = not stairs.dominates(a, b)
                keep.append(first)
                if first:
                    stairs.add(a, b)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _bounds(points: DataFrame, column: str, parts: int) -> list[float]:
    """Values that cut a column into about so many equal parts: a few numbers."""
    cuts = points.approxQuantile(column, [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    return sorted(set(cuts))


def _part(column: str, bounds: list[float]):
    """How many of the bounds a value exceeds."""
    return F.array_size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: F.col(column) > b)) if bounds else F.lit(0)


def undominated(points: DataFrame, high: str, low: str, also_high: str) -> DataFrame:
    """The distinct points (three doubles, none null) that no other is as good as in all three and better in one: high and also_high the larger the better, low the smaller."""
    on_executors(points.sparkSession)
    s, t, d = high, low, also_high
    points = points.select(s, t, d).distinct()
    # Each task's own frontier first: of most tables little is left.
    local = points.sortWithinPartitions(F.desc(s), t, F.desc(d)).withColumn("one", F.lit(0))
    points = stored(local.mapInArrow(_swept("one", t, d), local.schema).drop("one"))
    parts = min(_MOST, -(-points.count() // SWEEP)) or 1
    rows, columns = _bounds(points, s, parts), _bounds(points, t, parts)
    cut = points.withColumn("row", _part(s, rows)).withColumn("col", _part(t, columns))
    if rows and columns:
        # best[r][c]: the largest third value of points in better rows and columns; parts * parts numbers.
        best = np.full((len(rows) + 2, len(columns) + 2), -np.inf)
        for r, c, most in cut.groupBy("row", "col").agg(F.max(d)).collect():
            best[r, c + 1] = most
        best = np.maximum.accumulate(np.maximum.accumulate(best[::-1], axis=0)[::-1], axis=1)
        table = [(r, c, float(best[r + 1, c])) for r in range(len(rows) + 1) for c in range(len(columns) + 1) if best[r + 1, c] > -np.inf]
        beaten = points.sparkSession.createDataFrame(table, "row int, col int, best double")
        cut = cut.join(F.broadcast(beaten), ["row", "col"], "left").where(F.col("best").isNull() | (F.col("best") < F.col(d))).drop("best")
    out = cut.repartition("col").sortWithinPartitions("col", F.desc(s), t, F.desc(d))
    out = out.mapInArrow(_swept("col", t, d), cut.schema)
    if columns:
        # Within a row by rising second value: (worse) first values are turned, so that low is good.
        turned = out.withColumn("turned", -F.col(s)).repartition("row").sortWithinPartitions("row", t, F.desc(s), F.desc(d))
        out = turned.mapInArrow(_swept("row", "turned", d), turned.schema)
    return out.select(s, t, d)
