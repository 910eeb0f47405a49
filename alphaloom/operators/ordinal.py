"""Spearman correlations of many series: blocks of series against blocks, as products of rank matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.plans.stored import few, on_executors, stored

#: Series in a block: of 2,500 dates some 5 MB.
BLOCK = 256


def order_of(series: np.ndarray) -> np.ndarray:
    """The places of each series by value, equal ones by place, missing ones last."""
    return np.argsort(series, axis=1, kind="stable")  # NaN sorts last


def correlations(one: np.ndarray, other: np.ndarray, least: int) -> np.ndarray:
    """Correlation of the ranks of each series of one with each of other on the places that both have, NaN for fewer than `least` of them. Ranks are 1, 2, ... by value, then by place.

    Two series of the same places have their ranks once for all; their products are one matrix product. For others the
    ranks are counted among the common places, along each one's order.
    """
    there = [~np.isnan(x) for x in (one, other)]
    order = [order_of(x) for x in (one, other)]
    ranks = []
    for own, at in zip(there, order, strict=True):
        r = np.empty(own.shape)
        np.put_along_axis(r, at, np.arange(1.0, own.shape[1] + 1)[None, :].repeat(len(own), 0), axis=1)
        ranks.append(np.where(own, r, 0.0))
    n = there[0].astype(float) @ there[1].astype(float).T
    own_n = [x.sum(axis=1) for x in there]
    alike = (n == own_n[0][:, None]) & (n == own_n[1][None, :])
    # Sums of squared differences of ranks: whole numbers, exact.
    apart = 2 * n * (n + 1) * (2 * n + 1) / 6 - 2 * (ranks[0] @ ranks[1].T)
    for a in np.nonzero((~alike).any(axis=1))[0]:
        b = np.nonzero(~alike[a] & (n[a] >= least))[0]
        if not len(b):
            continue
        both = there[0][a][None, :] & there[1][b]
        mine, theirs = np.zeros(both.shape), np.zeros(both.shape)
        mine[:, order[0][a]] = np.cumsum(both[:, order[0][a]], axis=1)
        np.put_along_axis(theirs, order[1][b], np.cumsum(np.take_along_axis(both, order[1][b], axis=1), axis=1).astype(float), axis=1)
        apart[a, b] = (np.where(both, mine - theirs, 0.0) ** 2).sum(axis=1)
    with np.errstate(all="ignore"):
        return np.where(n >= max(least, 2), 1 - 6 * apart / (n * n * n - n), np.nan)


def _pieces(width: int, least: int):
    """Rows (i, j, left, factor, places, values), by piece, to (a, b, corr). In a piece of i = j all are left ones."""

    def matrix(rows: list[tuple]) -> np.ndarray:
        out = np.full((len(rows), width), np.nan)
        for own, r in zip(out, rows, strict=True):
            own[np.array(r[2], int)] = r[3]
        return out

    def computed(piece: tuple, held: list[tuple]) -> pa.RecordBatch:
        inner = piece[0] == piece[1]
        one = sorted((h for h in held if h[0]), key=lambda h: h[1])
        other = one if inner else sorted((h for h in held if not h[0]), key=lambda h: h[1])
        found = correlations(matrix(one), matrix(other), least) if one and other else np.empty((0, 0))
        keep = ~np.isnan(found)
        x, y = np.nonzero(np.triu(keep, 1) if inner else keep)
        pairs = [sorted((one[i][1], other[j][1])) for i, j in zip(x, y, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), pa.array(found[x, y], pa.float64())], names=["a", "b", "corr"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("i", "j", "left", "factor", "places", "values")), strict=True):
                if row[:2] != piece:
                    if held:
                        yield computed(piece, held)
                    piece, held = row[:2], []
                held.append(row[2:])
        if held:
            yield computed(piece, held)

    return run


def spearman_pairs(ics: DataFrame, least: int = 5) -> DataFrame:
    """a, b, corr of factors a < b: correlation of the ranks of their ICs (to nine places) on the dates both have; ties are ranked by date. Pairs with fewer common dates than `least` are left out.

    ics: factor, date, ic, one a factor and date at most. Each series goes to as many pieces as there are blocks; no row is made for a pair and date.
    """
    on_executors(ics.sparkSession)
    ics = stored(ics.select("factor", "date", F.round("ic", 9).alias("ic")).where("ic is not null"))
    # Dates are numbered in one task: one row each.
    days = stored(ics.select("date").distinct().withColumn("place", F.row_number().over(Window.orderBy("date")) - 1))
    placed = ics.join(few(days), "date").groupBy("factor").agg(F.array_sort(F.collect_list(F.struct("place", "ic"))).alias("own"))
    series = stored(placed.select("factor", F.col("own.place").alias("places"), F.col("own.ic").alias("values")))
    blocks = max(1, -(-series.count() // BLOCK))
    own = F.pmod(F.xxhash64("factor"), F.lit(blocks))
    with_each = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"), (own <= k).alias("left")))
    pieces = series.select("factor", "places", "values", F.inline(with_each)).repartition("i", "j").sortWithinPartitions("i", "j")
    return pieces.mapInArrow(_pieces(days.count(), least), "a string, b string, corr double").select("a", "b", F.round("corr", 4).alias("corr"))
