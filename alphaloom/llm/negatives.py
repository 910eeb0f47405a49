"""Hard negatives by blocked matrix products: anchors against all rows, in whole numbers.

Anchors are written as blocks of a bounded number of rows. As many blocks at a time as CHUNK allows are broadcast, and
every task multiplies its rows with them, block by block. A first pass keeps each anchor's best rows of its own label,
a second the best rows of other labels whose scores lie in the window of each positive. Both keep their best in the
task, a fixed number for each anchor, and what the tasks have kept is merged by a window limit. Scores are products of
whole numbers in doubles, exact below 2**53; where they could be larger, integers are multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm.common import on_executors, scratch, scratch_path
from alphaloom.llm.vectors import is_finite, matrix, products, usual_length, whole

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: The window of a negative's score in hundredths of the positive's, both ends within.
LOW, HIGH = 50, 95
#: Anchors in a block, rows in a task's block, and anchors that are broadcast at a time (16 MB at 64 components).
ANCHORS, ROWS, CHUNK = 1024, 2048, 32_768
_FAR = np.iinfo(np.int64).max


class Best:
    """The best `keep` of what is offered to each anchor: higher scores first, then smaller ids."""

    def __init__(self, anchors: int, keep: int):
        self.keep = keep
        self.score = np.full((anchors, keep), -np.inf)
        self.id = np.full((anchors, keep), _FAR, np.int64)

    def offer(self, anchors: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: anchors x ids, -inf where a row is none for the anchor."""
        least = self.score[anchors, -1]
        better = (scores >= least[:, None]) & (scores > -np.inf)
        if better.sum() > 8 * self.keep * len(anchors) and len(ids) > self.keep:
            least = np.maximum(least, np.partition(scores, len(ids) - self.keep, axis=1)[:, len(ids) - self.keep])
            better &= scores >= least[:, None]
        row, column = np.nonzero(better)
        if not len(row):
            return
        touched = np.unique(row)
        held = np.repeat(touched, self.keep)
        row = np.r_[held, row]
        score = np.r_[self.score[anchors[touched]].ravel(), scores[row[len(held) :], column]]
        own = np.r_[self.id[anchors[touched]].ravel(), ids[column]]
        order = np.lexsort((own, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < self.keep
        at = anchors[row[first]]
        self.score[at, place[first]], self.id[at, place[first]] = score[order][first], own[order][first]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """vec_ids, labels and whole-number vectors, block by block."""
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            rows = batch.slice(begin, ROWS)
            ids, labels, vectors = (rows.column(rows.schema.get_field_index(n)) for n in ("vec_id", "label", "embedding"))
            yield ids.to_numpy(), labels.to_numpy(), whole(matrix(vectors), SCALE)


_BLOCK = "block string, n int, ids binary, labels binary, vectors binary"


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    n = 0
    for rows in _rows(batches):
        for begin in range(0, len(rows[0]), ANCHORS):
            ids, labels, vectors = (x[begin : begin + ANCHORS] for x in rows)
            values = [pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, vectors.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{n}"]), pa.array([len(ids)], pa.int32()), *values], names=["block", "n", "ids", "labels", "vectors"])
            n += 1


def _chunks(blocks: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The anchors' ids, labels and vectors, CHUNK at most at a time, by label. Of all blocks only names and sizes are collected."""
    names, total = [], 0
    for r in [*blocks.select("block", "n").orderBy("block").collect(), None]:
        if names and (r is None or total + r["n"] > CHUNK):
            held = blocks.where(F.col("block").isin(names)).orderBy("block").collect()
            ids, labels = (np.concatenate([np.frombuffer(h[c], np.int64) for h in held]) for c in ("ids", "labels"))
            vectors = np.concatenate([np.frombuffer(h["vectors"], np.int32).reshape(h["n"], -1) for h in held]).astype(np.int64)
            order = np.lexsort((ids, labels))
            yield ids[order], labels[order], vectors[order]
            names, total = [], 0
        if r is not None:
            names.append(r["block"])
            total += r["n"]


def _positives(anchors, keep: int) -> Callable:
    """The task's best rows of each anchor's label, other than itself: anchor (its place in the chunk), score, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own_labels, own = anchors.value
        best = Best(len(own_ids), keep)
        for ids, labels, vectors in _rows(batches):
            for label in np.intersect1d(labels, own_labels):
                begin, end = np.searchsorted(own_labels, [label, label + 1])
                at = labels == label
                for b in range(begin, end, ANCHORS):
                    which = np.arange(b, min(b + ANCHORS, end))
                    scores = products(own[which], vectors[at]).astype(np.float64)
                    scores[own_ids[which][:, None] == ids[at][None, :]] = -np.inf
                    best.offer(which, scores, ids[at])
        anchor, place = np.nonzero(best.score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(best.score[anchor, place].astype(np.int64)), pa.array(best.id[anchor, place])], names=["anchor", "score", "id"])

    return run


def _negatives(anchors, positives, keep: int, low: int, high: int) -> Callable:
    """The task's best rows of other labels within each positive's window: anchor, positive (its place), score, id. positives: scores by anchor and place, NaN where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own_labels, own = anchors.value
        known = positives.value
        n, places = known.shape
        score = np.nan_to_num(known).astype(np.int64)
        least, most = (np.where(np.isnan(known), np.nan, x) for x in (-(-low * score // 100), high * score // 100))
        best = [Best(n, keep) for _ in range(places)]
        for ids, labels, vectors in _rows(batches):
            for b in range(0, n, ANCHORS):
                which = np.arange(b, min(b + ANCHORS, n))
                scores = products(own[which], vectors).astype(np.float64)
                scores[own_labels[which][:, None] == labels[None, :]] = -np.inf
                for place in range(places):
                    fits = (scores >= least[which, place][:, None]) & (scores <= most[which, place][:, None])
                    some = fits.any(axis=1)  # none where there is no positive: nothing compares with NaN
                    if some.any():
                        best[place].offer(which[some], np.where(fits[some], scores[some], -np.inf), ids)
        for place in range(places):
            anchor, at = np.nonzero(best[place].score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(np.full(len(anchor), place)), pa.array(best[place].score[anchor, at].astype(np.int64)), pa.array(best[place].id[anchor, at])], names=["anchor", "positive", "score", "id"])

    return run


def _first(found: DataFrame, by: list[str], keep: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of rows (vec_id, label, embedding; both numbers are whole).

    An anchor's positives are its best other rows of the same label; of each positive the first rows of other labels are
    returned whose score is from low to high hundredths of the positive's. Higher scores come first, then smaller vec_ids.

    Rows with a null vec_id or label, a null vector or a component that is null or not finite take no part, nor do vectors
    whose length isn't the most frequent one (of equally frequent ones the smaller). Rows of the anchor's own vec_id are
    no others; repeated rows count each, as anchors too. A positive with no row in its window, such as one of a negative score,
    gives no rows. Components beyond 65,536 count as that; scores are exact below 2**53. Other columns are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    on_executors(spark)
    taking = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding", is_anchor.alias("is_anchor"))
    taking = taking.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_finite(F.col("embedding")))
    taking = taking.where(F.size("embedding") == usual_length(taking, "embedding"))
    all_rows = taking.select("vec_id", "label", "embedding")
    blocks = scratch(taking.where("is_anchor").select("vec_id", "label", "embedding").mapInArrow(_to_blocks, _BLOCK))
    out = scratch_path(spark)
    form = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], form).write.parquet(out)
    for ids, labels, vectors in _chunks(blocks):
        anchors = spark.sparkContext.broadcast((ids, labels, vectors))
        found = _first(all_rows.mapInArrow(_positives(anchors, positives), "anchor long, score long, id long"), ["anchor"], positives)
        got = found.toArrow()  # positives * CHUNK rows at most
        at = got["anchor"].to_numpy(), got["rank"].to_numpy() - 1
        score, own = np.full((len(ids), positives), np.nan), np.zeros((len(ids), positives), np.int64)
        score[at], own[at] = got["score"].to_numpy(), got["id"].to_numpy()
        known = spark.sparkContext.broadcast(score)
        mined = all_rows.mapInArrow(_negatives(anchors, known, negatives, low, high), "anchor long, positive long, score long, id long")
        named = spark.createDataFrame(pa.table({"anchor": got["anchor"], "positive": pa.array(at[1].astype(np.int64)), "anchor_id": pa.array(ids[at[0]]), "positive_id": got["id"], "positive_score": got["score"]}))
        best = _first(mined, ["anchor", "positive"], negatives).join(F.broadcast(named), ["anchor", "positive"])
        best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
        anchors.unpersist()
        known.unpersist()
    return spark.read.schema(form).parquet(out)
