"""Product quantisation by heap Lloyd: short codes for vectors, with exact whole-number distances.

A vector's components become floor(256 * x), its parts are assigned to the nearest entry of their position's codebook,
and entries move to the floor of their parts' mean. Parts are kept in blocks, and each block has a heap for every
entry with the parts assigned to it, keyed by their slack: the lower bound of the distance to any other entry less the
upper bound of that to their own. When entries move, a part's slack falls by its entry's drift and the largest drift of
the others at most. These sums only grow, so they are kept for each entry and not for each part: a part's key is its
slack plus the sum at the time, and it may be assigned anew only once the sum has reached its key. Such parts are on top
of the heap; they alone are popped, measured against all entries and pushed into the heap of their nearest one.

A block's state (parts, codes, heaps) is a row of a table that each round writes to the shared folder, with what the
round has changed in the entries' sums and counts. Through the driver go codebooks, counts and sums: numbers in
proportion to parts * entries, whatever the number of vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.common import on_executors, scratch, spread_join
from alphaloom.llm.vectors import is_finite, matrix, products, whole

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors in a block: some 2 MB of state at 64 components.
BLOCK = 2048
#: More than rounding can put into a slack: square roots of numbers below 2**53.
_MARGIN = 1e-6

Books = list[np.ndarray]  # by part: entries x components of the part, whole numbers


@dataclass
class Codes:
    """rows: vec_id, label, code (PARTS * two hex digits), error, and rescanned (how often one of its parts was measured against all entries after the first assignment); books: the final entries by part."""

    rows: DataFrame
    books: Books


def text_of_books(books: Books) -> str:
    return ",".join(str(x) for book in books for x in book.ravel().tolist())


def _distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of parts to all entries, exact."""
    square = lambda x: (x * x).sum(axis=1)
    cross = products(parts, book).astype(np.int64)
    return square(parts)[:, None] - 2 * cross + square(book)[None, :]


def _nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry, the lower index of equal ones, and the slack: by how much the second is farther."""
    far = _distances(parts, book)
    code = far.argmin(axis=1)
    at = np.arange(len(parts))
    upper = np.sqrt(far[at, code].astype(np.float64))
    lower = np.full(len(parts), np.inf)
    if far.shape[1] > 1:
        far[at, code] = np.iinfo(np.int64).max
        lower = np.sqrt(far.min(axis=1).astype(np.float64))
    return code, lower - upper


class _Block:
    """Parts (vectors x PARTS x width), codes and heaps of a block. heaps[p][e]: (key, row) of the parts at p assigned to entry e."""

    def __init__(self, parts: np.ndarray, codes: np.ndarray, heaps: list[list[list[tuple[float, int]]]], rescanned: np.ndarray):
        self.parts, self.codes, self.heaps, self.rescanned = parts, codes, heaps, rescanned

    @staticmethod
    def assigned(parts: np.ndarray, books: Books) -> _Block:
        """A block whose parts are measured against all entries."""
        codes = np.zeros(parts.shape[:2], np.uint8)
        heaps = []
        for p, book in enumerate(books):
            code, slack = _nearest(parts[:, p], book)
            codes[:, p] = code
            own: list[list[tuple[float, int]]] = [[] for _ in book]
            for e, key, row in zip(code.tolist(), slack.tolist(), range(len(parts)), strict=True):
                own[e].append((key, row))
            for heap in own:
                heapq.heapify(heap)
            heaps.append(own)
        return _Block(parts, codes, heaps, np.zeros(len(parts), np.int32))

    def repair(self, books: Books, drifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pops the parts whose keys the entries' summed drifts (parts x entries) have reached and assigns them anew. Returns by how much the entries' sums and counts change."""
        sums, counts = _none(books)
        for p, book in enumerate(books):
            popped = []
            for e, heap in enumerate(self.heaps[p]):
                bound = drifted[p, e] + _MARGIN
                while heap and heap[0][0] <= bound:
                    popped.append(heapq.heappop(heap)[1])
            if not popped:
                continue
            rows = np.array(popped)
            code, slack = _nearest(self.parts[rows, p], book)
            for e, key, row in zip(code.tolist(), (slack + drifted[p, code]).tolist(), popped, strict=True):
                heapq.heappush(self.heaps[p][e], (key, row))
            old = self.codes[rows, p]
            moved = old != code
            for of, sign in ((old, -1), (code, 1)):
                np.add.at(sums[p], of[moved], sign * self.parts[rows[moved], p])
                np.add.at(counts[p], of[moved], sign)
            self.codes[rows, p] = code
            np.add.at(self.rescanned, rows, 1)
        return np.stack(sums), np.stack(counts)

    def totals(self, books: Books) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of the parts of each entry."""
        sums, counts = _none(books)
        for p in range(len(books)):
            np.add.at(sums[p], self.codes[:, p], self.parts[:, p])
            np.add.at(counts[p], self.codes[:, p], 1)
        return np.stack(sums), np.stack(counts)

    def errors(self, books: Books) -> np.ndarray:
        total = np.zeros(len(self.parts), np.int64)
        for p, book in enumerate(books):
            off = self.parts[:, p] - book[self.codes[:, p]]
            total += (off * off).sum(axis=1)
        return total

    def packed(self) -> list[bytes]:
        flat = [item for own in self.heaps for heap in own for item in heap]  # as they lie: a heap stays one
        keys, rows = np.array([k for k, _ in flat], np.float64), np.array([r for _, r in flat], np.int32)
        sizes = np.array([[len(heap) for heap in own] for own in self.heaps], np.int32)
        return [x.tobytes() for x in (self.parts.astype(np.int32), self.codes, keys, rows, sizes, self.rescanned)]

    @staticmethod
    def unpacked(values: list[bytes], books: Books) -> _Block:
        parts, codes, keys, rows, sizes, rescanned = (np.frombuffer(v, t) for v, t in zip(values, (np.int32, np.uint8, np.float64, np.int32, np.int32, np.int32), strict=True))
        n, shape = len(rescanned), (len(books), len(books[0]))
        items, heaps, at = list(zip(keys.tolist(), rows.tolist(), strict=True)), [], 0
        for own in sizes.reshape(shape).tolist():
            heaps.append([items[(at := at + size) - size : at] for size in own])
        return _Block(parts.reshape(n, shape[0], -1).astype(np.int64), codes.reshape(n, shape[0]).copy(), heaps, rescanned.copy())


def _none(books: Books) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]


_STATE = ("parts", "codes", "heap_keys", "heap_rows", "heap_sizes", "rescanned")
_CHANGE = ("sums", "counts")


def _state_batch(ids: pa.Array, labels: pa.Array, block: _Block, change: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    values = [pa.array([v], pa.binary()) for v in (*block.packed(), *(c.tobytes() for c in change))]
    return pa.RecordBatch.from_arrays([listed(ids), listed(labels), *values], names=["ids", "labels", *_STATE, *_CHANGE])


def _one(column: pa.Array, row: int) -> pa.Array:
    return column.slice(row, 1).flatten()


def _begin(books: Books) -> Callable:
    """Rows (vec_id, label, embedding) to blocks, all parts assigned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(begin, BLOCK)
                ids, labels, vectors = (rows.column(rows.schema.get_field_index(n)) for n in ("vec_id", "label", "embedding"))
                block = _Block.assigned(whole(matrix(vectors), SCALE).reshape(len(rows), len(books), -1), books)
                yield _state_batch(ids, labels, block, block.totals(books))

    return run


def _blocks_of(batch: pa.RecordBatch, books: Books) -> Iterator[tuple[pa.Array, pa.Array, _Block]]:
    column = lambda name: batch.column(batch.schema.get_field_index(name))
    for i in range(batch.num_rows):
        yield _one(column("ids"), i), _one(column("labels"), i), _Block.unpacked([column(n)[i].as_py() for n in _STATE], books)


def _again(books: Books, drifted: np.ndarray) -> Callable:
    """Blocks to blocks, their heaps repaired for moved entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, block in _blocks_of(batch, books):
                change = block.repair(books, drifted)
                yield _state_batch(ids, labels, block, change)

    return run


def _finish(books: Books, drifted: np.ndarray) -> Callable:
    """Blocks to rows, their heaps repaired for the final entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, block in _blocks_of(batch, books):
                block.repair(books, drifted)
                codes = [row.tobytes().hex() for row in block.codes]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(block.errors(books)), pa.array(block.rescanned)], names=["vec_id", "label", "code", "error", "rescanned"])

    return run


def _summed(shape: tuple[int, ...]) -> Callable:
    """One row for each number of sums and counts that blocks have changed, added up in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int(np.prod(shape)) + int(np.prod(shape[:2])), np.int64)
        for batch in batches:
            for sums, counts in zip(*(batch.column(batch.schema.get_field_index(n)) for n in _CHANGE), strict=True):
                total += np.concatenate([np.frombuffer(sums.as_py(), np.int64), np.frombuffer(counts.as_py(), np.int64)])
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "total"])

    return run


def _changes(state: DataFrame, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts over all blocks: parts * entries * (width + 1) numbers at most come to the driver."""
    out = np.zeros(int(np.prod(shape)) + int(np.prod(shape[:2])), np.int64)
    for place, total in state.select(*_CHANGE).mapInArrow(_summed(shape), "place long, total long").groupBy("place").agg(F.sum("total")).collect():
        out[place] = total
    cut = int(np.prod(shape))
    return out[:cut].reshape(shape), out[cut:].reshape(shape[:2])


def _moved(books: Books, sums: np.ndarray, counts: np.ndarray) -> tuple[Books, np.ndarray]:
    """The entries at the floor of their parts' mean (those without parts stay), and the drift that each entry's slacks may have lost."""
    new = [np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], b) for b, s, n in zip(books, sums, counts, strict=True)]
    lost = []
    for b, c in zip(books, new, strict=True):
        drift = np.sqrt(((c - b) ** 2).sum(axis=1).astype(np.float64))
        others = np.array([np.delete(drift, e).max(initial=0.0) for e in range(len(drift))])
        lost.append(drift + others)
    return new, np.stack(lost)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes of the rows of vectors (vec_id, label, embedding) and the codebooks they refer to.

    Rows whose vector is null or holds null or a component that isn't finite go. All vectors have the length of that
    with the smallest vec_id among those whose length is a positive multiple of parts; rows of other lengths go as well.
    Codebooks start as the parts of the entries smallest vec_ids (null the last; of equal ones the smaller vector),
    fewer if there are fewer rows; repeated rows count each. Components beyond 65,536 count as that. entries: 256 at most. A null label is a
    label like others. Other columns are ignored; an empty table gives no rows and empty codebooks.
    """
    spark = vectors.sparkSession
    on_executors(spark)
    kept = vectors.select("vec_id", "label", "embedding").where(is_finite(F.col("embedding")))
    fitting = kept.where((F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    order = F.col("vec_id").asc_nulls_last(), F.col("embedding")
    least = fitting.orderBy(*order).first()
    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    out = f"vec_id {types['vec_id']}, label {types['label']}, code string, error long, rescanned int"
    if least is None:
        return Codes(spark.createDataFrame([], out), [])
    kept = kept.where(F.size("embedding") == len(least["embedding"]))
    seeds = whole(np.array([r["embedding"] for r in kept.orderBy(*order).limit(entries).select("embedding").collect()], np.float64), SCALE)
    books: Books = [np.ascontiguousarray(x) for x in seeds.reshape(len(seeds), parts, -1).swapaxes(0, 1)]
    shape = (parts, *books[0].shape)
    form = f"ids array<{types['vec_id']}>, labels array<{types['label']}>, " + ", ".join(f"{n} binary" for n in (*_STATE, *_CHANGE))
    state = scratch(kept.mapInArrow(_begin(books), form))
    sums, counts = _changes(state, shape)
    drifted = np.zeros(shape[:2])
    for i in range(rounds):
        books, lost = _moved(books, sums, counts)
        drifted = drifted + lost
        if i < rounds - 1:
            state = scratch(state.mapInArrow(_again(books, drifted), form))
            change = _changes(state, shape)
            sums, counts = sums + change[0], counts + change[1]
    return Codes(scratch(state.mapInArrow(_finish(books, drifted), out)), books)


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows (vec_id, label, error) with label_error, the errors' sum over rows of the same label; nulls are one label."""
    keyed = rows.withColumn("label_key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    totals = keyed.groupBy("label_key").agg(F.sum("error").alias("label_error"))
    return spread_join(keyed, totals, "label_key", "vec_id").drop("label_key")
