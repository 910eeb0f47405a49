"""Near copies among vectors by a pivot-permutation index: inverted lists of nearest reference points, then exact cosines.

1. Equal vectors of a label become one node with a weight. All nodes are described by the PREFIX pivots nearest to
   them, in order. Pivots are chosen from a bounded sample of nodes, each the farthest from those before it, so that a
   large group of near copies doesn't take them all.
2. Two nodes are candidates if they share SHARED pivots or more; two of a cosine of 0.93 do with a probability of 0.9995
   or more (random directions, 64 components). They must then share one of the PREFIX - SHARED + 1
   rarest pivots of each, so only these are listed. A list holds the nodes of a label with a pivot.
3. A list is cut into blocks of a bounded number of nodes, and each pair of blocks is a piece of work. In a piece shared
   pivots are counted by bits; a pair counts in the list of the rarest pivot it has in common, hence once. Candidates
   are verified by their cosine.
4. A piece returns each node's number of links and the node that stands for those it is linked with, so that it gives no
   more rows than it has nodes, however many pairs are linked. Connected components then give the classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.common import on_executors, scratch, spread_join
from alphaloom.llm.minhash import components
from alphaloom.llm.vectors import is_finite, matrix, usual_length

THRESHOLD = 0.93
PIVOTS, PREFIX, SHARED = 256, 12, 4
#: Nodes from which pivots are chosen.
SAMPLE = 4096
#: Nodes in a block of a list: some 50 MB of a piece's matrices.
BLOCK = 1024
#: Lists of several blocks up to which they are broadcast, some 30 bytes each.
BROADCAST_LISTS = 200_000


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one. Components are scaled first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def choose(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """count of the sample's unit vectors at most: the first, then always the one farthest from those chosen, until all are within a cosine of THRESHOLD of one. One at least."""
    nearest = np.full(len(sample), -np.inf)
    chosen = [0]
    while True:
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
        at = int(nearest.argmin())
        if len(chosen) == min(count, len(sample)) or nearest[at] >= THRESHOLD:
            return sample[chosen]
        chosen.append(at)


def describe(vectors: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """The prefix pivots nearest to each unit vector, in order; of equally near ones the lower index."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix]


def _describe(pivots: np.ndarray, kind: type) -> Callable:
    """Nodes with their nearest pivots, and the vector's numbers as bytes of their kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                rows = batch.slice(begin, 4096)
                column = lambda n: rows.column(rows.schema.get_field_index(n))  # noqa: B023, E731
                vectors = matrix(column("embedding"))
                nearest = describe(unit(vectors), pivots).astype(np.int16)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nearest) + 1) * nearest.shape[1], pa.int32()), pa.array(nearest.ravel()))
                yield pa.RecordBatch.from_arrays([column("node"), column("label_key"), column("weight"), lists, pa.array([v.tobytes() for v in vectors.astype(kind)], pa.binary())], names=["node", "label_key", "weight", "pivots", "vector"])

    return run


def _bits(places: np.ndarray, count: int) -> np.ndarray:
    """Sets of places below count as rows of 64-bit words; places below zero are none."""
    row, column = np.nonzero(places >= 0)
    at = places[row, column].astype(np.int64)
    out = np.zeros((len(places), -(-count // 64)), np.uint64)
    np.bitwise_or.at(out, (row, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    return out


def candidates(one: np.ndarray, other: np.ndarray, prefix: int, shared: int, place: int, count: int) -> np.ndarray:
    """Which pairs share `shared` places or more and have `place` as the first one in common; one, other: each node's places in ascending order, of which the first `prefix` are listed."""
    a, b = _bits(one, count), _bits(other, count)
    number = np.zeros((len(a), len(b)), np.uint8)
    for w in range(a.shape[1]):
        number += np.bitwise_count(a[:, None, w] & b[None, :, w])
    found = number >= shared
    earlier = [_bits(np.where(x[:, :prefix] < place, x[:, :prefix], -1), count) for x in (one, other)]
    for w in range(a.shape[1]):
        found &= (earlier[0][:, None, w] & earlier[1][None, :, w]) == 0
    return found


def linked(one: np.ndarray, other: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The found pairs of unit vectors whose cosine is THRESHOLD or more."""
    if found.sum() * 16 > found.size:
        return found & (one @ other.T >= THRESHOLD)
    out = np.zeros_like(found)
    a, b = np.nonzero(found)
    for begin in range(0, len(a), 32_768):
        x, y = a[begin : begin + 32_768], b[begin : begin + 32_768]
        near = np.einsum("ij,ij->i", one[x], other[y]) >= THRESHOLD
        out[x[near], y[near]] = True
    return out


def _first_linked(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and the columns of a matrix of links, the first place of their component: rows are numbered before columns."""
    n, m = links.shape
    rows, columns = np.arange(n), n + np.arange(m)
    while True:
        new = np.minimum(rows, np.where(links, columns[None, :], n + m).min(axis=1, initial=n + m))
        then = np.minimum(columns, np.where(links, new[:, None], n + m).min(axis=0, initial=n + m))
        if (new == rows).all() and (then == columns).all():
            return rows, columns
        rows, columns = new, then


_LINKED = "node binary, links long, root binary"


def _verify(prefix: int, shared: int, count: int, kind: type) -> Callable:
    """The links of pieces' nodes: how many, by weight, and a node of the same component. Rows come by their piece; in one of i = j all nodes are left ones, paired with one another."""

    def links_of(piece: tuple, held: list[tuple]) -> list[tuple]:
        sides = [[h for h in held if h[0] == left] for left in (True, False)]
        inner = piece[2] == piece[3]
        if inner:
            sides[1] = sides[0]
        if not sides[0] or not sides[1]:
            return []
        places = [np.array([h[3] for h in side]) for side in sides]
        vectors = [unit(np.stack([np.frombuffer(h[4], kind) for h in side]).astype(np.float64)) for side in sides]
        found = candidates(*places, prefix, shared, piece[1], count)
        if inner:
            found = np.triu(found, 1)
        links = linked(*vectors, found)
        if not links.any():
            return []
        if inner:
            links |= links.T
        rows, columns = (links.any(axis=i) for i in (1, 0))
        links = links[np.ix_(rows, columns)]
        own = [[h for h, keep in zip(side, mask, strict=True) if keep] for side, mask in zip(sides, (rows, columns), strict=True)]
        weights = [np.array([h[2] for h in side], np.int64) for side in own]
        first = _first_linked(links | np.eye(len(links), dtype=bool) if inner else links)  # within a block a node is a row and a column
        nodes = [h[1] for side in own for h in side]
        numbers = links @ weights[1], weights[0] @ links
        return [(h[1], int(k), nodes[f]) for i in ((0,) if inner else (0, 1)) for h, k, f in zip(own[i], numbers[i], first[i], strict=True)]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary()))], names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece: tuple | None = None
        held: list[tuple] = []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("label_key", "place", "i", "j", "left", "node", "weight", "places", "vector")]
            for values in zip(*columns, strict=True):
                row = tuple(v.as_py() for v in values)
                if row[:4] != piece:
                    if len(held) > 1:
                        yield batch_of(links_of(piece, held))
                    piece, held = row[:4], []
                held.append(row[4:])
        yield batch_of(links_of(piece, held) if len(held) > 1 else [])

    return run


def _pieces(listed: DataFrame) -> DataFrame:
    """listed (label_key, place, node, ...) with i, j and left: a row for each piece in which a node of a list is paired."""
    sizes = listed.groupBy("label_key", "place").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where(F.col("blocks") > 1)
    sizes = scratch(sizes)
    key = F.struct("label_key", "place")
    if sizes.count() <= BROADCAST_LISTS:
        cut = listed.join(F.broadcast(sizes), ["label_key", "place"], "left")
    else:
        cut = spread_join(listed.withColumn("list", key), sizes.select(key.alias("list"), "blocks"), "list", "node").drop("list")
    cut = cut.withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    cut = cut.withColumn("own", F.pmod(F.xxhash64(F.lit(9), F.col("node")), F.col("blocks")))
    # The node's block with every block: left is the side of the lower number, and within a block there is one side.
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"), (F.col("own") <= k).alias("left")))
    return cut.select(*(c for c in cut.columns if c not in ("blocks", "own")), F.inline(pieces))


def _node(label: Column, vector: Column) -> Column:
    """128 bits of hash of a label and a vector."""
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), label, vector)), 16, "0")
    return F.unhex(F.concat(half(1), half(2)))


def duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, label, embedding).

    Rows are linked if their labels are equal and the cosine of their vectors is THRESHOLD or more; found are those that
    share SHARED of their PREFIX nearest pivots. n_links: the row's links; component_id: the smallest vec_id that
    links lead to from it, its own included; kept: whether that is its own.

    A row whose label or vector is null, whose vector is zero, empty or holds null or a component that isn't finite, or
    whose vector hasn't the most frequent length, is linked with nothing. Repeated rows are rows of their own, linked with one another.
    A null vec_id counts as larger than all. Other columns are ignored; an empty table gives no rows.
    """
    on_executors(vectors.sparkSession)
    own = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label_key"), "embedding")
    taking = F.col("label_key").isNotNull() & is_finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    length = usual_length(own.where(taking), "embedding")
    rows = own.select("vec_id", "label_key", "embedding", F.when(taking & (F.size("embedding") == length), _node(F.col("label_key"), F.col("embedding"))).alias("node"))
    nodes = rows.where("node is not null").groupBy("node", "label_key", "embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first_id"))
    nodes = scratch(nodes)
    sample = nodes.orderBy("node").limit(SAMPLE).select("embedding").collect()
    known = nodes.select("node", "weight", "first_id")
    if sample:
        # Sampled nodes come in the order of their hashes, the same on every run.
        pivots = choose(unit(np.array([r["embedding"] for r in sample], np.float64)))
        found = scratch(_links(nodes, pivots))
        numbers = found.groupBy("node").agg(F.sum("links").alias("links"))
        roots = components(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        known = known.join(numbers, "node", "left").join(roots, "node", "left")
        least = known.where("root is not null").groupBy("root").agg(F.min("first_id").alias("least"))
        known = known.join(least, "root", "left")
        known = scratch(known.select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "first_id").alias("component_id")))
    else:
        known = known.select("node", F.col("weight").alias("n_links"), F.col("first_id").alias("component_id"))
    out = spread_join(rows.select("vec_id", "node"), known, "node", "vec_id")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _links(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """node, links and root (_LINKED) of each piece of nodes (node, label_key, embedding, weight)."""
    count = len(pivots)
    length, shared = min(PREFIX, count), min(SHARED, count)
    prefix = length - shared + 1
    kind = np.float32 if nodes.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64  # floats are shuffled as they are
    described = scratch(nodes.select("node", "label_key", "weight", "embedding").mapInArrow(_describe(pivots, kind), "node binary, label_key string, weight long, pivots array<short>, vector binary"))
    # One row a pivot. Places number the pivots from the rarest on.
    often = {r["pivot"]: r["count"] for r in described.select(F.explode("pivots").alias("pivot")).groupBy("pivot").count().collect()}
    place = np.empty(count, np.int64)
    place[sorted(range(count), key=lambda p: (often.get(p, 0), p))] = np.arange(count)
    numbered = F.array_sort(F.transform("pivots", lambda p: F.get(F.array(*map(F.lit, place.tolist())), p.cast("int")).cast("short")))
    listed = described.select("node", "label_key", "weight", "vector", numbered.alias("places"))
    listed = listed.withColumn("place", F.explode(F.slice("places", 1, prefix)))
    by = ["label_key", "place", "i", "j"]
    return _pieces(listed).repartition(*by).sortWithinPartitions(*by).mapInArrow(_verify(prefix, shared, count, kind), _LINKED)
