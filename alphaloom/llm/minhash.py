"""Near-duplicate classes by DartMinHash signatures, banded joining and connected components.

A text is a weighted set of shingles of five words, the weight being how often a shingle occurs. Darts are thrown at
random into the plane of (shingle's weight, time); all texts share the darts of a shingle. Each dart that lands below
the weight hits a random coordinate of the signature, and the earliest dart to hit a coordinate is its value. Two
texts agree in a coordinate with a probability equal to their weighted Jaccard similarity, and the work for a text is
the number of darts needed to fill its signature, whatever the number of coordinates per shingle would be.

1. Equal texts become one node, addressed by the text's hash.
2. Nodes that agree in all rows of a band are in one bucket. All buckets are sorted as one table, cut into ranges that
   may split a bucket; in each range every node of a bucket is paired with the first there, its hub. That is one pair
   a node and band at most, and few distinct ones, as the buckets of a group of copies mostly have the same hub.
3. Pairs are counted exactly on the texts' shingles. Those of 0.8 or more are links; links make classes.
4. What hubs leave out is done in full: wherever a bucket still holds more than one class, the shingles of its members
   go to pieces of work, blocks against blocks, each of a bounded size. In a piece every pair of different classes is
   counted exactly, until a link makes them one; so a piece gives fewer links than it has members, whatever the number
   of similar pairs. A bucket whose members have become one class, as a large group of copies does, makes no piece.

Nothing is estimated, drawn or capped: a pair that shares a bucket is a link if and only if its similarity is 0.8 or
more, or its two texts are of one class by other links. A pair at 0.8 shares none of the 24 bands with a probability
of 0.00007.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.common import blocks, free_name, on_executors, scratch, spread_join, text_of

WIDTH = 5
THRESHOLD = 0.8
ROWS, BANDS = 5, 24
COORDINATES = ROWS * BANDS
#: Shingles in a block of a bucket's members, of which a piece of work has two; 16 bytes each in a task.
BLOCK = 500_000
#: Buckets of several classes up to which they are broadcast: some 100 bytes each, 20 MB in all.
BROADCAST_BUCKETS = 200_000
SALTS = 32
_WORDS_KEPT = 200_000
_WORD = re.compile(r"\w+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: P(Poisson(1) <= n): how many darts an interval of unit weight and time has.
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, n + 1)) for n in range(12)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Hashes of the words met, forgotten when they are too many."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > _WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_word_hashes = _WordHashes()


def shingles(text: str, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the text's shingles of words in lower case, and how often each occurs. A text of fewer words is one shingle; without words there is none."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    rolled = np.full(len(words) - size + 1, np.uint64(size))
    for i in range(size):
        rolled = _mixed(rolled ^ hashes[i : len(words) - size + 1 + i])
    return np.unique(rolled, return_counts=True)


def similarity(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle sets; 0 if either is empty."""
    _, i, j = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
    both = np.minimum(one[1][i], other[1][j]).sum()
    total = one[1].sum() + other[1].sum() - both
    return float(both / total) if len(one[0]) and len(other[0]) else 0.0


def signature(elements: np.ndarray, weights: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The hashes of the earliest darts by coordinate. Weights may be fractions; an empty set has no signature (zeros).

    Each unit of an element's weight is a strip. In each unit of time a strip gets Poisson(1) darts, each at a random
    time, height and coordinate, all by hashes of (element, strip, time, dart); those above the weight miss.
    """
    out = np.zeros(coordinates, np.uint64)
    if not len(elements):
        return out
    strips = np.ceil(weights).astype(np.int64)
    of = np.repeat(np.arange(len(elements)), strips)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(strips) - strips, strips)
    strip = _mixed(elements[of] ^ (nth.astype(np.uint64) * _MIX[1]))
    height = np.minimum(1.0, weights[of] - nth)
    first = np.full(coordinates, np.inf)
    total, begin = float(weights.sum()), 0
    need = coordinates * (np.log(coordinates) + 2)
    while True:
        units = int(max(1, np.ceil(need / total)))
        cells = _mixed(strip[:, None] + np.arange(begin, begin + units, dtype=np.uint64)[None, :] * _MIX[2])
        darts = np.searchsorted(_POISSON, cells / 2.0**64)
        row, unit = np.nonzero(darts)
        n = darts[row, unit]
        owner = np.repeat(np.arange(len(n)), n)
        which = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        dart = _mixed(cells[row, unit][owner] ^ _mixed(which.astype(np.uint64) + np.uint64(1)))
        when = begin + unit[owner] + (dart >> np.uint64(32)) / 2.0**32
        at = ((dart & np.uint64(0xFFFFFFFF)) % np.uint64(coordinates)).astype(np.int64)
        value = _mixed(dart)
        hit = (value >> np.uint64(11)) / 2.0**53 < height[row][owner]
        when, at, value = when[hit], at[hit], value[hit]
        late = np.argsort(-when, kind="stable")
        when, at, value = when[late], at[late], value[late]
        fresh = np.isinf(first)
        keep = fresh[at]
        out[at[keep]], first[at[keep]] = value[keep], when[keep]  # of equal places the last assignment, the earliest dart, stays
        if not np.isinf(first).any():
            return out
        begin += units
        need = coordinates


_SIGNED = "bands array<long>, size int"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with bands, one hash for each band, and size, the number of distinct shingles, in place of the text."""
    known: dict[bytes, tuple[list[int], int]] = {}
    for batch, texts in blocks(batches, "text"):
        bands, sizes = [], []
        for node, text in zip(batch.column(batch.schema.get_field_index("node")).to_pylist(), texts, strict=True):
            if node not in known:
                if len(known) > 5_000:
                    known.clear()
                known[node] = _signed(text)
            own = known[node]
            bands.append(own[0])
            sizes.append(own[1])
        names = [n for n in batch.schema.names if n != "text"]
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int32())], names=[*names, "bands", "size"])


def _signed(text: str) -> tuple[list[int], int]:
    """One hash for each band, and the number of shingles. No bands for a text without words."""
    elements, weights = shingles(text)
    if not len(elements):
        return [], 0
    hashes = signature(elements, weights).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = _mixed(key ^ hashes[:, i])
    return key.view(np.int64).tolist(), len(elements)


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


_MEMBERS = "band int, key long, hub binary, node binary, size int"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """band, key, hub, node and size of the members of buckets with two or more in this range, and of the range's first and last bucket, which may go on in others; rows come by band, key and node."""
    held: pa.RecordBatch | None = None  # the last row, of which it isn't known yet whether one of its bucket follows
    hub, follows, first = None, False, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([held, batch] if held else [batch]).combine_chunks().to_batches()[0]
        band, key = (rows.column(rows.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("band", "key"))
        node = rows.column(rows.schema.get_field_index("node"))
        first = first or (band[0], key[0])
        same = (band[1:] == band[:-1]) & (key[1:] == key[:-1])
        start = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(band)), 0))
        hubs = node.take(pa.array(start)).to_pylist()
        if follows:  # the held row belongs to a hub met before
            for i in range(int(np.searchsorted(start, 0, "right"))):
                hubs[i] = hub
        keep = np.r_[follows, same] | np.r_[same, False] | ((band == first[0]) & (key == first[1]))
        keep[-1] = False
        made = pa.RecordBatch.from_arrays([pa.array(band, pa.int32()), pa.array(key), pa.array(hubs, pa.binary()), node, rows.column(rows.schema.get_field_index("size"))], names=["band", "key", "hub", "node", "size"])
        yield made.filter(pa.array(keep))
        held, hub = rows.slice(len(band) - 1), hubs[-1]
        follows = bool(np.r_[follows, same][-1])
    if held:
        one = {n: held.column(held.schema.get_field_index(n)) for n in ("band", "key", "node", "size")}
        yield pa.RecordBatch.from_arrays([one["band"].cast(pa.int32()), one["key"], pa.array([hub], pa.binary()), one["node"], one["size"]], names=["band", "key", "hub", "node", "size"])


_SETS = "node binary, hashes binary, weights binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's shingles: their hashes, and their weights unless all are one."""
    for batch, texts in blocks(batches, "text"):
        found = [shingles(t) for t in texts]
        hashes = pa.array([h.tobytes() for h, _ in found], pa.binary())
        weights = pa.array([w.astype(np.int32).tobytes() if (w != 1).any() else b"" for _, w in found], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("node")), hashes, weights], names=["node", "hashes", "weights"])


def _set(hashes: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(hashes, np.uint64)
    return found, np.frombuffer(weights, np.int32) if weights else np.ones(len(found), np.int32)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose shingles are similar enough."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in ("hashes_a", "weights_a", "hashes_b", "weights_b")]
        keep = [similarity(_set(*(v.as_py() for v in row[:2])), _set(*(v.as_py() for v in row[2:]))) >= THRESHOLD for row in zip(*columns, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _joining(held: list[tuple], one_side: bool) -> list[tuple[bytes, bytes]]:
    """Links that join the classes of a piece's members (left, node, root, hashes, weights), each the first to join its two; one_side: left ones are paired with left ones, else with the others.

    Every pair of different classes is counted, unless their totals alone keep it below the threshold.
    """
    lead: dict[bytes, bytes] = {h[2]: h[2] for h in held}

    def root_of(x: bytes) -> bytes:
        while lead[x] != x:
            lead[x] = x = lead[lead[x]]
        return x

    if len(lead) < 2:
        return []
    sets = [_set(h[3], h[4]) for h in held]
    start = np.r_[0, np.cumsum([len(h) for h, _ in sets])]
    weights = np.concatenate([w for _, w in sets]).astype(np.int64)
    _, place = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    total = np.add.reduceat(weights, start[:-1])
    number = {r: i for i, r in enumerate(lead)}
    classes_ = np.array([number[h[2]] for h in held])
    names = list(number)
    is_left = np.array([h[0] for h in held])
    found, own = [], np.zeros(int(place.max()) + 1, np.int64)
    for i in np.nonzero(is_left)[0]:
        others = (is_left & (np.arange(len(held)) > i)) if one_side else ~is_left
        others = np.nonzero(others & (classes_ != classes_[i]) & (np.minimum(total, total[i]) >= THRESHOLD * np.maximum(total, total[i])))[0]
        if not len(others):
            continue
        mine = slice(start[i], start[i + 1])
        own[place[mine]] = weights[mine]
        sizes = start[others + 1] - start[others]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(start[others] - (ends - sizes), sizes)
        both = np.add.reduceat(np.minimum(weights[at], own[place[at]]), ends - sizes)
        own[place[mine]] = 0
        for j in others[both / (total[i] + total[others] - both) >= THRESHOLD]:
            one, other = root_of(names[classes_[i]]), root_of(names[classes_[j]])
            if one != other:
                lead[other] = one
                found.append(tuple(sorted((held[i][1], held[j][1]))))
                classes_[classes_ == classes_[j]] = classes_[i]
    return found


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The joining links of each piece of work; rows come by their piece. One of kind 0 has one side, paired within itself."""
    piece: tuple | None = None
    held: list[tuple] = []
    found: list[tuple[bytes, bytes]] = []

    def batch_of(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in ("band", "key", "kind", "i", "j", "left", "node", "root", "hashes", "weights")]
        for values in zip(*columns, strict=True):
            row = tuple(v.as_py() for v in values)
            if row[:5] != piece:
                if held:
                    found += _joining(held, piece[2] == 0)
                piece, held = row[:5], []
                if len(found) > 10_000:
                    yield batch_of(found)
                    found = []
            held.append(row[5:])
    if held:
        found += _joining(held, piece[2] == 0)
    yield batch_of(found)


def _remaining(members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """a and b of links that join classes whose members (_MEMBERS) share a bucket without being compared.

    In a bucket the members of its largest class are only paired with the others. Both are cut into blocks, and
    each pair of blocks is a piece of work of its own, so that no bucket is gathered in one task.
    """
    classed = members.join(roots, "node", "left").select("band", "key", "hub", "node", F.coalesce("root", "node").alias("root"), F.col("size").cast("long").alias("size"))
    shares = classed.groupBy("band", "key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("hub").alias("low"), F.max("hub").alias("high"))
    whole = shares.groupBy("band", "key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("size", "root")).alias("main"), F.count("*").alias("n_roots"), F.min("low").alias("low"), F.max("high").alias("high"))
    mixed = whole.where((F.col("n_roots") > 1) & ((F.col("n") > 2) | (F.col("low") != F.col("high"))))  # of a hub and one member both are compared
    mains, minors = F.ceil(F.col("main.size") / BLOCK), F.ceil((F.col("size") - F.col("main.size")) / BLOCK)
    mixed = scratch(mixed.select("band", "key", F.col("main.root").alias("main"), mains.alias("mains"), minors.alias("minors")))
    if mixed.count() <= BROADCAST_BUCKETS:
        found = classed.join(F.broadcast(mixed), ["band", "key"])
    else:
        salted = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = classed.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["band", "key", "salt"])
    draw = F.xxhash64(F.lit(1), F.col("node"))
    own_minor, own_main = F.pmod(draw, F.col("minors")), F.pmod(draw, F.col("mains"))
    piece = lambda kind, i, j, left: F.struct(kind.alias("kind"), i.alias("i"), j.alias("j"), left.alias("left"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), f)
    among = each("minors", lambda k: piece(F.when(k == own_minor, 0).otherwise(1), F.least(own_minor, k), F.greatest(own_minor, k), own_minor <= k))
    against = each("mains", lambda k: piece(F.lit(2), own_minor, k, F.lit(True)))
    of_main = each("minors", lambda k: piece(F.lit(2), k, own_main, F.lit(False)))
    pieces = F.when(F.col("root") == F.col("main"), of_main).otherwise(F.concat(among, against))
    work = found.select("band", "key", F.inline(pieces), "node", "root").join(sets, "node")
    by = ["band", "key", "kind", "i", "j"]
    return work.repartition(*by).sortWithinPartitions(*by).mapInArrow(_across, "a binary, b binary").distinct()


def _sets_of(wanted: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, hashes and weights of the wanted nodes, from the one row of rows (doc_id, node, text) that stands for each."""
    wanted = wanted.join(nodes.select("node", "first_doc"), "node").select(F.col("node").alias("wanted"), "first_doc")
    texts = rows.join(wanted, (F.col("doc_id").eqNullSafe(F.col("first_doc"))) & (F.col("node") == F.col("wanted")))
    return scratch(texts.select("node", "text").dropDuplicates(["node"]).mapInArrow(_sets, _SETS))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, roots) of docs (doc_id, text).

    nodes has node and first_doc, the smallest doc_id of its text. links has a < b, the nodes of similar texts, enough
    of them to make every class whole; equal texts share a node. roots has node and root for each node that has links.
    """
    on_executors(docs.sparkSession)
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long"), node_of(text).alias("node"), text.alias("text"))
    signed = rows.mapInArrow(_sign, f"doc_id long, node binary, {_SIGNED}")
    nodes = scratch(signed.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.first("bands").alias("bands"), F.first("size").alias("size")))
    buckets = nodes.where(F.size("bands") > 0).select(F.posexplode("bands").alias("band", "key"), "node", "size")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = buckets.repartitionByRange(parts, "band", "key", "node").sortWithinPartitions("band", "key", "node")
    members = scratch(ranged.mapInArrow(_shared, _MEMBERS))
    sets = _sets_of(members.select("node").distinct(), rows, nodes)
    pairs = members.where("hub != node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    side = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"hashes_{x}"), F.col("weights").alias(f"weights_{x}"))
    found = scratch(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "hashes_a", "weights_a", "b", "hashes_b", "weights_b").mapInArrow(_exact, "a binary, b binary"))
    roots = components(found)
    more = scratch(_remaining(members, roots, sets))
    if more.limit(1).count():
        found = found.unionByName(more)
        roots = components(found)
    return nodes.select("node", "first_doc"), found, roots


def components(edges: DataFrame) -> DataFrame:
    """node and root (a node of the same component, the same for all its nodes) of every node of edges (a, b), a != b.

    Each round every node moves to the first among itself and its neighbours in an order that hashes give anew. Links
    are redrawn between the nodes moved to; those within a node and repeats go, and the rounds end when no link is
    left. As the order is random, a share of the nodes goes in each round whatever the shape of the graph, so that
    rounds grow with the logarithm of its size. Minima are taken on the map side, and each round is written to the
    shared folder.
    """
    left = scratch(edges.select("a", "b").distinct())
    moved, seed = None, 0
    while True:
        place = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("by"), F.col(c).alias("node"))  # noqa: E731, B023  used in this round
        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).union(left.select(F.col("b").alias("u"), F.col("a").alias("v")))
        nearest = both.groupBy("u").agg(F.min(place("v")).alias("to"))
        step = scratch(nearest.select("u", F.least(place("u"), F.col("to"))["node"].alias("to")))
        if moved is None:
            moved = step.select(F.col("u").alias("node"), F.col("to").alias("root"))
        else:
            onward = step.select(F.col("u").alias("root"), "to")
            moved = scratch(moved.join(onward, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        first = left.join(step.select(F.col("u").alias("a"), F.col("to").alias("x")), "a").select("b", "x")
        drawn = first.join(step.select(F.col("u").alias("b"), F.col("to").alias("y")), "b").where("x != y")
        left = scratch(drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        seed += 1
        if not left.limit(1).count():
            return moved


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every row of docs (doc_id, text).

    class_id: the smallest doc_id of the texts that links (similarity of 0.8 or more) lead to. Equal texts are in one class, those without words (null as well) too; a text of
    fewer than five words is like its equals in words only. Other columns are ignored; an empty table gives no rows.
    """
    nodes, _, roots = links(docs)
    linked = nodes.join(roots, "node")
    least = linked.groupBy("root").agg(F.min("first_doc").alias("class_id"))
    linked = linked.join(least, "root").select("node", "class_id")
    known = scratch(nodes.join(linked, "node", "left").select("node", F.coalesce("class_id", "first_doc").alias("class_id")))
    rows = docs.select(F.col("doc_id").cast("long"), node_of(text_of()).alias("node"))
    return spread_join(rows, known, "node").select("doc_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows that aren't the first of their class: of each class the rows of its smallest doc_id stay, one of them if they repeat. All columns stay, whatever their names."""
    nodes, _, roots = links(docs)
    own, least, first = (free_name(docs, n) for n in ("own_node", "class_node", "class_doc"))
    best = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first_doc").alias(first), F.min_by("node", F.struct("first_doc", "node")).alias(least))
    keyed = docs.withColumn(own, node_of(text_of()))
    kept = keyed.join(best.select(first, least), F.col(own).eqNullSafe(F.col(least)) & F.col("doc_id").cast("long").eqNullSafe(F.col(first)))
    return kept.dropDuplicates([least]).select(*docs.columns)
