"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Method (best-two-fit): a bin is filled greedily with the longest piece that still fits; then its shortest piece
is replaced by two unpacked pieces if those fill the widened gap more tightly.

The bins are decided on the histogram of piece lengths, which has at most `capacity` entries whatever the
corpus holds: one decision stands for as many equal bins as the counts allow. The pieces themselves stay on the
executors; each finds its bin by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm.common import blocks, on_executors, scratch, text_of

#: The pre-tokeniser pattern of byte-level BPE files of this layout, for texts of plain characters without two white spaces in a row.
_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ɏ]+|\s+"
#: Texts to which that pattern applies: all characters are ASCII without 1C-1F, Latin letters, dashes or quotes.
_PLAIN = re.compile(r"(?:[!-~¿-ÖØ-öø-ɏ‐-‧‰-⁞\x00-\x08\x0e-\x1b]|[ \t-\r](?![ \t-\r]))*")


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins for `histogram` (length -> count): a list of (pattern, how many bins), a pattern being (length, pieces of it) by falling length.

    Every piece is in exactly one bin and no bin exceeds the capacity. Lengths run from 1 to capacity.
    """
    left = {length: n for length, n in histogram.items() if n > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    out = []
    while left:
        falling = sorted(left, reverse=True)
        need: dict[int, int] = {}
        gap = capacity
        for length in falling:
            if n := min(gap // length, left[length]):
                need[length] = n
                gap -= n * length
                if not gap:
                    break
        if gap:
            _swap_smallest(left, need, gap, falling)
        bins = min(left[length] // n for length, n in need.items())
        for length, n in need.items():
            left[length] -= bins * n
            if not left[length]:
                del left[length]
        out.append((sorted(need.items(), reverse=True), bins))
    return out


def _swap_smallest(left: dict[int, int], need: dict[int, int], gap: int, falling: list[int]) -> None:
    """Replaces the shortest piece in `need` by the two free pieces that fill its gap best, if they fill more than it does."""
    smallest = min(need)
    room = gap + smallest
    free = [x for x in falling if x < room and left[x] - need.get(x, 0) + (x == smallest) > 0]
    best, pair = smallest, None
    low, high = len(free) - 1, 0  # free falls: low is the shortest
    while high <= low:
        a, b = free[high], free[low]
        if a + b > room:
            high += 1
            continue
        twice = a != b or left[a] - need.get(a, 0) + (a == smallest) > 1
        if twice and a + b > best:
            best, pair = a + b, (a, b)
        low -= 1
    if pair:
        need[smallest] -= 1
        for x in pair:
            need[x] = need.get(x, 0) + 1
        if not need[smallest]:
            del need[smallest]


class Encoder:
    """The ids of a text as little-endian unsigned 32-bit bytes, equal to those of `tokenizers` for the file.

    Texts of plain characters go through the byte-pair encoder of tiktoken with the file's own merges, which is several
    times as fast; any other text, and any file of another layout, goes to `tokenizers`.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = _byte_pairs(path)

    def __call__(self, text: str) -> bytes:
        if self.fast is None or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast(text)).tobytes()


def _byte_pairs(path: str):
    """An encoder from the file's merges if it is a byte-level BPE whose ids are the bytes and then the merges in order."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
    to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    added = {t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items() if i not in added}
    for i, merge in enumerate(model["merges"]):
        if model["vocab"].get("".join(merge if isinstance(merge, list) else merge.split(" "))) != 256 + i:
            return None
    import tiktoken

    return tiktoken.Encoding("file", pat_str=_PRETOKEN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(path), end_id.to_bytes(4, "little")
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch, texts in blocks(batches, "text"):
            out: list[list[int]] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity or capacity
                for piece, stop in enumerate(range(first, n + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    length = stop - start
                    for column, value in zip(out, (doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * stop]), part, seen[length]), strict=True):
                        column.append(value)
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: each document's ids and end_id, packed into sequences of `capacity`.

    tokenizer: path of a tokenizers file, which the executors open. A null text is an empty one and gives one piece
    with end_id alone. Documents over the capacity are cut into full pieces, the first being shorter. Repeated rows
    are packed each. An empty table gives no rows. Other columns are ignored.
    """
    on_executors(docs.sparkSession)
    pieces = scratch(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(_cut(tokenizer, end_id, capacity), _PIECES))
    # Pieces of a length are ranked over all parts from the counts of each part: a row for each part and length.
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, bins in best_two_fit(histogram, capacity):
        offset = 0
        for length, n in pattern:
            slots.append((length, taken[length], taken[length] + n * bins, n, sequence, offset))
            taken[length] += n * bins
            offset += n * length
        sequence += bins
    schema = "length long, low long, high long, each long, first_sequence long, first_offset long"
    slots = docs.sparkSession.createDataFrame(slots, schema)  # bounded by the capacity, not by the corpus
    rank = F.col("earlier") + F.col("place")
    placed = (
        pieces.join(counts, ["part", "length"])
        .withColumn("rank", rank)
        .join(F.broadcast(slots), "length")
        .where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    )
    nth = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
