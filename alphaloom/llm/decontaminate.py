"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is `width` consecutive words of a benchmark item, or all words of a shorter item. The words of a window are
ordered by rarity in the corpus; a window can occur in a document only where its rarest word does, so that word, the
window's prefix, is what is joined. A candidate place must leave room for the window on both sides of the word (the
positional and length bounds), and is then verified exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm.common import free_name, scratch, text_of

#: ASCII capitals and small letters, and what separates words.
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SMALL = "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows up to which the benchmark is broadcast: some 300 bytes each, 60 MB in all.
BROADCAST_WINDOWS = 200_000


def words_of(text: Column) -> Column:
    """The words of a text: A-Z in lower case, then runs of digits, a-z and anything beyond ASCII."""
    return F.array_remove(F.split(F.translate(text, _CAPITALS, _SMALL), _BETWEEN), "")


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """window (array of words) and items (sorted array of the ids, as text, that have it): each distinct window once."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(text_of()).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(width))
    starts = words.select("item_id", "words", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("start"))
    each = starts.select("item_id", F.slice("words", F.col("start"), F.col("size")).alias("window"))
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def find_windows(docs: DataFrame, items: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, row, n_words and hits of every row of docs; hits: an array of (start, size, items) of all occurrences of windows, null where there is none.

    row numbers the rows of docs, so that repeated ids stay apart.
    """
    windows = scratch(windows_of(items, width))
    source = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words_of(text_of()).alias("words"))
    # How often each word of the benchmark occurs in the corpus; a word's count is summed on the map side first.
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    n = windows.count()
    small = n <= BROADCAST_WINDOWS
    hint = F.broadcast if small else (lambda x: x)
    frequency = source.select(F.explode("words").alias("word")).join(hint(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    placed = windows.select("window", "items", F.posexplode("window").alias("at", "word")).join(frequency, "word", "left")
    by = Window.partitionBy("window").orderBy(F.coalesce("df", F.lit(0)), "word", "at")
    prefix = placed.withColumn("nth", F.row_number().over(by)).where("nth = 1 and df > 0").select("word", "at", "window", "items", F.size("window").alias("size"))
    prefix = scratch(prefix)
    if small:
        hits = _verify_in_place(source, prefix)
    else:
        hits = _verify_by_shuffle(source, prefix)
    # A row of no hits carries the document's length alone.
    return hits.groupBy("row").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"),
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_list(F.when(F.col("items").isNotNull(), F.struct("start", "size", "items"))).alias("hits"),
    )


def _verify_in_place(source: DataFrame, prefix: DataFrame) -> DataFrame:
    """Candidates and their verification in one pass over the words of a document: the prefixes are broadcast, nothing of a document is shuffled before."""
    each = source.select("row", "doc_id", "words", F.posexplode_outer("words").alias("pos", "of"))
    p = F.broadcast(prefix)
    start = F.col("pos") - F.col("at")
    fits = (F.col("of") == F.col("word")) & (start >= 0) & (start + F.col("size") <= F.size("words"))
    # slice() is evaluated only where the bounds hold: an invalid start would be an error.
    same = F.when(fits, F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("window"))
    joined = each.join(p, (F.col("of") == F.col("word")) & same, "left")
    kept = joined.where(F.col("items").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
    return kept.select("row", "doc_id", F.size("words").alias("n_words"), start.alias("start"), "size", "items")


def _verify_by_shuffle(source: DataFrame, prefix: DataFrame) -> DataFrame:
    """The same for a benchmark that isn't broadcast: every place of a document whose word is a prefix is joined with the words around it."""
    reach = prefix.agg(F.max("size").alias("most")).first()["most"] or 1
    # Words that are no prefix go before any slice is made; what is left is as much as the benchmark's words occur.
    each = source.select("row", "words", F.posexplode("words").alias("pos", "of")).join(prefix.select(F.col("word").alias("of")).distinct(), "of", "left_semi")
    low = F.greatest(F.col("pos") - reach + 1, F.lit(0))
    around = F.slice("words", low + 1, F.lit(2 * reach - 1))
    places = each.select("row", "pos", "of", low.alias("low"), around.alias("around"))
    start = F.col("pos") - F.col("at")
    fits = (start >= F.col("low")) & (start - F.col("low") + F.col("size") <= F.size("around"))
    same = F.when(fits, F.slice("around", F.greatest(start - F.col("low"), F.lit(0)) + 1, F.col("size")) == F.col("window"))
    found = places.join(prefix, F.col("of") == F.col("word")).where(same).select("row", start.alias("start"), "size", "items")
    none = F.lit(None)
    found = found.select("row", none.cast(source.schema["doc_id"].dataType).alias("doc_id"), none.cast("int").alias("n_words"), "start", "size", "items")
    rows = source.select("row", "doc_id", F.size("words").alias("n_words"), none.cast("int").alias("start"), none.cast("int").alias("size"), none.cast("array<string>").alias("items"))
    return rows.unionByName(found)


def report(docs: DataFrame, items: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window), n_items and items (those with occurring windows), contaminated.

    contaminated: n_hit > 0 and 20 * n_hit >= n_words. A null or empty text has no words and is clean; so is every
    document if the benchmark is empty. One row for each row of docs.
    """
    found = find_windows(docs, items, width)
    # The union of the intervals, in order of their starts: what each adds beyond the end reached so far.
    ordered = F.array_sort(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), (h["start"] + h["size"]).alias("end"))))
    none = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct(
        (acc["hit"] + F.greatest(x["end"] - F.greatest(x["start"], acc["end"]), F.lit(0))).alias("hit"),
        F.greatest(x["end"], acc["end"]).alias("end"),
    )
    hit = F.aggregate(ordered, none, step, lambda acc: acc["hit"]).cast("long")
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), ids.alias("items"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 13) -> DataFrame:
    """docs without exactly its contaminated rows, whatever their doc_id: rows are told apart by their text, which alone decides."""
    digest = F.sha2(text_of().cast("binary"), 256)
    own, of = free_name(docs, "own_text"), free_name(docs, "bad_text")
    bad = report(docs.select(digest.alias("doc_id"), "text"), items, width).where("contaminated").select(F.col("doc_id").alias(of)).distinct()
    return docs.withColumn(own, digest).join(bad, F.col(own) == F.col(of), "left_anti").drop(own)
