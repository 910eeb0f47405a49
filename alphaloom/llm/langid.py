"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams, by falling frequency. A document is given the
language whose profile is nearest by the out-of-place distance: for each of the document's most frequent n-grams, how
far its rank is from its rank in the profile, or the profile's length if it isn't there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm.common import blocks, on_executors, sample_ids

_BITS = 21  # a code point
_LETTER: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if "is" not in _LETTER:
        _LETTER["is"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER["is"]


def _grams(texts: list[str], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, n-gram) of every n-gram of 1 to `longest` letters; words are bordered by one blank, the blank alone is no n-gram.

    An n-gram is an integer of three code points, so `longest` is 3 at most.
    """
    codes = np.frombuffer(" ".join(["", *(t.lower() for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[codes]
    owner = np.repeat(np.arange(len(texts) + 1), [1, *(len(t.lower()) + 1 for t in texts)]) - 1  # the leading blank has no owner
    codes = np.where(letter, codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1]  # one blank of each run
    codes, letter, owner = codes[keep], letter[keep], np.maximum(owner[keep], 0)
    found, docs = [codes[letter]], [owner[letter]]
    if longest > 1:
        pair = (codes[:-1] << _BITS) | codes[1:]
        found.append(pair)
        docs.append(np.where(letter[:-1], owner[:-1], owner[1:]))
    if longest > 2:
        middle = letter[1:-1]  # no n-gram runs over a border between words
        found.append(((pair[:-1] << _BITS) | codes[2:])[middle])
        docs.append(owner[1:-1][middle])
    return np.concatenate(docs), np.concatenate(found)


def _counted(docs: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, n-gram) with counts."""
    distinct, code = np.unique(grams, return_inverse=True)
    key, n = np.unique(docs * len(distinct) + code, return_counts=True)
    return key // max(1, len(distinct)), distinct[key % max(1, len(distinct))], n


def _count_languages(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text", chars=300_000):
            names, which = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            doc, gram = _grams(texts, longest)
            lang, gram, n = _counted(which[doc], gram)
            yield pa.RecordBatch.from_arrays([pa.array(names[lang], pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return run


def fit_profiles(docs: DataFrame, lang: Column, size: int = 400, longest: int = 3, per_language: int = 1500) -> dict[str, list[int]]:
    """The profile of each non-null language: its `size` most frequent n-grams, ties by n-gram.

    At most about per_language documents of a language, chosen by a hash of doc_id, are counted, whole; equal texts
    among them count once, so that a group of copies doesn't make the profile. Null texts are left out.
    """
    on_executors(docs.sparkSession)
    rows = docs.select("doc_id", "text", lang.cast("string").alias("lang")).where("lang is not null and text is not null")
    chosen = sample_ids(rows, "lang", "doc_id", per_language).dropDuplicates(["lang", "text"]).select("lang", "text")
    counts = chosen.mapInArrow(_count_languages(longest), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for name, gram, _ in sorted(ranked.select("lang", "gram", "rank").collect(), key=lambda r: (r[0], r[2])):  # size rows a language
        profiles.setdefault(name, []).append(gram)
    return profiles


def _distances(texts: list[str], names: list[str], profiles: dict[str, list[int]], longest: int) -> np.ndarray:
    """Out-of-place distance of each text from each profile, as a share of the largest that its number of n-grams allows. A text without letters: nan."""
    size = max(map(len, profiles.values()))
    docs, grams, n = _counted(*_grams(texts, longest))
    order = np.lexsort((grams, -n, docs))
    docs, grams = docs[order], grams[order]
    first = np.searchsorted(docs, np.arange(len(texts)))
    rank = np.arange(len(docs)) - first[docs]
    keep = rank < size
    docs, grams, rank = docs[keep], grams[keep], rank[keep]
    used = np.bincount(docs, minlength=len(texts))
    out = np.full((len(texts), len(names)), np.nan)
    for k, name in enumerate(names):
        profile = np.array(profiles[name], np.int64)
        by = np.argsort(profile)
        at = np.minimum(np.searchsorted(profile[by], grams), len(profile) - 1)
        place = by[at]
        off = np.where(profile[place] == grams, np.abs(place - rank), size)
        total = np.bincount(docs, weights=off, minlength=len(texts))
        out[used > 0, k] = (total / np.maximum(1, used * size))[used > 0]
    return out


def _predict(profiles: dict[str, list[int]], longest: int):
    names = sorted(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text", chars=500_000):
            far = _distances([t or "" for t in texts], names, profiles, longest) if names else np.full((len(texts), 1), np.nan)
            known = ~np.isnan(far[:, 0])
            best = np.where(known, np.argmin(np.where(np.isnan(far), 2, far), axis=1), -1)
            near = np.where(known, 1 - far[np.arange(len(far)), np.maximum(best, 0)], 0.0)
            lang = [names[b] if b >= 0 else "und" for b in best]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(near)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: dict[str, list[int]], longest: int = 3) -> DataFrame:
    """doc_id and held_out of docs (doc_id, held_out, text), with lang_pred and score.

    score: one less the winning profile's distance, as a share of the largest possible (0 to 1). A null text, or one
    without a letter, is `und` with score 0, as is everything if there is no profile. Ties go to the first language
    by name. The whole text counts. Repeated rows are answered each.
    """
    on_executors(docs.sparkSession)
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict(profiles, longest), "doc_id long, held_out boolean, lang_pred string, score double")
