"""A counterfactually regularised toxicity classifier.

A logistic model over the distinct words of a text and their beginnings (invented and inflected words share these).
While it learns, every labelled text that names a group is paired with the same text naming another group of that
kind (one that names several also with each of them swapped alone), and a change of the score between the two is
penalised; so a group's name alone says little about toxicity.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.common import blocks, on_executors, sample_ids

_WORD = re.compile(r"[^\W\d_]+")
_BEGINNINGS = (4, 5, 6, 7)
_WORDS_KEPT = 200_000

#: Identity terms that may stand for each other, by kind.
IDENTITY_TERMS = (
    ("women", "men"),
    ("girls", "boys"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "citizens", "refugees", "natives"),
    ("femmes", "hommes"),
    ("frauen", "männer"),
    ("mujeres", "hombres"),
)


@dataclass(frozen=True)
class ToxicityModel:
    """Weight of each word or beginning (a beginning ends with `*`), the constant, and how many counterfactual pairs it learned from."""

    weights: dict[str, float]
    constant: float
    n_pairs: int = 0


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in _BEGINNINGS if len(word) >= n)]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def counterfactual(words: set[str], terms: tuple[tuple[str, ...], ...]) -> set[str] | None:
    """The words with each identity term replaced by the next of its kind; None if there is none."""
    after = {t: kind[(i + 1) % len(kind)] for kind in terms for i, t in enumerate(kind)}
    return {after.get(w, w) for w in words} if any(w in after for w in words) else None


def counterfactuals(words: set[str], terms: tuple[tuple[str, ...], ...]) -> list[set[str]]:
    """The words with all identity terms replaced by the next of their kinds, and, of several terms, with each replaced alone: a text that names both of two groups has the same words if both are swapped, but not if one is."""
    all_ = counterfactual(words, terms)
    if all_ is None:
        return []
    after = {t: kind[(i + 1) % len(kind)] for kind in terms for i, t in enumerate(kind)}
    own = sorted(w for w in words if w in after)
    each = [words - {w} | {after[w]} for w in own] if len(own) > 1 else []
    return [c for c in (all_, *each) if c != words]


def train(texts: list[str], labels: np.ndarray, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, penalty: float = 1.0, ridge: float = 4e-4, rounds: int = 400) -> ToxicityModel:
    """A model of texts and 0/1 labels. penalty: of the squared change of the score in a counterfactual pair.

    Words and beginnings in at least 4 texts that tell the labels apart (log odds over 3 standard errors) take part.
    """
    bags = [sorted(words_of(t)) for t in texts]
    seen = defaultdict(lambda: [0, 0])
    for bag, y in zip(bags, labels, strict=True):
        for f in {f for w in bag for f in features_of(w)}:
            seen[f][int(y)] += 1
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    names = [f for f, (b, a) in sorted(seen.items()) if a + b >= 4 and _telling(a, b, n1, n0)]
    number = {f: i for i, f in enumerate(names)}

    def matrix(sets) -> tuple[np.ndarray, np.ndarray]:
        row, col = [], []
        for i, words in enumerate(sets):
            own = [number[f] for w in words for f in features_of(w) if f in number]
            row += [i] * len(own)
            col += own
        return np.array(row, np.int64), np.array(col, np.int64)

    row, col = matrix(bags)
    pairs = [(set(b), c) for b in bags for c in counterfactuals(set(b), terms)]
    (ra, ca), (rb, cb), n_pairs = matrix(a for a, _ in pairs), matrix(b for _, b in pairs), len(pairs)
    weight = np.zeros(len(names))
    share = n1 / max(1, len(labels))
    constant = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    step2, step2_c = np.full(len(names), 1e-8), 1e-8
    for i in range(rounds if names else 0):
        z = np.bincount(row, weights=weight[col], minlength=len(bags)) + constant
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        gradient = np.bincount(col, weights=off[row], minlength=len(names)) / len(bags) + ridge * weight
        if n_pairs:
            change = np.bincount(ra, weights=weight[ca], minlength=n_pairs) - np.bincount(rb, weights=weight[cb], minlength=n_pairs)
            gradient += 2 * penalty / n_pairs * (np.bincount(ca, weights=change[ra], minlength=len(names)) - np.bincount(cb, weights=change[rb], minlength=len(names)))
        step2 = 0.95 * step2 + 0.05 * gradient**2
        step2_c = 0.95 * step2_c + 0.05 * off.mean() ** 2
        rate = 0.05 * (1 - i / rounds)
        weight -= rate * gradient / np.sqrt(step2)
        constant -= rate * off.mean() / np.sqrt(step2_c)
    return ToxicityModel({f: float(w) for f, w in zip(names, weight, strict=True) if abs(w) > 1e-4}, float(constant), n_pairs)


def _telling(a: int, b: int, n1: int, n0: int) -> bool:
    odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
    return abs(odds) > 3 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 3000, **options) -> ToxicityModel:
    """A model from docs (doc_id, text) and labels (doc_id, label 0 or 1): about per_class rows of either label, chosen by a hash of doc_id, whole.

    Rows with a null label or text are left out; of a repeated doc_id the larger label counts. With labels of one kind
    only, or none, nothing tells texts apart: the model is a constant, the share of label 1 after one more 1 and two
    more 0 have been counted.
    """
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = F.broadcast(sample_ids(known, "label", "doc_id", per_class))  # bounded: about per_class rows a label
    rows = docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").select("doc_id", "label", "text").dropDuplicates(["doc_id"]).toPandas()
    rows = rows.sort_values("doc_id", ignore_index=True)
    if rows.label.nunique() < 2:
        return ToxicityModel({}, float(np.log((rows.label.sum() + 1) / (len(rows) - rows.label.sum() + 2))))
    model = train(list(rows.text), rows.label.to_numpy(float), **options)
    share = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    y = rows.label.mean()
    return ToxicityModel(model.weights, model.constant + float(np.log(share[1] / share[0]) - np.log(y / (1 - y))), model.n_pairs)


class _Weights(dict):
    def __init__(self, model: ToxicityModel):
        self.of = model.weights.get

    def __missing__(self, word: str) -> float:
        if len(self) > _WORDS_KEPT:
            self.clear()
        w = self[word] = sum(self.of(f, 0.0) for f in features_of(word))
        return w


def _score(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = _Weights(model).__getitem__
        for batch, texts in blocks(batches, "text"):
            z = np.array([model.constant + sum(map(weight, words_of(t or ""))) for t in texts])
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and held_out of docs (doc_id, held_out, text), with score (0 to 1) and predicted (1 from 0.5). The whole text counts; a null text scores as an empty one, which has the constant alone."""
    on_executors(docs.sparkSession)
    return docs.select("doc_id", "held_out", "text").mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
