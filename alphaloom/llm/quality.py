"""Quality scores by compression: a text is good if a zstandard dictionary of good text serves it better than one of bad text.

The two dictionaries are built from labelled text. A text is cut into blocks, each compressed alone with either; the
difference of the two sizes, divided by their sum, says which dictionary serves the block. Blocks are short, so that
what precedes in the text doesn't stand in for the dictionary. Normalised differences alone are calibrated to a
probability: of the whole text, of its worst blocks, and how many blocks are served clearly better by either.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alphaloom.llm.common import blocks, on_executors, sample_ids

#: Bytes in a block; the whole is also compared in long blocks.
_BLOCK, _LONG = 64, 1024
_LEVEL = 3
#: The normalised difference from which a block is clearly served better by one dictionary.
_CLEAR = 0.02


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries of good and bad text, and a logistic calibration of the features: weights, after means and scales."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]


class _Sizes:
    """Sizes of blocks compressed with the dictionary of good text and with that of bad text."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.by = []
        for data in (good, bad):
            kept = zstandard.ZstdCompressionDict(data)
            kept.precompute_compress(level=_LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=_LEVEL, dict_data=kept, write_content_size=False, write_dict_id=False, write_checksum=False))

    def of(self, raw: bytes, block: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [raw[i : i + block] for i in range(0, len(raw), block)] or [b""]
        good, bad = (np.fromiter((len(c.compress(p)) for p in parts), np.int64, len(parts)) for c in self.by)
        return good, bad

    def features(self, text: str) -> list[float]:
        """Six differences, by which bad text is larger than good text if the text is good; an empty text has zeros."""
        raw = text.encode("utf-8", "replace")
        good, bad = self.of(raw, _BLOCK)
        each = (bad - good) / (bad + good)
        worst = np.sort(each)[: max(1, len(each) // 4)]
        total, by_length = (bad - good).sum() / (bad + good).sum(), (bad - good).sum() / (_BLOCK * len(each))
        good, bad = self.of(raw, _LONG)
        return [total, by_length, worst.mean(), (each < -_CLEAR).mean(), (each > _CLEAR).mean(), (bad - good).sum() / (bad + good).sum()]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights, the last being the constant's, by Newton's method with a quadratic penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, penalty), 1e-9]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(keep + 1e-9), x.T @ (p - y) / len(x) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _expand(x: np.ndarray, means: np.ndarray, scales: np.ndarray) -> np.ndarray:
    z = (x - means) / scales
    return np.column_stack([z, *(z[:, [i]] * z[:, i:] for i in range(z.shape[1]))])


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 3000, dictionary: int = 32_768) -> QualityModel | None:
    """A model from labelled documents: docs (doc_id, text) and labels (doc_id, label 0 or 1), about per_class of either label.

    Half of the rows make the dictionaries, the other half the calibration, which a dictionary's own text would
    mislead. Rows with a null label or text are left out; of a repeated doc_id the larger label counts. With no row of
    one label there is no model.
    """
    import zstandard

    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = F.broadcast(sample_ids(known, "label", "doc_id", per_class))  # bounded: about per_class rows a label
    rows = docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").select("doc_id", "label", "text").dropDuplicates(["doc_id"]).toPandas()
    rows = rows.sort_values("doc_id", ignore_index=True)
    if rows.empty or rows.label.nunique() < 2:
        return None
    # Equal texts fall on the same side, or a group of copies would be in both.
    half = np.fromiter((hash_of(t) % 2 for t in rows.text), bool, len(rows))
    data = {}
    for label in (0, 1):
        texts = rows.text[half & (rows.label == label)].drop_duplicates()
        pieces = [raw[i : i + _BLOCK] for raw in map(str.encode, texts) for i in range(0, len(raw), _BLOCK)] or [b" "]
        try:
            data[label] = zstandard.train_dictionary(dictionary, pieces).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself serves
            data[label] = b"".join(pieces)[-dictionary:]
    rest = rows[~half] if rows[~half].label.nunique() == 2 else rows
    sizes = _Sizes(data[1], data[0])
    x, y = np.array([sizes.features(t) for t in rest.text]), rest.label.to_numpy(float)
    means, scales = x.mean(axis=0), x.std(axis=0) + 1e-9
    # The sample may hold the labels in other shares than the corpus: its odds are set right in the constant.
    share = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    w = _logistic(_expand(x, means, scales), y)
    w[-1] += math.log(share[1] / share[0]) - math.log(max(y.mean(), 1e-9) / max(1 - y.mean(), 1e-9))
    return QualityModel(data[1], data[0], tuple(w), tuple(means), tuple(scales))


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "replace"))


def _score(model: QualityModel | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = model and _Sizes(model.good, model.bad)
        for batch, texts in blocks(batches, "text"):
            if model:
                x = np.array([sizes.features(t or "") for t in texts])
                z = _expand(x, np.array(model.means), np.array(model.scales)) @ np.array(model.weights[:-1]) + model.weights[-1]
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            else:
                score = np.full(len(texts), 0.5)
            columns = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return run


def score_quality(docs: DataFrame, model: QualityModel | None, threshold: float = 0.3) -> DataFrame:
    """docs, which must have a column text, with score (0 to 1, higher: better) and predicted (1 if score >= threshold).

    The whole text counts; a null text scores as an empty one; without a model every score is 0.5. Columns score and
    predicted of docs are replaced.
    """
    on_executors(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(_score(model, threshold), schema)
