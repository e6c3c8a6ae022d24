"""Quality classifier: a linear support vector machine over Naive Bayes features.

Indicators of word n-grams are scaled by their log-count ratios between the two classes; a linear
hinge-loss model is then fitted by dual coordinate descent, and its margin is turned into a
probability by a logistic fit.  The machine is fitted on a bounded sample of the labelled rows, a
part of which serves the logistic fit alone; the ratios come from all other labelled rows.  Sample
and part follow from a hash of the doc_id, so the same rows give the same model however they are
partitioned and ordered.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import discard, held_out, map_batches, mix64, pieces, stored, utf8, word_hashes

#: Hashed n-grams; with the constant, the model is a vector of this size plus one.
FEATURES = 1 << 18
SMOOTHING = 1.0
#: Labelled rows, at most, on which the machine and its calibration are fitted.
SAMPLE = 12_000
#: Bytes of their features, at most: the driver holds them.
SAMPLE_BYTES = 200 << 20
#: Of the sample, one row in CALIBRATION serves the logistic fit alone.
CALIBRATION = 4
COST, EPOCHS = 1.0, 15
PLACES = 1 << 20
THRESHOLD = 0.7
SLICE = 1 << 14

TOKENS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")


class Model(NamedTuple):
    """A text's margin is the product of ``weights`` and its scaled indicators, plus the constant."""

    weights: np.ndarray
    ratios: np.ndarray
    constant: float
    slope: float
    offset: float


def features(text: bytes) -> np.ndarray:
    """Sorted numbers of the text's distinct n-grams: words and runs of other signs, alone and in
    pairs. A pair of the same word twice is one feature whatever the word."""
    h = word_hashes(TOKENS.findall(text))
    pairs = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    pairs[h[:-1] == h[1:]] = 1
    return np.unique(np.concatenate([mix64(h), pairs]) & np.uint64(FEATURES - 1)).astype(np.int32)


def class_counts(labelled: DataFrame) -> np.ndarray:
    """``labelled`` (text, quality) -> for each class the documents with each feature. Tasks send
    their sums in slices, which Spark adds up."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, FEATURES), np.float64)
        for batch in pieces(batches):
            for text, quality in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                held[quality, features(text)] += 1
        for i in range(0, FEATURES, SLICE):
            part = held[:, i : i + SLICE].astype(np.float32)
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // SLICE], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(part, np.float32).astype(np.float64)
        for i, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "counts"])

    parts = labelled.select("text", "quality").mapInArrow(count, "slice int, counts binary").repartition(8, "slice")
    out = np.zeros((2, FEATURES))
    for r in parts.mapInArrow(add, "slice int, counts binary").toLocalIterator():
        out[:, r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"]).reshape(2, SLICE)
    return out


def log_count_ratios(counts: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    p = counts + smoothing
    p /= p.sum(axis=1, keepdims=True)
    return np.log(p[1] / p[0])


def vector(found: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """The scaled indicators of a text, at unit length."""
    x = ratios[found]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the hinge-loss machine; the last one belongs to a constant.

    rows: features and values of each row; y: +1 or -1.  Each step solves for the dual variable
    of one row exactly, within [0, cost of its class]; the classes' costs balance their sizes.
    """
    w = np.zeros(FEATURES + 1)
    share = np.array([(y < 0).mean(), (y > 0).mean()])
    bound = np.where(y > 0, cost * 0.5 / max(share[1], 1e-9), cost * 0.5 / max(share[0], 1e-9))
    alpha = np.zeros(len(rows))
    curvature = np.array([v @ v + 1.0 for _, v in rows])
    order = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            gradient = y[i] * (w[at] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / curvature[i], 0.0), bound[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                w[-1] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability that a margin means +1, by Newton's method."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))])
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(b @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (target - p))
        b += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def fit(labelled: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model of ``labelled`` (doc_id, text, quality 0 or 1).

    Weights and calibration come from at most ``sample`` rows, ratios from all that are not used
    for the calibration.  Where either part of the sample would lack a class, no rows are set aside
    and the calibration has those of the fit.  One class alone, or no row at all, gives the model
    that says which class there is (without rows: 0.5).  Long texts have many features: of the rows
    picked, only the first by their hash count whose features take ``sample_bytes`` together.
    """
    sizes = {r["quality"]: r["count"] for r in labelled.groupBy("quality").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0, 5.0 * float(np.sign(n1 - n0)))
    # some less than the bound, as the hash does not deal out exactly
    share = min(1.0, 0.97 * sample / (n0 + n1)) if n0 + n1 > sample else 1.0
    place = F.pmod(F.xxhash64("doc_id"), F.lit(PLACES))
    aside = (place < int(share * PLACES)) & (F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(CALIBRATION)) == 0)

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [*(batch.column(i) for i in range(4)), pa.array([features(t).tobytes() for t in utf8(batch.column(4))], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "aside", "quality", "features"])

    few = labelled.filter(place < int(share * PLACES)).select("doc_id", place.alias("place"), aside.alias("aside"), "quality", "text")
    few = picked = stored(map_batches(few, found, "doc_id long, place long, aside boolean, quality int, features binary"), "sample")
    size = few.agg(F.sum(F.length("features"))).first()[0]
    if size > sample_bytes:  # the hash deals out evenly, so a part of its range has that part of the bytes
        few = few.filter(F.col("place") < int(share * PLACES * sample_bytes / size))
    rows, held = [], 0
    for r in few.orderBy("place", "doc_id", "quality", "features").limit(sample).toLocalIterator():
        held += len(r["features"])
        if held > sample_bytes and rows:
            break
        rows.append(r)
    discard(picked)
    y = np.array([1.0 if r["quality"] else -1.0 for r in rows])
    fold = np.array([r["aside"] for r in rows])
    if not all(len(set(y[part])) == 2 for part in (fold, ~fold)):
        fold[:] = False
    ratios = log_count_ratios(class_counts(labelled.filter(~aside) if fold.any() else labelled))
    data = [np.frombuffer(r["features"], np.int32) for r in rows]
    data = [(f, vector(f, ratios)) for f in data]
    w = dual_coordinate_descent([d for d, f in zip(data, fold) if not f], y[~fold])
    seen = np.flatnonzero(fold) if fold.any() else np.arange(len(y))
    slope, offset = logistic(np.array([w[data[i][0]] @ data[i][1] + w[-1] for i in seen]), y[seen])
    return Model(w[:-1], ratios, float(w[-1]), slope, offset)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, score, predicted. A null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m: Model = shared.value
        margins = np.empty(batch.num_rows)
        for i, text in enumerate(utf8(batch.column(1))):
            found = features(text)
            margins[i] = m.weights[found] @ vector(found, m.ratios) + m.constant
        p = 1 / (1 + np.exp(-np.clip(m.slope * margins + m.offset, -30, 30)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled rows that are not held out and score all of ``docs``:
    doc_id, held_out, score, predicted.

    Rows of ``labels`` (doc_id, quality) without a quality of 0 or 1 or without a doc_id teach
    nothing; repeated ones count again.  A null text is scored, and learned, as an empty one, whose
    score is that of the constant alone.  Texts may be of any length.  Repeated documents have a
    row each, with equal scores for equal texts; no documents give no rows.  Labels of held-out rows
    are never read.  Other columns are ignored.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1)")
    # a merge join at every size: labels may be as many as documents
    labelled = docs.filter(~held_out()).select("doc_id", "text").join(known.hint("merge"), "doc_id")
    return score(docs, fit(labelled)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
