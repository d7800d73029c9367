"""Quality classifier (8): naive Bayes log-count ratios as the scale of n-gram indicators, then a linear hinge-loss model.

N-grams are words and word pairs, shapes of words and their pairs (upper, lower, digit, sign), and which words of three in a row are
equal; hashed. The ratios count all labelled training rows. The model is fit by dual coordinate descent on a bounded sample of them,
and a logistic curve, fit on a part of the sample that the descent doesn't see, turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactsheet.llm.common import checkpointed, small, tidy

#: Hashed n-grams; rows of the sample that the model is fit on, and how many of these set the curve.
DIMENSIONS, SAMPLE, CURVE_SHARE = 1 << 20, 12_000, 0.2
#: Counts come to the driver in so many parts.
PARTS = 64
ALPHA, COST, EPOCHS, LEAST_DOCS = 1.0, 1.0, 12, 3
#: Labels of at most this many rows are broadcast, 16 bytes each.
BROADCAST_LABELS = 1_000_000
CACHED = 200_000
U = np.uint64
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ U(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(30))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shape(word: bytes) -> bytes:
    s = word.translate(_SHAPE)
    return bytes(c for i, c in enumerate(s) if not i or c != s[i - 1])


class Features(dict):
    """The distinct hashed n-grams of a text."""

    def __init__(self):
        super().__init__()
        self.word, self.shape = [], []

    def __missing__(self, word: bytes) -> int:
        self.word.append(xxhash.xxh64_intdigest(word.translate(_LOWER)))
        self.shape.append(xxhash.xxh64_intdigest(shape(word)))
        out = self[word] = len(self.word) - 1
        return out

    def of(self, text: str | None) -> np.ndarray:
        words = text.encode().split() if text else []
        if not words:
            return np.zeros(0, np.int32)
        if len(self) > CACHED:
            self.clear()
            self.word, self.shape = [], []
        at = list(map(self.__getitem__, words))
        w = np.fromiter(map(self.word.__getitem__, at), U, len(at))
        s = np.fromiter(map(self.shape.__getitem__, at), U, len(at))
        same = (w[1:] == w[:-1]).astype(U)
        grams = [mix(w, 1), mix(w[:-1] * U(3) + w[1:], 2), mix(s, 3), mix(s[:-1] * U(3) + s[1:], 4), mix(same[:-1] * U(2) + same[1:], 5)]
        out = (np.concatenate(grams) % U(DIMENSIONS)).astype(np.int32)
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


@dataclass
class Model:
    """ratio: of each n-gram. weight: ratio times the hinge model's weight. slope and shift: of the curve."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, f: np.ndarray) -> float:
        r = self.ratio[f]
        norm = float(np.sqrt(r @ r))
        return self.bias + (float(self.weight[f].sum()) / norm if norm else 0.0)

    def score(self, f: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(f) + self.shift, -30, 30))))


def ratios(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log of the smoothed share of each n-gram among the good rows' over that among the bad; 0 for rare ones."""
    p, q = good + ALPHA, bad + ALPHA
    r = np.log((p / p.sum()) / (q / q.sum()))
    r[good + bad < LEAST_DOCS] = 0
    return r.astype(np.float32)


def descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared hinge loss on rows scaled to length 1, with a constant 1 for the bias."""
    w, bias, alpha = np.zeros(len(ratio), np.float32), 0.0, np.zeros(len(rows))
    y = np.where(labels == 1, 1.0, -1.0)
    x = []
    for f in rows:
        v = ratio[f]
        norm = np.sqrt(float(v @ v))
        x.append(v / norm if norm else v)
    rng, diagonal = np.random.default_rng(3), 1 / (2 * cost)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, v = rows[i], x[i]
            gradient = y[i] * (float(w[f] @ v) + bias) - 1 + diagonal * alpha[i]
            new = max(0.0, alpha[i] - gradient / ((2.0 if len(f) else 1.0) + diagonal))
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += np.float32(step) * v
                bias += step
                alpha[i] = new
    return w, bias


def curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, with targets drawn in a little from 0 and 1."""
    good, bad = max(1, int((labels == 1).sum())), max(1, int((labels != 1).sum()))
    t = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * margins).sum() + 1e-3 * (a - 1), (p - t).sum()])
        m = np.array([[(h * margins * margins).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (float(a), float(b)) if a > 0 and np.isfinite([a, b]).all() else (1.0, 0.0)


@tidy
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text and label: of each n-gram of the task's texts, how many good and bad ones have it."""
    features, n = Features(), np.zeros((2, DIMENSIONS), np.uint32)
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n[int(label == 1), features.of(text)] += 1
    for some in np.array_split(np.flatnonzero(n.any(axis=0)), 16):
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(n[k, some].astype(np.int64)) for k in (1, 0))], names=["feature", "good", "bad"])


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one part of the n-grams: all as arrays."""
    return pd.DataFrame({k: [pdf[k].to_numpy(np.int64).tobytes()] for k in ("feature", "good", "bad")})


@tidy
def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        f = [features.of(t).tobytes() for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.binary()), batch.column(1), batch.column(2)], names=["features", "label", "order"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """labelled: doc_id, text, label (0 or 1). sample: rows, at most, that the hinge model and the curve are fit on (rows that repeat both
    doc_id and text are one there); the ratios take all.

    Without rows, or with one label only, the ratios and so the scores say nothing: they are 0.5 or close.
    """
    counts = labelled.select("text", "label").mapInArrow(_counts, "feature int, good long, bad long")
    counts = counts.groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))  # DIMENSIONS rows, at most
    parts = counts.groupBy(F.pmod("feature", F.lit(PARTS))).applyInPandas(_packed, "feature binary, good binary, bad binary").collect()
    if not parts:
        return Model(np.zeros(DIMENSIONS, np.float32), np.zeros(DIMENSIONS, np.float32), 0.0, 1.0, 0.0)
    good, bad = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for r in parts:
        at = np.frombuffer(r.feature, np.int64)
        good[at], bad[at] = np.frombuffer(r.good, np.int64), np.frombuffer(r.bad, np.int64)
    ratio = ratios(good, bad)
    keyed = labelled.withColumn("key", F.xxhash64("text"))
    ids = keyed.select("doc_id", "key").distinct().withColumn("order", F.xxhash64(F.lit("sample"), "doc_id", "key")).orderBy("order", "doc_id", "key").limit(sample)
    ids = checkpointed(ids)  # a bounded number of ids; rows that repeat one with its text count once
    chosen = keyed.join(F.broadcast(ids), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("text", "label", "order")
    fitted = chosen.mapInArrow(_rows, "features binary, label int, order long").repartition(1)
    return _unpack(ratio, fitted.mapInPandas(_fit_on(ratio), "weight binary, bias double, slope double, shift double").first())


def _fit_on(ratio: np.ndarray):
    """Fits on the one partition that holds the sample."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(frames).sort_values("order", kind="stable")
        rows = [np.frombuffer(x, np.int32) for x in pdf["features"]]
        labels = pdf["label"].to_numpy()
        cut = len(rows) - int(len(rows) * CURVE_SHARE)
        w, bias = descend(rows[:cut], labels[:cut], ratio)
        model = Model(ratio, ratio * w, bias, 1.0, 0.0)
        seen = slice(cut, None) if cut < len(rows) else slice(None)
        slope, shift = curve(np.array([model.margin(f) for f in rows[seen]]), labels[seen])
        yield pd.DataFrame({"weight": [model.weight.tobytes()], "bias": [bias], "slope": [slope], "shift": [shift]})

    return run


def _unpack(ratio: np.ndarray, row) -> Model:
    return Model(ratio, np.frombuffer(row.weight, np.float32), row.bias, row.slope, row.shift)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE, text: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher where label 1 is likelier) and predicted (1 from 0.5 on) of each row of docs.

    labels: doc_id and quality. Rows that held_out (of doc_id) holds for teach nothing; null counts as held out. Null labels are left
    out, and of several for one document the highest counts. Only the text makes a score; null and empty texts get that of no
    n-grams. Rows stay as they are, repeated ones too. An empty table gives an empty table.
    """
    ours = docs.select("doc_id", F.col(text).alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    known = F.broadcast(known) if small(known, BROADCAST_LABELS) else known
    model = fit(ours.where(~F.col("held_out")).join(known, "doc_id").select("doc_id", "text", "label"), sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            scores = [shared.value.score(features.of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    scored = ours.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
