"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are rows labelled 1; the unlabelled set is the whole corpus but for the held-out rows, whatever its
size. A linear model on features of the text's form minimises ``prior * R+(P) + max(0, R-(U) - prior * R-(P))``, the
second term being clipped as the non-negative estimator does: while it is below zero, the step goes the other way. The
loss is the squared one, (1 - z)^2 / 4, so R-(U) is a function of the means and products of the features: one Spark
aggregation over all unlabelled rows gives it exactly, and its gradient at every step. The class prior is estimated
from the share of ones among the training labels. The margin is then mapped to a probability by a one-dimensional
logistic fit on the training labels, so that a score of 0.3 means a chance of 0.3.

Only the labelled rows are a bounded sample (MAX_LABELLED, the smallest hashes of the id, so the draw does not depend on
file order). Labels are learnt only from rows whose crc32 of the id is not divisible by five; those held-out rows never
enter any fit. Scores depend on the text alone: the id, language, source and labels are no features.

Defined cases: null is the empty text; it gets a score like any other. Labels that are null count for nothing; a row
with several labels is positive only if all are 1; of several texts of one labelled id the one with the smallest
features is learnt from. Rows without an id are scored and count as held out. Without both classes among the labels,
every score is the prior (0.5 without labels). Repeated rows get equal scores; extra columns pass unchanged (one named
``score`` is replaced).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import shielded

MAX_LABELLED = 12_000
THRESHOLD = 0.3
FOLDS = 5
STEPS = 1500
RATE = 0.05
RIDGE = 1e-4
STEP = 1024

MARKS = b"!|*%#&$@.,;:?\"'()-_/=+<>[]{}~^`\\"


def byte_classes() -> np.ndarray:
    """Class of each byte: blanks, line ends, digits, lower, upper, lead bytes, second bytes of capitals and small letters of
    the Latin-1 range, other bytes, and every mark on its own."""
    out = np.full(256, 9, np.int64)
    for b in range(256):
        c = chr(b)
        if c in "\n\r":
            out[b] = 1
        elif b <= 0x20:
            out[b] = 0
        elif c.isascii() and c.isdigit():
            out[b] = 2
        elif c.isascii() and c.islower():
            out[b] = 3
        elif c.isascii() and c.isupper():
            out[b] = 4
        elif b >= 0xC0:
            out[b] = 5
        elif 0x80 <= b <= 0x9E:
            out[b] = 6
        elif b >= 0xA0:
            out[b] = 7
    for i, m in enumerate(MARKS):
        out[m] = 10 + i
    return out


CLASSES = byte_classes()
N_CLASSES = 10 + len(MARKS)
N_FEATURES = N_CLASSES + 14


def features(text: str | None) -> np.ndarray:
    """Form of a whole text: shares of byte classes, word and line statistics."""
    raw = (text or "").encode()
    x = np.zeros(N_FEATURES)
    if not raw:
        return x
    counts = np.bincount(CLASSES, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=N_CLASSES)
    x[:N_CLASSES] = np.sqrt(counts / len(raw))
    words = raw.split()
    n = max(1, len(words))
    lines = [w for w in raw.split(b"\n") if w.strip()]
    seen = Counter(words)
    letters = counts[3] + counts[4]
    x[N_CLASSES:] = (
        1.0,
        np.log1p(len(words)) / 5,
        min(len(raw) / n, 40) / 10,
        len(seen) / n,
        max(seen.values(), default=0) / n,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(raw) / max(1, len(lines))) / 5,
        counts[4] / (letters + 1),
        sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 0x80) / n,
        sum(1 for w in words if not w.translate(None, NO_LETTERS)) / n,
        sum(1 for w in words if len(w) > 20) / n,
        sum(1 for w in words if len(w) == 1) / n,
        sum(1 for w in words if len(w) > 1 and w.isupper()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
    )
    return x


NO_LETTERS = bytes(b for b in range(0x80) if not chr(b).isalpha())


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = ((x - self.mean) / self.scale) @ self.weights
        return sigmoid(self.slope * margin + self.offset)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def constant(p: float) -> Model:
    p = min(max(p, 1e-3), 1 - 1e-3)
    zero = np.zeros(N_FEATURES)
    return Model(zero, np.ones(N_FEATURES), zero, 1.0, float(np.log(p / (1 - p))))


@dataclass
class Moments:
    """Number, mean and mean of products of the features of a set of rows."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        return cls(len(x), x.mean(axis=0), x.T @ x / len(x))

    def scaled(self, mean: np.ndarray, scale: np.ndarray) -> Moments:
        """Those of (x - mean) / scale, the constant feature kept at one."""
        shift = np.outer(self.mean, mean)
        m = (self.mean - mean) / scale
        return Moments(self.n, m, (self.products - shift - shift.T + np.outer(mean, mean)) / np.outer(scale, scale))

    def risk(self, w: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
        """Mean of (1 - sign * margin)^2 / 4, and its gradient."""
        pw = self.products @ w
        return float(1 - 2 * sign * (self.mean @ w) + w @ pw) / 4, (pw - sign * self.mean) / 2


def nn_pu(positive: Moments, unlabelled: Moments, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights that minimise the non-negative PU risk of the squared loss, by Adam on the moments of both sets."""
    w, m, v = np.zeros(len(positive.mean)), 0.0, 0.0
    for t in range(1, steps + 1):
        _, plus = positive.risk(w, 1)               # R+(P)
        low_p, minus_p = positive.risk(w, -1)       # R-(P)
        low_u, minus_u = unlabelled.risk(w, -1)     # R-(U)
        g = prior * plus + (minus_u - prior * minus_p) if low_u - prior * low_p >= 0 else prior * minus_p - minus_u
        g = g + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of the labels to the margin, by Newton steps."""
    x = np.column_stack([margin, np.ones(len(margin))])
    target = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((label == 0).sum() + 2))
    w = np.zeros(2)
    for _ in range(50):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p))
        w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return float(w[0]), float(w[1])


def train(x: np.ndarray, label: np.ndarray, unlabelled: Moments | None) -> Model:
    """``label``: 1 and 0 for the rows of ``x``; the unlabelled set is known by its moments."""
    if not (label == 1).any() or not (label == 0).any():
        return constant(float(label.mean()) if len(label) else 0.5)
    prior = float(label.mean())
    unlabelled = unlabelled or Moments.of(x)
    mean = unlabelled.mean.copy()
    scale = np.sqrt(np.maximum(np.diag(unlabelled.products) - mean ** 2, 0)) + 1e-3
    scale[N_CLASSES], mean[N_CLASSES] = 1.0, 0.0
    scaled = (x - mean) / scale
    w = nn_pu(Moments.of(scaled[label == 1]), unlabelled.scaled(mean, scale), prior)
    slope, offset = calibrate(scaled @ w, label)
    return Model(mean, scale, w, slope, offset)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod five; zero is held out. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the bounded labelled sample. Ids are drawn from narrow columns first, so texts
    are read only to compute the features of the drawn rows."""
    drawn = (labels.select("doc_id", F.col("quality").cast("int").alias("q")).where("doc_id is not null and q in (0, 1)")
             .where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.min("q").alias("q")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED))
    wanted = F.broadcast(drawn.select(F.col("doc_id").alias("__id"), "q"))  # at most the bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()).astype(np.float32) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("q"), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "q", "x"])

    rows = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("__id")).select("doc_id", "q", "text")
    schema = rows.select("doc_id", "q", F.array(F.lit(0).cast("float")).alias("x")).schema
    # repeated documents would exceed the bound: one row a drawn id
    got = rows.mapInArrow(run, schema).groupBy("doc_id").agg(F.min("q").alias("q"), F.min("x").alias("x")).toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(zero_copy_only=False), kind="stable")
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES).astype(np.float64)
    return x[order], got.column("q").to_numpy()[order]


def unlabelled_moments(docs: DataFrame) -> Moments | None:
    """Moments over every row that is not held out. Sums are of whole numbers (features in steps of 1/STEP), so they do
    not depend on the order of tasks; a task sends one row a sum, and one row a sum comes back."""
    places = N_FEATURES * (N_FEATURES + 1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(places, np.int64)
        for b in batches:
            x = np.rint(np.array([features(t.as_py()) for t in b.column(0)]).reshape(-1, N_FEATURES) * STEP)
            sums += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()]).astype(np.int64)
        if sums[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(places), pa.int32()), pa.array(sums)], names=["place", "total"])

    free = docs.where(fold(F.col("doc_id")) != 0).select("text").mapInArrow(run, "place int, total long")
    sums = np.zeros(places)
    for r in free.groupBy("place").agg(F.sum("total").alias("total")).collect():
        sums[r["place"]] = r["total"]
    n = int(sums[0])
    if not n:
        return None
    return Moments(n, sums[1:N_FEATURES + 1] / n / STEP, sums[N_FEATURES + 1:].reshape(N_FEATURES, N_FEATURES) / n / STEP ** 2)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    x, label = labelled(docs, labels)
    both = (label == 1).any() and (label == 0).any()
    return train(x, label, unlabelled_moments(docs) if both else None)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, the chance that a whole text is of quality 1."""
    keep = [c for c in docs.columns if c != "score"]
    schema = docs.select(*keep, F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(text_col)]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(model.score(x), pa.float64())], names=[*keep, "score"])

    return docs.select(*keep).mapInArrow(run, schema)


def op9(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows."""
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``documents`` that the classifier does not reject; all their columns stay as they are."""
    model = fit(documents, labels)
    return shielded(documents, ["doc_id", "text"], lambda d: score(d, model).where(F.col("score") >= THRESHOLD))
