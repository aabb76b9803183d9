"""Operator 3, quality classifier: regularised quadratic discriminant over document statistics.

1. Each whole text gives ``FEATURES`` transformed statistics (lengths, character shares, repetition).
   They are small and go to a checkpoint.
2. Joined with the training labels, the class counts, sums and second moments are added up in Spark over
   all training rows. The driver shrinks each class covariance towards the pooled diagonal, factors it
   once (Cholesky) and keeps the factors.
3. A text's score is the difference of the two classes' log densities (Mahalanobis distances through
   the cached factors) put through a logistic curve, which is fitted to a histogram of the
   training rows' differences (a bounded number of bins).

Defined results: null or empty text has the statistics of a text without words and is scored like any
other; rows without a usable label, or with a null id, are not learned from; with fewer than two
training rows of a class all scores equal the smoothed share of label 1; repeated rows are scored each; an
empty table gives no row; only ``doc_id`` and ``text`` are read from documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import checkpointed, crc_mod, doc_rows, importable, table
from touchline.llm.labelled import fit_logistic, sigmoid, training_labels

MOD, HELD, CUT = 4, 2, 0.7
#: Share of the pooled diagonal in each class covariance, and the ridge on standardised statistics.
SHRINK, RIDGE = 0.2, 1e-3
#: Differences are clipped to +-SPAN and counted in bins of BIN for the logistic curve.
SPAN, BIN = 200.0, 0.5
FEATURES = ("words", "word_mean", "word_spread", "upper", "digits", "symbols", "stops", "shouts", "lines", "high_bytes",
            "distinct", "doubled_lines", "space", "bare_tokens", "pair_repeat", "byte_entropy")

_CLASS = {name: np.zeros(256, bool) for name in ("upper", "digits", "symbols", "stops", "shouts", "space", "high")}
_CLASS["upper"][65:91] = _CLASS["digits"][48:58] = _CLASS["high"][128:] = True
for _name, _chars in (("symbols", b"#*$%&|<>@^~_=+{}[]\\/"), ("stops", b".,;:"), ("shouts", b"!?"), ("space", b" \t\n\x0b\x0c\r")):
    _CLASS[_name][list(_chars)] = True
_MASKS = np.column_stack([_CLASS[n] for n in ("upper", "digits", "symbols", "stops", "shouts", "space", "high")]).astype(float)


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one text, in the order of ``FEATURES``."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digits, symbols, stops, shouts, space, high = (counts @ _MASKS) / max(1, n)
    words = text.split()
    k = len(words)
    sizes = np.fromiter(map(len, words), np.int64, k)
    bare = sum(1 for w in set(words) if not any(c > 127 or chr(c).isalnum() for c in w[:4])) if symbols else 0
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = counts[counts > 0] / max(1, n)
    root = np.sqrt
    return [float(v) for v in (
        np.log1p(k), np.log1p(sizes.mean()) if k else 0.0, np.log1p(sizes.std()) if k else 0.0, root(upper), root(digits), root(symbols),
        root(stops), root(shouts), np.log1p(len(lines)), root(high), np.log1p(k) - np.log1p(len(set(words))),
        root(1 - len(set(lines)) / len(lines)) if lines else 0.0, root(space), np.log1p(bare), root(1 - pairs / (k - 1)) if k > 1 else 0.0,
        -float((share * np.log2(share)).sum()))]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` (the statistics) of every text."""
    def run(batches):
        for b in batches:
            rows = [(d, statistics(t)) for d, t in doc_rows([b])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))],
                                             names=["doc_id", "x"])

    return importable(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, x array<double>")


def class_moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and second moments per label: one partial row a batch, added up in Spark."""
    m = len(FEATURES)

    def run(batches):
        for b in batches:
            y = b.column(0).to_numpy()
            x = np.array(b.column(1).to_pylist(), float).reshape(-1, m)
            for label in (0, 1):
                own = x[y == label]
                values = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), label, np.int32)), pa.array(np.arange(len(values), dtype=np.int32)),
                                                  pa.array(values)], names=["y", "k", "v"])

    sums = rows.select("y", "x").mapInArrow(run, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).collect()
    out = {}
    for label in (0, 1):
        v = np.zeros(1 + m + m * m)
        for r in sums:
            if r.y == label:
                v[r.k] = r.v
        out[label] = v[0], v[1:1 + m], v[1 + m:].reshape(m, m)
    return out


class Discriminant:
    """Class means and cached Cholesky factors on standardised statistics."""

    def __init__(self, moments, shrink: float = SHRINK, ridge: float = RIDGE):
        n = sum(moments[k][0] for k in (0, 1))
        self.usable = all(moments[k][0] >= 2 for k in (0, 1))
        if not self.usable:
            return
        mean = (moments[0][1] + moments[1][1]) / n
        self.centre = mean
        self.scale = np.sqrt(np.maximum(np.diag(moments[0][2] + moments[1][2]) / n - mean ** 2, 1e-6))
        self.parts, covariances = [], []
        for k in (0, 1):
            c, s, q = moments[k]
            mu = s / c
            covariances.append((q / c - np.outer(mu, mu)) / np.outer(self.scale, self.scale))
        pooled = np.diag(sum(moments[k][0] * np.diag(covariances[k]) for k in (0, 1)) / n)
        for k in (0, 1):
            c, s, _ = moments[k]
            factor = np.linalg.cholesky((1 - shrink) * covariances[k] + shrink * pooled + ridge * np.eye(len(mean)))
            # the inverse of the factor is cached too: a distance is then one product
            self.parts.append(((s / c - mean) / self.scale, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(c / n)))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of label 1 minus that of label 0, with their shares."""
        if not self.usable:
            return np.zeros(len(x))
        z = (x - self.centre) / self.scale
        log = [share - 0.5 * (((z - mu) @ inverse.T) ** 2).sum(axis=1) - 0.5 * det for mu, inverse, det, share in self.parts]
        return log[1] - log[0]


def score_quality(docs: DataFrame, labels: DataFrame, mod: int = MOD, held: int = HELD, cut: float = CUT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    m = len(FEATURES)
    stats = checkpointed(document_statistics(docs))
    rows = stats.join(training_labels(labels, "quality", mod, held), "doc_id")
    model = Discriminant(class_moments(rows))

    def differences(batches):
        for b in batches:
            d = model.difference(np.array(b.column(1).to_pylist(), float).reshape(-1, m))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(np.clip(d, -SPAN, SPAN) / BIN).astype(np.int32))], names=["y", "bin"])

    bins = rows.select("y", "x").mapInArrow(differences, "y int, bin int").groupBy("y", "bin").count().collect()  # <= 4 * SPAN / BIN rows
    y, at, n = (np.array([r[i] for r in bins], float) for i in range(3))
    curve = fit_logistic(at[:, None] * BIN if len(at) else np.zeros((0, 1)), y, n)

    def run(batches):
        for b in batches:
            d = np.clip(model.difference(np.array(b.column(1).to_pylist(), float).reshape(-1, m)), -SPAN, SPAN)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(curve[0] * d + curve[1]))], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id bigint, score double").select(
        "doc_id", (crc_mod("doc_id", mod) == held).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
