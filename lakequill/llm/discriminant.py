"""Quality classifier (operator 8): a regularised quadratic discriminant.

Each document is a short vector of transformed statistics of its whole text. Class means
and covariances come from sums over all labelled rows of the training part; covariances
are shrunk towards the pooled diagonal. A score is the posterior of label 1 from the
difference of the two log densities, with Mahalanobis terms by cached Cholesky factors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.llm.quality import CLASSES, SLOT, base_counts, class_table
from lakequill.llm.shared import written

FEATURES = ("length", "word_length", "upper", "digit", "stop", "mark", "symbol", "control", "beyond", "repeats", "twins", "variety", "same_lines", "line_length", "common")
#: Weight of the pooled diagonal in a class covariance, and the least variance.
SHRINKAGE, LEAST_VARIANCE = 0.1, 1e-4
KEEP_FROM = 0.7


def features(text: str | None, table: np.ndarray) -> list[float]:
    """Statistics of one text; shares are taken to their square roots, lengths to logarithms."""
    text = text or ""
    words, word_chars, _, same_lines, repeats = base_counts(text)
    n = len(words)
    kinds = np.bincount(table[np.frombuffer(text.encode(), np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]
    shares = np.sqrt(kinds[1:] / max(1, kinds.sum())).tolist()
    twins = sum(map(str.__eq__, words, words[1:]))
    lines = text.count("\n") + 1
    known = sum(map(SLOT.__contains__, words))
    many = max(1, n)
    variety = math.log(len(set(words)) + 1) / math.log(n + 1) if n else 0.0
    return [math.log1p(n), math.log1p(word_chars / many), *shares, math.sqrt(repeats / many), math.sqrt(twins / many), variety, math.sqrt(same_lines / lines), math.log1p(n / lines), math.sqrt(known / many)]


@dataclass
class Model:
    """Log priors, means and Cholesky factors of the inverse problem, by class; or a constant."""

    constant: float | None = None
    priors: tuple[float, float] = (0.5, 0.5)
    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = []
        for prior, mean, factor in zip(self.priors, self.means, self.factors):
            z = np.linalg.solve(factor, (x - mean).T)
            logs.append(math.log(prior) - 0.5 * (z * z).sum(0) - np.log(np.diag(factor)).sum())
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _vectors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = class_table()
        for batch in batches:
            rows = [features(t, table) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x array<double>")


def _x(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


#: Features enter the sums as whole numbers of this part, within so many units, by at most so many rows at once: 64 bits hold the products.
PART, MOST, ROWS = 1 << 16, 1000, 1024


def fit(labelled: DataFrame) -> Model:
    """The model of rows (x, label 0/1): only sums by class reach the driver. They are sums of whole numbers, so the order of rows does not matter."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: [0, np.zeros(d, object), np.zeros((d, d), object)] for k in (0, 1)}
        for batch in batches:
            x, y = np.rint(np.clip(_x(batch.column(0)), -MOST, MOST) * PART).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False)
            for k, s in sums.items():
                rows = x[y == k]
                s[0] += len(rows)
                for start in range(0, len(rows), ROWS):
                    some = rows[start : start + ROWS]
                    s[1] += some.sum(0).astype(object)
                    s[2] += (some.T @ some).astype(object)
        out = [(k, j, Decimal(int(v))) for k, s in sums.items() for j, v in enumerate([s[0], *s[1], *s[2].ravel()])]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.decimal128(38, 0)))], ["label", "slot", "total"])

    totals = np.zeros((2, 1 + d + d * d))
    units = np.array([1.0] + [PART] * d + [PART * PART] * (d * d))
    for r in labelled.select("x", "label").mapInArrow(run, "label int, slot int, total decimal(38,0)").groupBy("label", "slot").agg(F.sum("total").alias("total")).collect():
        totals[r.label, r.slot] = float(r.total) / units[r.slot]
    counts = totals[:, 0]
    if counts.min() < d + 2:  # too few of a class for a covariance: the share of label 1
        return Model(constant=float((counts[1] + 1) / (counts.sum() + 2)))
    means = [t[1 : 1 + d] / t[0] for t in totals]
    covariances = [t[1 + d :].reshape(d, d) / t[0] - np.outer(m, m) for t, m in zip(totals, means)]
    pooled = np.diag(np.maximum(np.diag(sum(c * s for c, s in zip(counts, covariances)) / counts.sum()), LEAST_VARIANCE))
    shrunk = [(1 - SHRINKAGE) * c + SHRINKAGE * pooled + LEAST_VARIANCE * np.eye(d) for c in covariances]
    shares = counts / counts.sum()
    return Model(priors=(float(shares[0]), float(shares[1])), means=tuple(means), factors=tuple(np.linalg.cholesky(c) for c in shrunk))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Rows of ``labels`` whose label is 0 or 1 and whose id is not held out train the model;
    each matching pair of rows counts. Nothing but the text enters a score: null and empty
    texts are scored as ''. With too few labels of a class every score is the share of
    label 1. Null ids and repeated rows stay; other columns are left out.
    """
    vectors = written(_vectors(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))), "vectors")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)").filter(~held_out(F.col("doc_id")))
    model = fit(vectors.join(known, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_x(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= KEEP_FROM).astype(np.int32))], ["doc_id", "score", "predicted"])

    return vectors.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
