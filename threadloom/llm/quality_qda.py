"""Quality classifier: regularised quadratic discriminant (operator 6).

A document's statistics (length, word length, shares of capitals, digits, symbols,
punctuation, exclamation marks and space, repeated neighbours, distinct words, line
length, repeated lines) are transformed (logarithms, arc-sines of shares), put on a
common scale and squashed by ``CLIP * tanh(z / CLIP)``. Each class has a mean and a
covariance, shrunk towards the pooled diagonal by the amount that the sampling error of its
entries asks for (at least ``SHRINK``); a score is the logistic function of the
difference of the Mahalanobis log densities, by the inverse of the Cholesky factors,
which is made once and travels with the model.

Only the fit is on a sample: at most ``TRAIN_ROWS`` labelled rows, those of least
hash of their id. Labels, lang, source and doc_id never enter a score. Nulls: a
null text scores as the empty one; a null doc_id is never held out; labels other than
0 and 1 and labels without a document are left out of the fit. With one class or none
to learn from, every score is that class's share (1 without labels). Repeated rows
score alike; other columns are not read by the query and are kept by ``scored``,
whose new column gets underscores where its name is taken, and by ``keep``. An empty
table gives no rows. A text is taken whole, in memory linear in its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table, text_rows

TRAIN_ROWS = 50_000
SHRINK, CLIP, FLOOR = 0.1, 3.0, 1e-3
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

_KINDS = np.zeros((256, 7), np.int64)
for _column, _bytes in enumerate((range(65, 91), range(48, 58), b"#*$%&|<>", b".,;:?'\"-()", b"!", [*range(9, 14), 32])):
    _KINDS[list(_bytes), _column] = 1


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text."""
    data = np.frombuffer(text.encode(), np.uint8)
    upper, digit, symbol, mark, bang, space, _ = np.bincount(data, minlength=256) @ _KINDS
    words = text.split()
    n, size = len(words), max(1, len(data))
    lines = [x for x in text.split("\n") if x]
    share = lambda x, y: float(np.arcsin(np.sqrt(min(1.0, x / max(1, y)))))
    again = sum(map(str.__eq__, words, words[1:]))
    return [
        np.log1p(n), np.log1p(len(data) / max(1, n)), share(upper, size), share(digit, size), share(symbol, size), share(mark, size), share(bang, size), share(space, size),
        share(again, n), np.log1p(n / max(1, len(set(words)))), np.log1p(n / max(1, len(lines))), share(len(lines) - len(set(lines)), len(lines)),
    ]


N_STATISTICS = 12


@dataclass(frozen=True)
class Qda:
    """centre, scale: of the statistics. classes: for 0 and 1 mean, inverse Cholesky factor, log determinant, log prior; None if only share is known."""

    centre: np.ndarray
    scale: np.ndarray
    classes: tuple | None
    share: float

    def squash(self, x: np.ndarray) -> np.ndarray:
        return CLIP * np.tanh((x - self.centre) / self.scale / CLIP)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.share)
        z, density = self.squash(x), []
        for mean, inverse, log_det, log_prior in self.classes:
            y = inverse @ (z - mean).T
            density.append(log_prior - 0.5 * ((y * y).sum(0) + log_det))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def shrinkage(z: np.ndarray, least: float = SHRINK) -> float:
    """How far a covariance goes towards its diagonal: the summed variance of its entries over their summed squares, off the diagonal."""
    n, d = z.shape
    c = z - z.mean(0)
    products = c[:, :, None] * c[:, None, :]
    off = ~np.eye(d, dtype=bool)
    spread = products.var(0)[off].sum() * n / max(1, n - 1) ** 2
    size = (np.cov(z.T)[off] ** 2).sum()
    return float(min(1.0, max(least, spread / size if size > 0 else 1.0)))


def fit(x: np.ndarray, y: np.ndarray, least: float = SHRINK) -> Qda:
    share = float(y.mean()) if len(y) else 1.0
    centre, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(N_STATISTICS), np.ones(N_STATISTICS))
    model = Qda(centre, scale, None, share)
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return model
    z, classes = model.squash(x), []
    pooled = np.diag(z.var(0))
    for c in (0, 1):
        own = z[y == c]
        shrink = shrinkage(own, least)
        cov = (1 - shrink) * np.cov(own.T) + shrink * pooled + FLOOR * np.eye(z.shape[1])
        factor = np.linalg.cholesky(cov)
        classes.append((own.mean(0), np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum()), float(np.log(len(own) / len(z)))))
    return Qda(centre, scale, tuple(classes), share)


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, labels, texts in text_rows(batches, ("doc_id", "label", "text")):
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array([statistics(t or "") for t in texts], pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def fold(doc_id: str, folds: int):
    return F.crc32(F.col(doc_id).cast("string")) % folds


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Qda:
    """Fit on at most ``most`` labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (fold("doc_id", FOLDS) != HELD_OUT))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)  # so many rows at most are broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    got = rows.mapInArrow(_statistics_of, "doc_id long, label int, x array<double>").orderBy("doc_id", "label", "x").limit(2 * most).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), N_STATISTICS)
    return fit(x, got["label"].to_numpy(int))


def scored(docs: DataFrame, model: Qda) -> DataFrame:
    """The rows with their score, in a column ``score`` (see ``free_name``)."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t or "") for t in texts], float).reshape(len(texts), N_STATISTICS)
        return pd.Series(model.score(x))

    return docs.withColumn(free_name("score", docs.columns), score("text"))


def keep(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the classifier accepts, with the columns they had."""
    texts = scored(docs.select(F.struct(*docs.columns).alias("row"), "text"), train(docs, labels))
    return texts.filter(F.col("score") >= threshold).select("row.*")


def op6_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op6_quality_qda": op6_quality_qda}
ORACLES: dict[str, str] = {}
