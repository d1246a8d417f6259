"""Quality classifier: regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

#: Labelled rows that the model is fitted on, at most; see ``bounded_sample``.
FIT_ROWS = 20_000
#: Share of the pooled covariance, and of a multiple of the unit matrix, in each class covariance.
POOL, RIDGE = 0.1, 0.02
#: Log-density differences are divided by this before the logistic function.
TEMPERATURE = 4.0
THRESHOLD = 0.3
FEATURES = (
    "log_words", "word_length", "upper_words", "symbols", "bars", "exclamations", "digits", "stops", "adjacent_equal", "distinct_words", "repeated_lines", "compressed",
)


def statistics(text: str | None, packer: zstandard.ZstdCompressor) -> list[float]:
    """Transformed statistics of a whole text; shares are smoothed and logged, so that few words decide little."""
    text = text or ""
    words = text.split()
    n = len(words)
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode()

    def share(count: float, of: float, prior: float = 1.0) -> float:
        return float(np.log((count + prior) / (of + 50 * prior)))

    return [
        float(np.log1p(n)),
        float(np.log((chars + 50) / (n + 10))),
        share(sum(map(str.isupper, words)), n),
        share(sum(map(text.count, "#*$%&<>")), n),
        share(text.count("|"), n),
        share(text.count("!"), n),
        share(sum(map(text.count, "0123456789")), n),
        share(sum(map(text.count, ".,;:?")), n),
        share(sum(map(eq, words, words[1:])), n),
        float(np.log1p(len(set(words))) - 0.8 * np.log1p(n)),
        share(len(lines) - len(set(lines)), len(lines)),
        float(np.log((len(packer.compress(raw)) + 50) / (len(raw) + 100))),
    ]


@dataclass
class QuadraticDiscriminant:
    """Gaussian of each class; the Cholesky factors of the covariances are kept."""

    means: np.ndarray
    factors: np.ndarray
    log_priors: np.ndarray
    log_dets: np.ndarray = field(init=False)
    inverses: np.ndarray = field(init=False)

    def __post_init__(self):
        self.log_dets = 2 * np.log(np.diagonal(self.factors, axis1=1, axis2=2)).sum(1)
        self.inverses = np.stack([np.linalg.solve(f, np.eye(len(f))) for f in self.factors])

    @classmethod
    def fit(cls, n: np.ndarray, sums: np.ndarray, squares: np.ndarray, pool: float = POOL, ridge: float = RIDGE) -> QuadraticDiscriminant:
        """From counts, sums and sums of outer products of each class."""
        n = np.maximum(n, 1e-9)
        means = sums / n[:, None]
        own = squares / n[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = (own * n[:, None, None]).sum(0) / n.sum()
        scale = np.maximum(np.diagonal(pooled), 1e-6)
        cov = (1 - pool) * own + pool * pooled
        cov = (1 - ridge) * cov + ridge * np.diag(scale)
        return cls(means, np.linalg.cholesky(cov), np.log(np.maximum(n, 1) / np.maximum(n, 1).sum()))

    def score(self, x: np.ndarray, temperature: float = TEMPERATURE) -> np.ndarray:
        """Probability of class 1 from the difference of Mahalanobis log densities."""
        logs = []
        for mean, inverse, det, prior in zip(self.means, self.inverses, self.log_dets, self.log_priors):
            z = (x - mean) @ inverse.T
            logs.append(prior - 0.5 * ((z * z).sum(1) + det))
        return 1 / (1 + np.exp(np.clip((logs[0] - logs[1]) / temperature, -500, 500)))


def _features(texts: pa.Array) -> np.ndarray:
    packer = zstandard.ZstdCompressor(level=1)
    return np.array([statistics(t.as_py(), packer) for t in texts]).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> QuadraticDiscriminant:
    """Model from the texts of ``docs`` whose id has a label 0 or 1 in ``labels``.

    At most ``fit_rows`` labelled ids are broadcast, so no text is shuffled; tasks sum counts, means and
    products of their documents, and Spark adds these up. Null labels and ids are left out. If a class
    has no rows its Gaussian is that of the pooled covariance around zero.
    """
    chosen = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    chosen = chosen.select(F.col(id_col).alias("__label_id"), F.col(label_col).cast("int").alias("__label"))
    chosen = bounded_sample(chosen, "__label_id", fit_rows)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("__id") == F.col("__label_id")).select("__label", "text")
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = _features(batch.column(1)), batch.column(0).to_numpy()
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.r_[len(own), own.sum(0), (own.T @ own).ravel()]
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "value"])

    total = np.zeros(2 * (1 + d + d * d))
    for r in rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        total[r["at"]] = r["value"]
    total = total.reshape(2, -1)
    return QuadraticDiscriminant.fit(total[:, 0], total[:, 1 : d + 1], total[:, d + 1 :].reshape(2, d, d))


def score(docs: DataFrame, model: QuadraticDiscriminant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row: the probability of label 1.

    Null counts as empty; an empty text has statistics too and gets a score. Rows are scored one by
    one, repeated rows alike; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_features(batch.column(1))))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def keep_good(docs: DataFrame, model: QuadraticDiscriminant, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array(model.score(_features(texts)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
