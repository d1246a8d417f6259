"""Toxicity by non-negative positive-unlabelled learning of a sparse linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, discard, materialise

#: Documents that the model is fitted on, at most: confirmed toxic ones, and ones taken as unlabelled.
FIT_POSITIVE, FIT_UNLABELLED = 4_000, 8_000
#: Words and word beginnings with a weight.
MAX_FEATURES = 512
#: A feature needs a difference of so many standard errors between both samples.
MIN_Z = 6.0
#: The class prior is read off this many features that tell most.
PRIOR_FEATURES = 20
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
_WORDS = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Distinct words of a whole text, in lower case, and their beginnings (marked by a star)."""
    words = set(_WORDS.findall((text or "").lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in PREFIXES))


@dataclass
class LinearModel:
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at = [self.vocabulary[f] for f in self.vocabulary.keys() & features(text)]
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at].sum(), -500, 500))))


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk under the logistic loss, by Adam.

    The risk is ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``. While the second term is below
    zero the step goes up along it instead, so that the model cannot fit by pushing it further down.
    """
    w = np.zeros(positive.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    p = np.c_[positive, np.ones(len(positive), np.float32)]
    u = np.c_[unlabelled, np.ones(len(unlabelled), np.float32)]
    for step in range(1, epochs + 1):
        gp, gu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-np.clip(gp, -50, 50))), 1 / (1 + np.exp(-np.clip(gu, -50, 50)))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        slope = (su @ u) / len(u) - prior * (sp @ p) / len(p)
        grad = prior * ((sp - 1) @ p) / len(p) + slope if negative >= 0 else -slope
        grad = grad + decay * w
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_positive: int = FIT_POSITIVE,
    fit_unlabelled: int = FIT_UNLABELLED,
    max_features: int = MAX_FEATURES,
) -> LinearModel:
    """Model from rows of ``labels`` with label 1 and from unlabelled texts of ``docs``.

    Bounded samples of ids are broadcast; of rows that repeat an id the smallest text counts, so at most as many rows
    as ids are used. Features are the
    ``max_features`` words and beginnings whose document frequencies differ most between both samples.
    The class prior of the unlabelled text is its frequency of the foremost features over that in
    confirmed examples; clean text hardly has them, so the ratio is the share of toxic documents.
    Without any confirmed example every text gets the same low score.
    """
    known = labels.filter((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"))
    sure = bounded_sample(known.select("__id", F.lit(1).alias("toxic")), "__id", fit_positive)
    rest = docs.select(F.col(id_col).alias("__id"), F.lit(0).alias("toxic")).filter("__id is not null")
    rest = bounded_sample(rest, "__id", fit_unlabelled)
    chosen = sure.union(rest)
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).groupBy("__id", "toxic").agg(F.min("text").alias("text"))
    rows = materialise(rows.select("toxic", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[toxic].update(features(text))
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in (seen[1], seen[0]))], ["feature", "n_pos", "n_unl"]
            )

    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_unl = n.get(1, 0), n.get(0, 0)
    if not n_pos or not n_unl:
        return LinearModel({}, np.zeros(0), -3.0)
    counts = rows.mapInArrow(count, "feature string, n_pos long, n_unl long").groupBy("feature").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_unl").alias("n_unl"))
    rate = (F.col("n_pos") + F.col("n_unl") + 1) / (n_pos + n_unl + 2)
    z = (F.col("n_pos") / n_pos - F.col("n_unl") / n_unl) / F.sqrt(rate * (1 - rate) * (1 / n_pos + 1 / n_unl))
    best = counts.withColumn("z", z).filter(F.abs("z") >= MIN_Z).orderBy(F.desc(F.abs("z")), "feature").limit(max_features).collect()
    telling = [r for r in best if r["z"] > 0][:PRIOR_FEATURES]
    if not telling:
        return LinearModel({}, np.zeros(0), -3.0)
    prior = min(0.5, (1 + sum(r["n_unl"] for r in telling)) / n_unl / (sum(r["n_pos"] for r in telling) / n_pos))
    vocabulary = {r["feature"]: i for i, r in enumerate(best)}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [[vocabulary[f] for f in vocabulary.keys() & features(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32()))], ["toxic", "at"])

    found = rows.mapInArrow(index, "toxic int, at array<int>").toArrow()
    discard(rows)
    toxic = found.column("toxic").to_numpy()
    x = np.zeros((len(toxic), len(vocabulary)), np.float32)
    for i, at in enumerate(found.column("at").to_pylist()):
        x[i, at] = 1
    weights, bias = nn_pu(x[toxic == 1], x[toxic == 0], prior)
    return LinearModel(vocabulary, weights, bias)


def score(docs: DataFrame, model: LinearModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row: how likely the whole text is toxic, 0 to 1.

    Null counts as empty; an empty text has no features and gets the model's bias as score. Repeated
    rows are scored alike, an empty table gives an empty result, other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
