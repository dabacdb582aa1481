"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled ``quality = 1``; the unlabelled set is drawn from the
documents without a label, so a label of 0 is never used. A small network over the text statistics
minimises the non-negative unbiased risk

    prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)])

with the logistic loss; where the second part falls below zero its gradient is reversed. The class
prior is estimated first (best-bin estimation): a positive-against-unlabelled network is trained on one half of
the sample; the prior is the least ratio, over the scores of the other half's positives as thresholds,
of the unlabelled to the positive share above the threshold, with a confidence term. The unlabelled share is
counted over all unlabelled documents but those trained on, in one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.textstats import NAMES, statistics, text_stats
from paperloom.session import written

HIDDEN = 16
STEPS = 400
#: Rows that a network is fitted on at most, trusted positives and unlabelled ones each. The prior counts all.
SAMPLE_ROWS = 8000


def features(stats: np.ndarray) -> np.ndarray:
    """The statistics with the number of words and the word length on a logarithmic scale."""
    out = stats.copy()
    out[:, :2] = np.log1p(out[:, :2])
    return out


@dataclass
class Model:
    """A trained network; ``prior`` is the estimated share of positives."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """g of each row: above 0 is positive. A row without words gets minus infinity."""
        x = np.clip((features(stats) - self.mean) / self.scale, -6, 6)
        g = np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2
        return np.where(stats[:, 0] > 0, g, -np.inf)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def risk(theta: list[np.ndarray], x: np.ndarray, is_pos: np.ndarray, prior: float | None) -> tuple[float, list[np.ndarray], bool]:
    """(loss, its gradient, whether the second part is below zero) of the rows ``x``.

    Where it is, the gradient is that of the second part alone, reversed. Without a prior the loss is that of
    positives against the rest.
    """
    n_pos, n_unl = int(is_pos.sum()), int((~is_pos).sum())
    h = np.tanh(x @ theta[0] + theta[1])
    g = h @ theta[2] + theta[3]
    p, above, below = _sigmoid(g), np.logaddexp(0, -g), np.logaddexp(0, g)
    reversed_ = False
    if prior is None:
        loss = above[is_pos].mean() + below[~is_pos].mean()
        dg = np.where(is_pos, (p - 1) / n_pos, p / n_unl)
    else:
        rest = below[~is_pos].mean() - prior * below[is_pos].mean()
        loss, reversed_ = prior * above[is_pos].mean() + max(0.0, rest), rest < 0
        sign = -1.0 if reversed_ else 1.0
        dg = np.where(is_pos, sign * -prior * p / n_pos, sign * p / n_unl)
        if not reversed_:
            dg = dg + np.where(is_pos, prior * (p - 1) / n_pos, 0)
    dh = dg[:, None] * theta[2] * (1 - h * h)
    return float(loss), [x.T @ dh, dh.sum(0), h.T @ dg, np.array([dg.sum()])], reversed_


def _train(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int) -> Model:
    """The network of least non-negative risk, or, without a prior, of positives against the rest."""
    rng = np.random.default_rng(seed)
    both = features(np.concatenate([pos, unl]))
    mean, scale = both.mean(0), both.std(0) + 1e-6
    x = np.clip((both - mean) / scale, -6, 6)
    is_pos = np.arange(len(x)) < len(pos)
    theta = [rng.normal(0, 0.5, (len(NAMES), HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, STEPS + 1):
        grad = risk(theta, x, is_pos, prior)[1]
        for k, d in enumerate(grad):
            d = d + 1e-5 * theta[k] * (k % 2 == 0)
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            theta[k] = theta[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, theta[0], theta[1], theta[2], float(theta[3][0]), prior or 0.0)


def best_bin(p: np.ndarray, above_u: np.ndarray, n_unl: int) -> float:
    """The prior from the sorted scores of held-out positives and the share of ``n_unl`` unlabelled rows at or above each."""
    above_p = 1 - np.searchsorted(p, p, side="left") / len(p)
    slack = np.sqrt(np.log(40) / (2 * len(p))) + np.sqrt(np.log(40) / (2 * n_unl))
    best = int(np.argmin((above_u + 1.01 * slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.99))


def _bins(model: Model, cuts: np.ndarray):
    """How many of the cuts each row's score reaches."""

    def run(*columns: pa.Array) -> pa.Array:
        stats = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], 1)
        return pa.array(np.searchsorted(cuts, model.scores(stats), side="right").astype(np.int64))

    return run


def estimate_prior(pos: np.ndarray, unl: np.ndarray, everyone: DataFrame, seed: int = 3) -> float:
    """The share of positives among the rows of ``everyone``, all unlabelled ones; a half where nothing can be told."""
    model = _train(pos[::2], unl[::2], None, seed)
    p = np.sort(model.scores(pos[1::2]))
    if not len(p):
        return 0.5
    counts = np.zeros(len(p) + 1)
    for r in everyone.groupBy(F.arrow_udf(_bins(model, p), "bigint")(*NAMES).alias("bin")).count().collect():  # a row for each held-out positive at most
        counts[r["bin"]] += r["count"]
    seen = np.bincount(np.searchsorted(p, model.scores(unl[::2]), side="right"), minlength=len(counts))
    counts = np.maximum(0, counts - seen)  # without the rows the network was trained on
    if not counts.sum():
        return 0.5
    reached = counts.sum() - np.cumsum(counts)[:-1]  # rows at or above the k-th cut have more than k cuts below
    at_least = reached[np.searchsorted(p, p, side="left")]
    return best_bin(p, at_least / counts.sum(), int(counts.sum()))


def statistics_table(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, quality, statistics) of every row with words, written once; quality is null where there is no label.

    A document with several labels is positive if all are; labels without a quality count as none.
    """
    label = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality"))
    stats = docs.select(F.col(id_col).alias("id"), text_stats(F.col(text_col)).alias("s")).select("id", "s.*")
    # filtered after it is written: a filter on what Python gave would be pushed below and have it made twice
    return written(stats.join(label, stats["id"] == label["label_id"], "left").drop("label_id"), "quality-stats").where("words > 0")


def training_rows(stats: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of at most ``rows`` trusted positives and as many unlabelled documents.

    Those of least id hash are taken, so the choice depends on the ids alone; of rows that share an id one
    counts, and rows without an id are not drawn.
    """
    least = stats.where("id is not null and (quality is null or quality = 1)").groupBy("id", "quality").agg(F.min(F.struct(*NAMES)).alias("s"))

    def pick(cond: str) -> np.ndarray:
        chosen = least.where(cond).orderBy(F.xxhash64("id"), "id").limit(rows)
        found = written(chosen.select("id", "s.*"), "quality-sample").toPandas()  # written first: a collected sorted limit sends rows of every partition
        return found.sort_values("id")[list(NAMES)].to_numpy()

    return pick("quality = 1"), pick("quality is null")


def fit(pos: np.ndarray, unl: np.ndarray, everyone: DataFrame, seed: int = 7) -> Model | None:
    """A model from the statistics of positives and unlabelled texts; None if either has under two."""
    if len(pos) < 2 or len(unl) < 2:
        return None
    order = np.random.default_rng(seed)
    pos, unl = order.permutation(pos), order.permutation(unl)
    return _train(pos, unl, estimate_prior(pos, unl, everyone), seed)


def train_on(stats: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from :func:`statistics_table`, fitted on a bounded sample, its prior counted over all rows."""
    return fit(*training_rows(stats, rows), stats.where("quality is null"))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model for these documents; see :func:`train_on`."""
    return train_on(statistics_table(docs, labels, id_col, text_col), rows)


def score(model: Model, text: Column) -> Column:
    """g of each text, whole; above 0 is good quality."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array(model.scores(statistics(column)))

    return F.arrow_udf(run, "double").asNondeterministic()(text)  # so that a filter on it isn't pushed below and scored twice


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` that the classifier takes for good quality; all columns and repeated rows stay.

    Texts that are null or hold no word are rejected, very long ones are read whole; a score of exactly 0 is
    rejected. Where there are too few labels or documents to learn from, every row stays. Rows with a null id are judged
    like any other. No rows give no rows.
    """
    model = train(docs, labels, rows, id_col, text_col)
    return docs if model is None else docs.where(score(model, F.col(text_col)) > 0)


def scored(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each kept row, see :func:`keep_good`; the score is null where nothing could be learnt."""
    model = train(docs, labels, rows, id_col, text_col)
    if model is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(None).cast("double").alias("score"))
    return docs.select(F.col(id_col).alias("doc_id"), score(model, F.col(text_col)).alias("score")).where("score > 0")
