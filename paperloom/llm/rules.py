"""Quality rules: a decision list learnt by sequential covering.

Rules for the class of bad documents (``quality = 0``) are conjunctions of thresholds on text
statistics. Each rule is grown on two thirds of the examples that no earlier rule covers, condition
by condition, by FOIL's information gain; then conditions are cut from its end while that doesn't
worsen (bad - good) / (bad + good) on the other third. Learning stops at the first rule whose precision
on all examples left is under ``MIN_PRECISION`` or that covers fewer than ``MIN_COVER`` bad ones; a rule grows as
long as a condition gains. Nothing else bounds the list. Of conditions with equal gain the first statistic, the lower
side last, and the lowest cut win. The list becomes one ordered
Spark conditional, ``CASE WHEN rule 1 THEN 1 WHEN rule 2 THEN 2 ... ELSE 0``, that Spark evaluates
without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.textstats import NAMES, text_stats
from paperloom.session import written

#: Labelled rows to learn from at most.
SAMPLE_ROWS = 20000
MIN_COVER = 3
MIN_PRECISION = 0.9
_CUTS = 64


@dataclass(frozen=True)
class Condition:
    """``name >= cut`` or ``name <= cut``."""

    name: str
    above: bool
    cut: float

    def mask(self, x: np.ndarray) -> np.ndarray:
        value = x[:, NAMES.index(self.name)]
        return value >= self.cut if self.above else value <= self.cut

    def column(self) -> Column:
        return F.col(self.name) >= self.cut if self.above else F.col(self.name) <= self.cut


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    """The rows for which all conditions hold."""
    out = np.ones(len(x), bool)
    for condition in rule:
        out &= condition.mask(x)
    return out


def _best(x: np.ndarray, bad: np.ndarray) -> tuple[float, Condition | None]:
    p0, n0 = int(bad.sum()), int((~bad).sum())
    if not p0 or not n0:
        return 0.0, None
    before, best = np.log2(p0 / (p0 + n0)), (0.0, None)
    for k, name in enumerate(NAMES):
        value = x[:, k]
        distinct = np.unique(value)
        if len(distinct) < 2:
            continue
        middle = (distinct[1:] + distinct[:-1]) / 2
        if len(middle) > _CUTS:
            middle = np.unique(np.concatenate([np.quantile(middle, np.linspace(0, 1, _CUTS)), np.quantile(np.unique(value[bad]), np.linspace(0, 1, _CUTS))]))
        order = np.argsort(value, kind="stable")
        ranked, hits = value[order], np.append(0, np.cumsum(bad[order]))
        for above in (True, False):
            at = np.searchsorted(ranked, middle, side="left" if above else "right")
            p = (p0 - hits[at]) if above else hits[at]
            n = (len(value) - at if above else at) - p
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / np.maximum(1, p + n)) - before), 0)
            j = int(np.argmax(gain))
            if gain[j] > best[0] + 1e-12:
                best = (float(gain[j]), Condition(name, above, float(middle[j])))
    return best


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    hit = covers(rule, x)
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 1) -> list[Rule]:
    """The ordered rules for bad rows; no rules where one of the classes is missing."""
    rules: list[Rule] = []
    part = np.random.default_rng(seed).random(len(x)) < 2 / 3
    left = np.ones(len(x), bool)
    while (left & bad).any() and (left & ~bad).any():
        grow, prune = left & part, left & ~part
        rule: Rule = ()
        while True:
            here = grow & covers(rule, x)
            condition = _best(x[here], bad[here])[1]
            if condition is None:
                break
            rule = (*rule, condition)
        while len(rule) > 1 and _worth(rule[:-1], x[prune], bad[prune]) >= _worth(rule, x[prune], bad[prune]):
            rule = rule[:-1]
        hit = left & covers(rule, x)
        if not rule or (hit & bad).sum() < MIN_COVER or (hit & bad).sum() < MIN_PRECISION * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def decision(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    chain = None
    for k, rule in enumerate(rules, 1):
        holds = rule[0].column()
        for condition in rule[1:]:
            holds = holds & condition.column()
        chain = F.when(holds, F.lit(k)) if chain is None else chain.when(holds, F.lit(k))
    return F.lit(0) if chain is None else chain.otherwise(F.lit(0))


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, statistics) of every row, written once: the texts are read a single time."""
    return written(docs.select(F.col(id_col).alias("doc_id"), text_stats(F.col(text_col)).alias("s")).select("doc_id", "s.*"), "rules-stats")


def train(stats: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from at most ``rows`` labelled documents, those of least id hash."""
    label = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = stats.where("words > 0").join(label, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *NAMES).limit(rows)
    # written first: collecting a sorted limit would send that many rows of every partition to the driver
    chosen = written(chosen, "rules-sample").toPandas().sort_values(["doc_id", *NAMES])
    return learn(chosen[list(NAMES)].to_numpy(), chosen["quality"].to_numpy() == 0)


def judged(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rule) of every row: the rule that rejects it, from 1, or 0 where it is kept.

    A text that is null or holds no word is rejected by rule -1, before all others. Repeated rows are
    judged alike. Without labels of both classes there are no other rules. Labels that disagree
    count as bad. Very long texts are read whole; other columns, whatever their names, are not looked at; no rows
    give no rows.
    """
    stats = statistics_table(docs, id_col, text_col)
    rules = train(stats, labels, rows)
    return stats.select("doc_id", F.when(F.col("words") == 0, F.lit(-1)).otherwise(decision(rules)).alias("rule"))
