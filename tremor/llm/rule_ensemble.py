"""Quality scores from a sparse rule ensemble.

Statistics of each text are the features. A random forest on a bounded sample of labelled rows yields candidate
rules: every path from a root is a conjunction of comparisons. Lasso logistic regression weighs the rules, most of
them to zero, and the rest are compiled into one Spark column expression, so that scoring is a projection over the
statistics that Spark generates code for.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import unused
from tremor.plans.loops import CutTable

#: Labelled rows a model is fitted on, at most (a hash of the key picks them), and the share that counts as label 1.
SAMPLE, CUT = 20_000, 0.3
#: None grows with the length of the text: words count up to 100, distinct words within blocks of 200.
STATS = ("n_words", "word_length", "letters", "capitals", "digits", "symbols", "stops", "white", "wide", "distinct_words", "top_word",
         "symbol_words", "distinct_lines", "line_words")


def text_stats(text: str | None) -> list[float]:
    """The statistics of one text, 0 where a ratio has nothing to divide by; null counts as empty."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    byte = np.bincount(raw, minlength=256)
    chars = max(len(raw), 1)
    words = text.split()
    n = max(len(words), 1)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    upper, lower = int(byte[65:91].sum()), int(byte[97:123].sum())
    stops = int(byte[[33, 44, 46, 58, 59, 63]].sum())
    white = int(byte[[9, 10, 11, 12, 13, 32]].sum())
    digits, wide = int(byte[48:58].sum()), int(byte[128:].sum())
    symbols = len(raw) - upper - lower - stops - white - digits - wide
    return [float(min(len(words), 100)), (len(raw) - white) / n, (upper + lower) / chars, upper / max(upper + lower, 1), digits / chars, symbols / chars,
            stops / n, white / chars, wide / chars, sum(len(set(words[k:k + 200])) for k in range(0, len(words), 200)) / n, max(seen.values(), default=0) / n,
            sum(c for w, c in seen.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?") / n,
            len(set(lines)) / max(len(lines), 1), len(words) / max(len(lines), 1)]


def with_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """The ``keep`` columns and one column for each statistic, named ``s_<statistic>``."""
    slim = docs.select(*keep, F.col("text").cast("string").alias(unused(docs, "_text")))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([text_stats(t) for t in b.column(b.num_columns - 1).to_pylist()], np.float64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(rows[:, k]) for k in range(len(STATS)))],
                                             names=[*b.schema.names[:-1], *(f"s_{s}" for s in STATS)])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"s_{s} double" for s in STATS]
    return slim.mapInArrow(work, ", ".join(schema))


@dataclass(frozen=True)
class Rule:
    """All of its comparisons hold: (statistic, whether above, threshold)."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        held = F.lit(True)
        for stat, above, at in self.tests:
            held = held & (F.col(f"s_{stat}") > at if above else F.col(f"s_{stat}") <= at)
        return held


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    weighted: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of label 1 over the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.weighted:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _paths(forest) -> list[Rule]:
    """Every path of every tree, from the root to each inner node and leaf, once."""
    rules: dict[Rule, None] = {}

    def walk(node, tests: tuple) -> None:
        if tests:
            merged: dict[tuple[str, bool], float] = {}
            for stat, above, at in tests:  # of comparisons of one kind only the strictest counts
                old = merged.get((stat, above), at)
                merged[stat, above] = max(old, at) if above else min(old, at)
            rules[Rule(tuple(sorted((s, a, t) for (s, a), t in merged.items())))] = None
        if node.subtreeDepth() > 0:
            split = node.split()
            stat, at = STATS[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), (*tests, (stat, False, at)))
            walk(node.rightChild(), (*tests, (stat, True, at)))

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), ())
    return list(rules)


def train(stats: DataFrame, labels: DataFrame, learn: Column, *, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE,
          trees: int = 12, depth: int = 3, lasso: float = 1e-3, seed: int = 11) -> Ensemble:
    """Fit on at most about ``sample`` labelled rows for which ``learn`` (over ``labels``) holds.

    Null labels and keys are left out. Without rows, or with one label only, the score is that label's share, kept
    within 0.01 and 0.99 (0.5 without rows).
    """
    known = labels.where(learn & F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_label"))
    total = known.count()
    share = min(1.0, sample / max(total, 1))
    known = known.where(F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(1 << 40)) < F.lit(share * float(1 << 40)))
    rows = CutTable(stats.join(known, F.col(key) == F.col("_key")).select("_label", *[f"s_{s}" for s in STATS])).df
    n, ones = rows.agg(F.count(F.lit(1)), F.sum("_label")).first()
    if not n or ones in (0, n):
        p = min(max(ones / n, 0.01), 0.99) if n else 0.5
        return Ensemble(float(np.log(p / (1 - p))), ())
    made = VectorAssembler(inputCols=[f"s_{s}" for s in STATS], outputCol="_features").transform(rows)
    forest = RandomForestClassifier(labelCol="_label", featuresCol="_features", numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(made)
    rules = _paths(forest)
    if not rules:  # no statistic tells the labels apart
        return Ensemble(float(np.log(ones / (n - ones))), ())
    held = rows.select("_label", *[r.column().cast("double").alias(f"r{k}") for k, r in enumerate(rules)])
    ready = CutTable(VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="_rules").transform(held).select("_label", "_rules")).df
    fitted = LogisticRegression(labelCol="_label", featuresCol="_rules", elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(ready)
    weights = fitted.coefficients.toArray()
    return Ensemble(float(fitted.intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6))


def score(docs: DataFrame, labels: DataFrame, learn: Column, *keep: str, cut: float = CUT, **options) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``cut`` on).

    ``keep`` holds ``doc_id``. Only the text is read to score a row; labels reach the model through the sample alone.
    """
    stats = CutTable(with_stats(docs, *keep)).df
    model = train(stats, labels, learn, **options)
    return stats.select(*keep, model.score().alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))
