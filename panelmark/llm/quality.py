"""Quality classifier: Bradley-Terry ranking from preference pairs, thresholded at a score quantile.

A document of label 1 is preferred to one of label 0. For sampled pairs the logistic loss on the difference
of their features gives the strengths; strength s(x) = w.f(x) scores any document. The threshold is the quantile of
the strengths of the learning rows at their share of label 0, and the score maps it to REJECT_BELOW, so that
score >= REJECT_BELOW says label 1 is predicted. Features are built-in expressions over whole texts.

A null text counts as empty and gets a score. Null labels are ignored; a label repeated for a document is 1 if
at least half of its values are. A document with a null id is held out. Where the labels lack one of
the two values every score is 0.5. Empty tables give empty results; only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmark.llm.common import SPACE, WORD, in_fold, text_of
from panelmark.llm.minhash import let

#: At most so many labelled documents are learnt from, and so many preference pairs drawn.
SAMPLE_ROWS, PAIRS = 20_000, 200_000
REJECT_BELOW = 0.3
FOLDS = 5
RIDGE = 1e-3


def features(text: Column) -> dict[str, Column]:
    """Doubles, defined for empty texts too. text: without nulls."""
    n = F.length(text)
    lines = F.split(text, "\n")
    n_words = F.regexp_count(text, F.lit(WORD))

    def share(pattern: str, of: Column = n) -> Column:
        return (n - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(of, F.lit(1))

    own = {
        "upper": share("[A-Z]+"),
        "digits": share("[0-9]+"),
        "marks": share("[!?]+"),
        "symbols": share("[^\\w\\s.,;:!?'\"\\-|\\x{80}-\\x{10FFFF}]+"),
        "bars": share("[|]+"),
        "stops": share("[.,;:]+"),
        "beyond_ascii": share("[^\\x00-\\x7F]+"),
        "space": share(f"[{SPACE}]+"),
        "length": F.log1p(n),
        "word_length": F.log1p(n / F.greatest(n_words, F.lit(1))),
        "distinct_words": let(F.split(text, f"[{SPACE}]+"), lambda w: F.size(F.array_distinct(w)) / F.greatest(F.sqrt(F.size(w).cast("double")), F.lit(1.0))),
        # a word that is followed by itself, one match each: a repeated group would recurse once a repetition and end the JVM
        "repeats": share("(?<!\\S)(\\S++)\\s++(?=\\1(?!\\S))"),
        "distinct_lines": let(lines, lambda x: F.size(F.array_distinct(x)) / F.size(x)),
        "line_length": F.log1p(n / F.size(lines)),
    }
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in own.items()}


#: Features whose square roots are features too.
BENT = ("upper", "digits", "marks", "symbols", "bars", "stops", "beyond_ascii", "repeats")


@dataclass(frozen=True)
class Ranking:
    """weights and the threshold are over raw features; slope stretches strengths about the threshold."""

    names: tuple[str, ...]
    weights: tuple[float, ...]
    threshold: float
    slope: float

    def score(self, text: Column) -> Column:
        weight = dict(zip(self.names, self.weights))

        def sum_(f: Column) -> Column:
            out = F.lit(0.0)
            for k in self.names:
                out = out + F.lit(weight[k]) * (F.sqrt(f[k.removesuffix("_root")]) if k.endswith("_root") else f[k])
            return out

        # a filter would work the features out again wherever they are written: they are put into one struct first
        strength = let(F.struct(*[e.alias(k) for k, e in features(text).items()]), sum_) if self.names else F.lit(0.0)
        base = float(np.log(REJECT_BELOW / (1 - REJECT_BELOW))) if self.names else 0.0
        z = F.greatest(F.least(F.lit(self.slope) * (strength - F.lit(self.threshold)) + F.lit(base), F.lit(35.0)), F.lit(-35.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> np.ndarray:
    """Weights for x's columns, by Newton steps on the logistic loss of pairs' differences."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -35, 35)))
        gradient = d.T @ (p - 1) / len(d) + RIDGE * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def slope_of(strength: np.ndarray, y: np.ndarray, offset: float) -> float:
    """The slope that fits label 1's chance best by a logistic through offset at strength 0."""
    a = 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * strength + offset, -35, 35)))
        step = (np.mean((p - y) * strength) + 1e-4 * a) / (np.mean(p * (1 - p) * strength**2) + 1e-4)
        a = min(max(a - step, 1e-3), 50.0)
        if abs(step) < 1e-8:
            break
    return float(a)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ranking:
    """docs: doc_id, text. labels: doc_id, quality; rows of the held-out fold are not learnt from."""
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), FOLDS))
    own = own.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # a repeated id gives one row, the one whose text has the least hash: at most sample_rows rows come to the driver
    texts = docs.join(F.broadcast(own), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min(F.struct(F.xxhash64(text_of()).alias("hash"), text_of().alias("text"))).alias("t"))
    rows = texts.select("y", F.col("t.text").alias("text")).select("y", *[e.alias(k) for k, e in features(F.col("text")).items()]).toPandas()
    rows = rows.sort_values(list(rows.columns))
    rows = rows.assign(**{f"{k}_root": np.sqrt(rows[k]) for k in BENT})
    names = [k for k in rows.columns if k != "y"]
    y, x = rows["y"].to_numpy(float), rows[names].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return Ranking((), (), 0.0, 1.0)
    scale = x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    mean = x.mean(axis=0)
    w = bradley_terry((x - mean) / scale, y)
    strength = x @ (w / scale)
    threshold = float(np.quantile(strength, 1 - y.mean()))
    spread = strength.std() or 1.0
    slope = slope_of((strength - threshold) / spread, y, float(np.log(REJECT_BELOW / (1 - REJECT_BELOW)))) / spread
    return Ranking(tuple(names), tuple(map(float, w / scale)), threshold, slope)


def scored(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """docs with score and predicted."""
    return docs.withColumn("score", ranking.score(text_of())).withColumn("predicted", (F.col("score") >= REJECT_BELOW).cast("int"))
