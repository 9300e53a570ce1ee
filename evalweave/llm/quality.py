"""Quality by Bradley-Terry pairwise ranking.

A document's strength is a linear function of its features. For a pair in which a is preferred to b, the chance of that
preference is the logistic function of the difference of strengths, so the weights come from a logistic loss on feature
differences. The strengths are cut at the quantile that agrees best with the labels.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import claim, small_batches, stored, texts_of

FEATURES = ("symbols", "shouts", "upper", "digits", "bars", "echoes", "lines", "long_words", "short")

_CLASS = {name: np.zeros(256, bool) for name in ("symbols", "digits", "upper", "lower")}
_CLASS["symbols"][list(b"#$%&*+<=>@\\^_`{}~")] = True
_CLASS["digits"][list(b"0123456789")] = True
_CLASS["upper"][65:91] = True
_CLASS["lower"][97:123] = True
_CLASS["lower"][128:] = True


def features(text: str) -> list[float]:
    """Shares of the whole text, on a log scale; all 0 for an empty one (but ``short``)."""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    words = data.split()
    n_words = max(1, len(words))
    echoes = sum(map(operator.eq, words, islice(words, 1, None)))
    lines = [line for line in data.split(b"\n") if line.strip()]
    again = 1 - len(set(lines)) / len(lines) if lines else 0.0
    upper, lower = int(counts[_CLASS["upper"]].sum()), int(counts[_CLASS["lower"]].sum())
    shares = (
        int(counts[_CLASS["symbols"]].sum()) / n,
        int(counts[33]) / n,
        max(0, upper - n_words * 0.3) / max(1, upper + lower),
        int(counts[_CLASS["digits"]].sum()) / n,
        int(counts[124]) / n,
        echoes / n_words,
        again,
        max(0.0, (upper + lower) / n_words / 12 - 1),
        1 / (10 + n_words),
    )
    return [math.log1p(100 * s) for s in shares]


def with_features(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, features) for every row; nothing but the text is read. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for batch in batches:
            rows = pa.array([features(t) for t in texts_of(batch, "_text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=[id_col, "features"])

    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, features array<double>")


def preference_pairs(x: np.ndarray, y: np.ndarray, per_row: int, seed: int) -> np.ndarray:
    """Feature differences (better minus worse): each row of the rarer label meets ``per_row`` rows of the other."""
    rng = np.random.default_rng(seed)
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return np.zeros((0, x.shape[1]))
    n = per_row * min(len(good), len(bad))
    draw = [np.resize(rng.permutation(len(side)), n) for side in (good, bad)]
    return good[draw[0]] - bad[rng.permutation(draw[1])]


def fit_bradley_terry(pairs: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights that minimise the mean logistic loss of the differences (Newton's method, ridge penalty)."""
    w = np.zeros(pairs.shape[1])
    for _ in range(steps if len(pairs) else 0):
        p = 1 / (1 + np.exp(-np.clip(pairs @ w, -30, 30)))
        gradient = ridge * w - pairs.T @ (1 - p)
        hessian = ridge * np.eye(len(w)) + (pairs * (p * (1 - p))[:, None]).T @ pairs
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def cut_at_quantile(strengths: DataFrame, labelled: DataFrame, levels: int = 1000) -> tuple[float, float]:
    """The strength, among the quantiles of all documents, that separates the labels best; and half the gap below it.

    ``strengths`` has ``strength`` for all rows, ``labelled`` has ``strength`` and ``label``. Labels are counted between quantiles in
    Spark; one row per quantile reaches the driver. Ties go to the lower cut, which rejects fewer.
    """
    grid = [i / levels for i in range(levels + 1)]
    found = strengths.agg(F.percentile_approx("strength", grid, 20 * levels).alias("q")).first()["q"]
    if not found:
        return 0.0, 1.0
    cuts = np.unique(np.array(found, float))

    @F.pandas_udf("int")
    def accepting(strength: pd.Series) -> pd.Series:
        """How many cuts accept the row, by binary search."""
        return pd.Series(np.searchsorted(cuts, strength.to_numpy(float), side="right"))

    sides = labelled.groupBy(accepting("strength").alias("b")).agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad"))
    counts = {r["b"]: (r["good"], r["bad"]) for r in sides.collect()}
    good = np.array([counts.get(i, (0, 0))[0] for i in range(len(cuts) + 1)], float)
    bad = np.array([counts.get(i, (0, 0))[1] for i in range(len(cuts) + 1)], float)
    # Cut i accepts rows with at least i + 1 cuts below them.
    right = np.cumsum(bad)[:-1] + (good.sum() - np.cumsum(good)[:-1])
    best = int(np.argmax(right))
    gap = (cuts[best] - cuts[best - 1]) / 2 if best else 0.0
    return float(cuts[best] - gap), max(float(gap), 1e-3)


@dataclass
class QualityModel:
    """Weights of the features, and where the cut lies: a strength of ``at`` scores ``threshold``."""

    weights: list[float]
    at: float
    gap: float
    threshold: float

    def margin(self, strength):
        return (strength - self.at) / max(self.gap, 0.05) + math.log(self.threshold / (1 - self.threshold))

    def score(self, features: Column) -> Column:
        m = self.margin(_strength(features, self.weights))
        return 1 / (1 + F.exp(-F.greatest(F.least(m, F.lit(30.0)), F.lit(-30.0))))


def _strength(features: Column, weights: list[float]) -> Column:
    return sum((features[i] * float(v) for i, v in enumerate(weights)), F.lit(0.0))


def fit_quality(
    df: DataFrame,
    id_col: str,
    text: str,
    labels: DataFrame,
    label_id: str,
    label: str,
    learn: Column,
    threshold: float = 0.3,
    sample_rows: int = 4000,
    per_row: int = 8,
    seed: int = 7,
) -> tuple[QualityModel, DataFrame]:
    """The model, and the stored (id, features) of all rows of ``df``.

    Weights are learnt from about ``sample_rows`` labelled rows (chosen by a hash of the id; that number bounds what reaches the
    driver) for which ``learn``, an expression on ``label_id``, holds. The cut is a quantile of all documents' strengths, chosen by all
    labelled rows with ``learn``. Null labels, labels without a document and null ids are not used. Without labels of both
    kinds all weights are 0 and every score equals ``threshold``. Each text is scored by itself and as a whole; null
    counts as empty; repeated rows get equal scores. ``threshold`` is the score at the cut.
    """
    known = labels.where(learn & F.col(label).isin(0, 1)).select(F.col(label_id).alias("_id"), F.col(label).cast("int").alias("label"))
    prints = stored(with_features(df, id_col, text), "features")
    labelled = stored(prints.join(known, F.col(id_col) == F.col("_id")).select("_id", "features", "label"), "labelled")
    share = min(1.0, sample_rows / max(1, known.count()))
    chosen = labelled.where(F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)).collect()
    chosen.sort(key=lambda r: (r["_id"], r["features"], r["label"]))
    x = np.array([r["features"] for r in chosen], float).reshape(len(chosen), len(FEATURES))
    y = np.array([r["label"] for r in chosen], int)
    weights = fit_bradley_terry(preference_pairs(x, y, per_row, seed)).tolist()
    at, gap = 0.0, 1.0
    if any(weights):
        strength = _strength(F.col("features"), weights).alias("strength")
        at, gap = cut_at_quantile(prints.select(strength), labelled.select(strength, "label"))
    return QualityModel(weights, at, gap, threshold), prints


def keep_good(df: DataFrame, text: str, model: QualityModel) -> DataFrame:
    """The rows that score at least the model's threshold; rows and columns unchanged, nothing is moved."""
    weights, start = np.array(model.weights), math.log(model.threshold / (1 - model.threshold))
    place = df.columns.index(text)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for batch in batches:
            good = [
                model.margin(float(np.dot(features(t or ""), weights))) >= start - 1e-9
                for t in batch.column(place).to_pylist()
            ]
            yield batch.filter(pa.array(good, pa.bool_()))

    return df.mapInArrow(run, df.schema)
