"""Quality scores learned from preference pairs (Bradley-Terry)."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, over_texts, ship
from .features import QUALITY_FEATURES, quality_features

#: Pairs that a test may draw to hold the fit against; the fit itself takes all.
PAIRS = 100_000
#: The loss of all pairs is summed on a grid of scores: a score is shared among the points near it by Lagrange's weights,
#: which give the loss's slope at any difference of two scores to some 1e-12.
STEP = 1 / 16
NEAR = np.arange(-3, 5)
#: Width of the cells of scores that the curvature is summed over; it only decides how fast the fit converges.
CELL = 1 / 2


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


@dataclass
class Ranking:
    """score = sigmoid(x . weights - threshold), x standardised features; constant where labels hold but one class."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return _squash((x - self.centre) / self.scale)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Row by row: what a row gets does not depend on those beside it, as it may in a matrix product."""
        return (self.inputs(x) * self.weights).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x) - self.threshold)


def _squash(z: np.ndarray) -> np.ndarray:
    """Far values count less than in proportion, so that no one feature outvotes the others."""
    return np.sign(z) * np.log1p(np.abs(z))


def _add(a: dict, b: dict) -> dict:
    for k, v in b.items():
        a[k] = a[k] + v if k in a else v
    return a


@dataclass
class Labelled:
    """Columns y and x of labelled documents, which stay where they are: only sums over them come to the driver."""

    rows: DataFrame

    def __len__(self) -> int:
        return self.rows.count()

    def total(self, f: Callable[[np.ndarray, np.ndarray], dict]) -> dict:
        """The sums, by key, of what f(x, y) gives for blocks of rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict = {}
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    _add(found, f(x, batch.column(0).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["part"])

        parts = self.rows.select("y", "x").mapInArrow(run, "part binary").rdd.map(lambda r: pickle.loads(r[0]))
        return parts.treeReduce(_add) if parts.getNumPartitions() else {}


def _sums(x: np.ndarray, y: np.ndarray) -> dict:
    return {"x": x.sum(0)} | {label: int((y == label).sum()) for label in (0, 1)}


def _squares(x: np.ndarray, y: np.ndarray, centre: np.ndarray) -> dict:
    return {"xx": ((x - centre) ** 2).sum(0)}


def _tally(x: np.ndarray, y: np.ndarray, model: Ranking) -> dict:
    """By label: number and summed inputs at each point of the grid, and their products in each cell."""
    found: dict = {}
    z, s = model.inputs(x), model.raw(x)
    for label in np.unique(y).tolist():
        rows, of = np.column_stack([np.ones(len(z)), z])[y == label], s[y == label]
        order = np.argsort(of, kind="stable")
        rows, of = rows[order], of[order] / STEP
        base = np.floor(of)
        starts = np.flatnonzero(np.diff(base, prepend=base[0] - 1))
        for n in NEAR:
            share = np.prod([(of - base - m) / (n - m) for m in NEAR if m != n], axis=0)
            points = (base[starts] + n).astype(int).tolist()
            _add(found, {("point", label, p): v for p, v in zip(points, np.add.reduceat(rows * share[:, None], starts), strict=True)})
        cell = np.floor(of * (STEP / CELL))
        for c in np.unique(cell).tolist():
            some = rows[cell == c]
            found["cell", label, int(c)] = some.T @ some
    return found


def _slope(tally: dict) -> np.ndarray:
    """The sum over all pairs of sigmoid(s0 - s1) (z0 - z1), of documents 1 of label 1 and 0 of label 0."""
    (at1, sum1), (at0, sum0) = (_of(tally, "point", label) for label in (1, 0))
    total = np.zeros(sum1.shape[1] - 1)
    for i in range(0, len(at1), 1024):
        p = sigmoid((at0 - at1[i : i + 1024, None]) * STEP)
        total += (sum1[i : i + 1024, 0] @ p) @ sum0[:, 1:] - (p @ sum0[:, 0]) @ sum1[i : i + 1024, 1:]
    return total


def _curvature(tally: dict) -> np.ndarray:
    """The sum over all pairs of p (1 - p) (z1 - z0) (z1 - z0)', p taken at the cells of the two scores."""
    (at1, sum1), (at0, sum0) = (_of(tally, "cell", label) for label in (1, 0))
    total = np.zeros((sum1.shape[1] - 1,) * 2)
    for a, m in zip(at1, sum1, strict=True):
        p = sigmoid((at0 - a) * CELL)
        n, z, zz = (np.tensordot(p * (1 - p), part, 1) for part in (sum0[:, 0, 0], sum0[:, 0, 1:], sum0[:, 1:, 1:]))
        crossed = np.outer(m[0, 1:], z)
        total += m[1:, 1:] * n + m[0, 0] * zz - crossed - crossed.T
    return total


def _of(tally: dict, kind: str, label: int) -> tuple[np.ndarray, np.ndarray]:
    at = sorted(k[2] for k in tally if k[:2] == (kind, label))
    return np.array(at, float), np.array([tally[kind, label, p] for p in at])


def _prefixes(x: np.ndarray, y: np.ndarray, model: Ranking, known: list[int], shift: int) -> dict:
    """Counts of the scores' leading bits, as integers in the scores' order, where those before the last 16 are known."""
    bits = (model.raw(x) + 0.0).view(np.uint64)
    first = np.uint64(1 << 63)
    leading = np.where(bits >= first, ~bits, bits | first) >> np.uint64(shift)
    values, counts = np.unique(leading[np.isin(leading >> np.uint64(16), np.array(known, np.uint64))], return_counts=True)
    return dict(zip(values.tolist(), counts.tolist(), strict=True))


def _at_ranks(total: Callable, model: Ranking, ranks: set[int]) -> list[float]:
    """The scores at these ranks from 0 up, exactly: 16 bits of each a pass, by counts."""
    found = {rank: (0, rank) for rank in ranks}
    for shift in (48, 32, 16, 0):
        counts = sorted(total(partial(_prefixes, model=model, known=sorted({p for p, _ in found.values()}), shift=shift)).items())
        for rank, (known, left) in found.items():
            for value, n in counts:
                if value >> 16 == known:
                    if left < n:
                        found[rank] = (value, left)
                        break
                    left -= n
    keys = np.array([p for p, _ in found.values()], np.uint64)
    first = np.uint64(1 << 63)
    return np.where(keys >= first, keys ^ first, ~keys).view(np.float64).tolist()


def fit_ranking(x: np.ndarray | Labelled, y: np.ndarray | None, penalty: float = 1e-3) -> Ranking:
    """Weights under which documents of label 1 outrank those of label 0: logistic loss on the feature differences of all
    pairs of the two, by Newton steps. Each step is one pass over the rows, whose cost follows their number.

    The threshold is the score quantile at the share of label 0: as many training documents pass as have label 1.
    Figures are rounded so that the order in which Spark sums does not show. y is part of a Labelled x.
    """
    total = x.total if isinstance(x, Labelled) else lambda f: f(x, y) if len(x) else {}
    sums = total(_sums)
    bad, good = sums.get(0, 0), sums.get(1, 0)
    k, n = len(sums.get("x", QUALITY_FEATURES)), bad + good
    if not good or not bad:
        level = 0.0 if not n else (4.0 if good else -4.0)
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k), -level)
    centre = np.round(sums["x"] / n, 12)
    scale = np.round(np.sqrt(total(partial(_squares, centre=centre))["xx"] / n), 12) + 1e-6
    model = Ranking(centre, scale, np.zeros(k), 0.0)
    for _ in range(50):
        tally = total(partial(_tally, model=model))
        gradient = penalty * model.weights + _slope(tally) / (good * bad)
        step = np.linalg.solve(_curvature(tally) / (good * bad) + penalty * np.eye(k), gradient)
        model.weights = model.weights - step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = np.round(model.weights, 7)
    below = (n - 1) * bad // n
    model.threshold = float(np.mean(_at_ranks(total, model, {below, below + 1})))
    return model


def bounded_sample(labels: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most so many rows of labels, those with the smallest hashes: the same rows whatever the partitions."""
    return labels.orderBy(F.xxhash64(F.lit(7), F.col(id_col)), F.col(id_col)).limit(most)


def _featured(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    def features(texts: pa.Array) -> list:
        return [pa.array([quality_features(t.as_py()) for t in texts], pa.list_(pa.float64()))]

    return over_texts(df, keep, text_col, lambda: features, "x array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranking:
    """Fits on all labelled documents, one of each id however often it repeats. Rows without a text, id or label are left
    out.

    Texts are not shuffled, their features are: they meet the labels by id and stay in Spark. A pass over them sends the
    driver sums by score, as many as the scores' range has steps.
    """
    ship(docs.sparkSession)
    labelled = labels.where(col(label_col).isin(0, 1) & col(id_col).isNotNull()).groupBy(col(id_col).alias("__id")).agg(F.min(col(label_col)).cast("int").alias("__y"))
    texts = docs.where(col(text_col).isNotNull() & col(id_col).isNotNull()).select(col(id_col).alias("__doc"), col(text_col).alias("text"))
    joined = _featured(texts, ["__doc"], "text").join(labelled, F.col("__doc") == F.col("__id"))
    rows = joined.groupBy("__id").agg(F.min("__y").alias("y"), F.min("x").alias("x")).persist()
    try:
        return fit_ranking(Labelled(rows), None)
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: Ranking, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keep, score in (0, 1) and predicted = score >= 0.5 for every row of docs, from its whole text alone.

    Null and empty texts get the score of a text of no words. Nothing is shuffled. Columns that are not kept are not
    read; to keep columns named score or predicted, keep a struct of them.
    """
    ship(docs.sparkSession)

    def scores(texts: pa.Array) -> list:
        x = np.array([quality_features(t.as_py()) for t in texts]).reshape(-1, len(QUALITY_FEATURES))
        return [pa.array(model.score(x))]

    out = over_texts(docs, list(keep), text_col, lambda: scores, "score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
