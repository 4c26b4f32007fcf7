"""Toxicity categories by a chain of linear classifiers."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut, over_texts, ship
from .features import BUCKETS, TermSlots
from .quality import bounded_sample, sigmoid

#: The most labelled documents of each class that the chain is fitted on.
MOST_EACH = 3_000
FOLDS = 5
#: Chi-squared that a slot needs to enter a model: one in a thousand by chance.
LEAST_CHI2 = 10.83


@dataclass
class Link:
    """One category's linear model: weights of slots, of the earlier categories' probabilities, and a constant."""

    slots: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


@dataclass
class Chain:
    categories: tuple[str, ...]
    links: list[Link] = field(default_factory=list)


class _Rows:
    """Documents' slots as row and slot numbers."""

    def __init__(self, row: np.ndarray, slot: np.ndarray, n: int):
        self.row, self.slot, self.n = row, slot, n

    def only(self, keep: np.ndarray) -> _Rows:
        to = (np.cumsum(keep) - 1).astype(np.int32)
        inside = keep[self.row]
        return _Rows(to[self.row[inside]], self.slot[inside], int(keep.sum()))


def _telling(x: _Rows, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Slots that go with y or its absence, by weighted chi-squared."""
    with_y = np.bincount(x.slot, weights=(w * y)[x.row], minlength=BUCKETS)
    without = np.bincount(x.slot, weights=(w * (1 - y))[x.row], minlength=BUCKETS)
    seen = np.bincount(x.slot, minlength=BUCKETS)
    pos, neg = (w * y).sum(), (w * (1 - y)).sum()
    both, n = with_y + without, pos + neg
    cross = with_y * (neg - without) - without * (pos - with_y)
    chi2 = n * cross**2 / np.maximum(both * (n - both) * pos * neg, 1e-9)
    return np.flatnonzero((chi2 >= LEAST_CHI2) & (seen >= 2))


def fit_link(x: _Rows, earlier: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 0.05) -> Link:
    """Weighted logistic regression by Newton steps, each solved by conjugate gradients."""
    if not (0 < y.sum() < len(y)):
        rate = np.clip(((w * y).sum() + 0.01) / (w.sum() + 0.02) if len(y) else 0.01, 1e-4, 1 - 1e-4)
        return Link(np.empty(0, np.int64), np.empty(0), np.zeros(earlier.shape[1]), float(np.log(rate / (1 - rate))))
    slots = _telling(x, y, w)
    to = np.full(BUCKETS, -1)
    to[slots] = np.arange(len(slots))
    inside = to[x.slot] >= 0
    row, col = x.row[inside], to[x.slot[inside]]
    k, e = len(slots), earlier.shape[1]

    def forward(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=v[:k][col], minlength=x.n) + earlier @ v[k : k + e] + v[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(col, weights=r[row], minlength=k), earlier.T @ r, [r.sum()]])

    v = np.zeros(k + e + 1)
    ridge = np.append(np.full(k + e, penalty), 1e-6)
    for _ in range(15):
        p = sigmoid(forward(v))
        gradient = back(w * (p - y)) + ridge * v
        curve = np.maximum(w * p * (1 - p), 1e-9)
        step, r = np.zeros_like(v), -gradient
        d, rr = r.copy(), r @ r
        for _ in range(25):
            if rr < 1e-10:
                break
            hd = back(curve * forward(d)) + ridge * d
            a = rr / (d @ hd)
            step += a * d
            r -= a * hd
            new = r @ r
            d, rr = r + new / rr * d, new
        size = np.abs(step).max()
        v += step * min(1.0, 4.0 / max(size, 1e-9))
        if size < 1e-4:
            break
    return Link(slots, v[:k], v[k : k + e], float(v[-1]))


def _predict(link: Link, x: _Rows, earlier: np.ndarray) -> np.ndarray:
    table = np.zeros(BUCKETS)
    table[link.slots] = link.weights
    return sigmoid(np.bincount(x.row, weights=table[x.slot], minlength=x.n) + earlier @ link.earlier + link.bias)


def fit_chain(x: _Rows, y: dict[str, np.ndarray], w: np.ndarray, fold: np.ndarray) -> Chain:
    """One link a category, in order. A link sees the earlier categories' out-of-fold probabilities: each document's come
    from models fitted without its fold, so later links learn how far earlier ones can be trusted on new documents."""
    chain, seen = Chain(tuple(y)), np.empty((x.n, 0))
    for target in y.values():
        target = target.astype(float)
        chain.links.append(fit_link(x, seen, target, w))
        out = np.zeros(x.n)
        for f in range(FOLDS):
            rest = fold != f
            if rest.all() or not rest.any():
                continue
            held = x.only(~rest)
            out[~rest] = _predict(fit_link(x.only(rest), seen[rest], target[rest], w[rest]), held, seen[~rest])
        seen = np.column_stack([seen, out])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", most: int = MOST_EACH) -> Chain:
    """A chain for categories, each a 0/1 expression over the columns of labels; the last is the one samples balance.

    Fitted on at most `most` labelled documents with the last category and as many without it, by hash; weights give
    both kinds their share among all labels of docs. Labels that are null count as 0; of labels that repeat an id the
    greatest stand, of documents that repeat one a single text. Rows without text or id and labels of documents that are
    not in docs are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    names = list(categories)
    flags = labels.where(col(id_col).isNotNull()).groupBy(col(id_col).alias("__id")).agg(*[F.max(F.coalesce(c.cast("int"), F.lit(0))).alias(f"__y{i}") for i, c in enumerate(categories.values())])
    texts = docs.where(col(text_col).isNotNull()).select(col(id_col).alias("__doc"), col(text_col).alias("text"))
    flags = cut(flags.join(texts, F.col("__id") == F.col("__doc"), "left_semi"))
    last = f"__y{len(names) - 1}"
    totals = {r[0]: r[1] for r in flags.groupBy(last).count().collect()}
    sample = bounded_sample(flags.where(F.col(last) == 1), "__id", most).unionAll(bounded_sample(flags.where(F.col(last) == 0), "__id", most))
    keep = ["__id", *[f"__y{i}" for i in range(len(names))]]

    def slots_of():
        slots = TermSlots()
        return lambda given: [pa.array([np.array(sorted(slots(t.as_py())), np.int32).tobytes() for t in given], pa.binary())]

    joined = texts.join(F.broadcast(sample), F.col("__doc") == F.col("__id")).select(*keep, "text")
    one_each = over_texts(joined, keep, "text", slots_of, "slots binary").groupBy(*keep).agg(F.min("slots").alias("slots"))
    rows = one_each.toPandas().sort_values(keep, kind="stable").reset_index(drop=True)
    parts = [np.frombuffer(b, np.int32) for b in rows.pop("slots")]
    x = _Rows(np.repeat(np.arange(len(rows), dtype=np.int32), [len(p) for p in parts]), np.concatenate(parts) if parts else np.empty(0, np.int32), len(rows))
    del parts
    y = {name: rows[f"__y{i}"].to_numpy() for i, name in enumerate(names)}
    z = y[names[-1]]
    w = np.ones(len(rows))
    for value in (0, 1):
        if (z == value).any():
            w[z == value] = totals.get(value, 0) / (z == value).sum()
    w /= w.mean() if len(w) else 1
    return fit_chain(x, y, w, np.arange(len(rows)) % FOLDS)


def score(docs: DataFrame, chain: Chain, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keep and p_<category> for each category, from every whole text, each link fed the probabilities before it.

    Null and empty texts get what texts without words get. Nothing is shuffled; the model is a few thousand weights.
    Columns that are not kept are not read; to keep columns named as the result's are, keep a struct of them.
    """
    ship(docs.sparkSession)
    names = [f"p_{c}" for c in chain.categories]
    used = sorted(set().union(*(link.slots.tolist() for link in chain.links)))

    def scorer():
        slots = TermSlots(frozenset(used))
        tables = []
        for link in chain.links:
            tables.append(np.zeros(BUCKETS))
            tables[-1][link.slots] = link.weights

        def scores(texts: pa.Array) -> list:
            found = [slots(t.as_py()) for t in texts]
            sums = np.array([[t[list(f)].sum() if f else 0.0 for t in tables] for f in found]).reshape(len(found), len(tables))
            p = np.empty((len(found), 0))
            for i, link in enumerate(chain.links):
                p = np.column_stack([p, sigmoid(sums[:, i] + p @ link.earlier + link.bias)])
            return [pa.array(np.ascontiguousarray(c)) for c in p.T]

        return scores

    return over_texts(docs, list(keep), text_col, scorer, ", ".join(f"{n} double" for n in names))
