"""The ranking's fit takes every labelled document and every pair of unlike ones."""

import numpy as np
import pytest

from weftline.llm import features, quality


def noisy(n, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.exponential(size=n), np.full(n, 0.1), rng.integers(0, 3, n)])
    return x, (x[:, 0] - x[:, 1] + rng.normal(size=n) > 0).astype(int)


@pytest.mark.parametrize("n", [2, 3, 40, 1500])
def test_weights_are_the_optimum_over_all_pairs(n):
    x, y = noisy(n)
    y[:2] = 0, 1
    model = quality.fit_ranking(x, y)
    z = np.sign(x - model.centre) * np.log1p(np.abs(x - model.centre) / model.scale)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, x.shape[1])
    slope = 1e-3 * model.weights - (d / (1 + np.exp(d @ model.weights))[:, None]).mean(0)
    assert np.abs(slope).max() < 1e-6
    s = (z * model.weights).sum(1)
    assert model.threshold == pytest.approx(np.quantile(s, (y == 0).mean(), method="midpoint"), abs=1e-12)


@pytest.mark.parametrize("copies", [1, 500])
def test_threshold_among_ties(copies):
    x, y = np.repeat([[0.0], [1.0], [-2.0]], copies, 0), np.repeat([0, 1, 0], copies)
    model = quality.fit_ranking(x, y)
    assert model.threshold == pytest.approx(np.quantile(model.raw(x), 2 / 3, method="midpoint"), abs=1e-12)


def test_all_labelled_documents_are_fitted_on(spark):
    words = ["plain", "WORDS", "of", "a", "text.", "||", "!!", "12"]
    n = 21_000
    text = lambda i: " ".join(words[(i * 7919 >> b) % 8] for b in range(i % 5 + 1))
    rows = [(i, text(i), int((i * 31 + i % 5) % 7 > 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(6)
    model = quality.train(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    x, y = np.array([features.quality_features(t) for _, t, _ in rows]), np.array([q for *_, q in rows])
    assert np.abs(model.centre - x.mean(0)).max() < 1e-9
    whole = quality.fit_ranking(x, y)
    assert np.abs(model.weights - whole.weights).max() < 1e-6 and model.threshold == pytest.approx(whole.threshold, abs=1e-6)
    again = quality.train(df.repartition(3).select("doc_id", "text"), df.select("doc_id", "quality"))
    assert (again.weights == model.weights).all() and again.threshold == model.threshold
