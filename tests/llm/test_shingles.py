"""Near-deduplication on shingle sets against brute force over all pairs."""

import numpy as np

from weftline.llm import shingles


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 10**6, n)]


def slow_set(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, base, edits):
    w = list(base)
    for at in rng.choice(len(w), edits, replace=False):
        w[at] = f"x{rng.integers(0, 10**6)}"
    return " ".join(w)


def corpus():
    rng = np.random.default_rng(5)
    texts = []
    for edits in (1, 1, 2, 2, 3, 4, 5, 8, 12) * 4:
        base = words(rng, 200)
        texts += [" ".join(base), edited(rng, base, edits), edited(rng, base, edits)]
    passage = words(rng, 60)
    texts += [" ".join(passage + words(rng, 60)) for _ in range(30)]
    hub = words(rng, 60)
    texts += [" ".join(hub), *[edited(rng, hub, 1) for _ in range(40)]]
    return texts + ["", "a", "A", "one two three", *[" ".join(words(rng, int(n))) for n in rng.integers(1, 80, 40)]]


def groups_of(n, pairs):
    top = list(range(n))
    for a, b in pairs:
        old, new = max(top[a], top[b]), min(top[a], top[b])
        top = [new if t == old else t for t in top]
    return top


def test_groups_equal_brute_force(spark, monkeypatch):
    texts = corpus()
    sets = [slow_set(t) for t in texts]
    top = groups_of(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert len(set(top)) < len(texts) - 60
    assert sorted(r.doc_id for r in shingles.representatives(df).collect()) == sorted(set(top))
    monkeypatch.setattr(shingles, "TILE", 7)
    assert sorted(r.doc_id for r in shingles.representatives(df).collect()) == sorted(set(top))
    assert shingles.representatives(df.limit(0)).count() == 0


def test_pairs_at_the_limit_are_candidates():
    rng = np.random.default_rng(6)
    seen = 0
    for _ in range(1000):
        h = np.unique(rng.integers(0, 1 << 63, 225, np.uint64))
        (ka, sa), (kb, sb) = shingles.sketch(h[:200]), shingles.sketch(h[25:])
        seen += bool((ka == kb).any()) and len(shingles.agreeing([sa, sb])[0]) == 1
    assert len(h) == 225 and seen >= 990  # 175 of 225 are common: 0.778, below the limit
