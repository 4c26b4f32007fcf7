"""The registered queries over whole tables, and the vector operators over several blocks and shards."""

import hashlib
import math
import os
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_operators import BYTE, WORD, library, slow_components, slow_fingerprint

from weftline.llm import embedding_dedup, features, neighbours, quality, queries, toxicity


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}


def ids_of(t, text):
    return t.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op4(spark, sf_dir, documents):
    rows = queries.op4_external_shuffle(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(documents[r.doc_id].encode()) + 1, zlib.crc32(documents[r.doc_id].encode()), "rows", None) for r in rows)
    slots = {s: sorted(r.slot for r in rows if r["shard"] == s) for s in range(16)}
    assert sum(map(len, slots.values())) == len(rows) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(x == list(range(len(x))) for x in slots.values())
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.slot * 16 + r["shard"])]
    lower = sum(a < b for a, b in zip(order, order[1:], strict=False)) / len(order)
    assert 0.4 < lower < 0.6, "the order of the table shows through"


def test_op5(spark, sf_dir, documents):
    t = library(BYTE)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op5_token_counts(spark, sf_dir).collect()}
    assert got == {i: (len(x.encode()), n := len(ids_of(t, x)), n > 1024) for i, x in documents.items()}


def test_op6(spark, sf_dir, documents):
    t = library(WORD)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_bpe_round_trip(spark, sf_dir).collect()}
    for i, x in documents.items():
        ids = ids_of(t, x)
        assert got[i] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode()))
    assert len(got) == len(documents)


def test_op9(spark, sf_dir, documents):
    ids = sorted(documents)
    fps = [slow_fingerprint(documents[i]) for i in ids]
    top = slow_components(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == {i: (f"{fps[n]:016x}", ids[top[n]]) for n, i in enumerate(ids)}


def test_op10(spark, sf_dir, documents):
    t, at = library(WORD), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op10_token_store(spark, sf_dir).collect()}
    for i in sorted(documents):
        ids = [*ids_of(t, documents[i]), 2]
        assert got[i] == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(got) == len(documents)


# classifiers: the model is what its loss asks for, and every score follows from it one document at a time


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def test_op3(spark, sf_dir, documents, labels):
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in documents}
    known = sorted(i for i in labels if not held.get(i, True) and labels[i][0] in (0, 1))
    x, y = np.array([features.quality_features(documents[i]) for i in known]), np.array([labels[i][0] for i in known])
    model = quality.fit_ranking(x, y)
    squash = lambda i: [math.copysign(math.log1p(abs(v)), v) for v in ((np.array(features.quality_features(documents[i])) - model.centre) / model.scale)]
    raw = {i: float(np.dot(squash(i), model.weights)) for i in documents}
    for r in queries.op3_quality_ranking(spark, sf_dir).collect():
        assert r.held_out == held[r.doc_id] and r.score == pytest.approx(sigmoid(raw[r.doc_id] - model.threshold), abs=1e-9)
        assert r.predicted == int(r.score >= 0.5)
    z = np.array([squash(i) for i in known])
    rng = np.random.default_rng(42)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(good, quality.PAIRS)] - z[rng.choice(bad, quality.PAIRS)]
    slope = 1e-3 * model.weights - (d * (1 - 1 / (1 + np.exp(-(d @ model.weights))))[:, None]).mean(0)
    assert np.abs(slope).max() < 1e-4
    assert abs(sum(raw[i] >= model.threshold for i in known) - int(y.sum())) <= 1


def test_op2(spark, sf_dir, documents, labels):
    docs, marks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train(docs, marks, queries.toxic_categories())
    slots_of = features.TermSlots()
    weights = [dict(zip(link.slots.tolist(), link.weights.tolist(), strict=True)) for link in chain.links]
    for r in queries.op2_toxicity_chain(spark, sf_dir).collect():
        slots, p = slots_of(documents[r.doc_id]), []
        for link, w in zip(chain.links, weights, strict=True):
            p.append(sigmoid(sum(w.get(s, 0.0) for s in slots) + sum(a * b for a, b in zip(link.earlier, p, strict=True)) + link.bias))
        assert [r.p_toxic_prose, r.p_toxic_junk, r.p_toxic] == pytest.approx(p, abs=1e-9) and r.toxic == int(r.p_toxic >= 0.5)
    right = [i for i in labels if i in documents and labels[i][1] in (0, 1)]
    got = {r.doc_id: r.toxic for r in queries.op2_toxicity_chain(spark, sf_dir).collect()}
    assert sum(got[i] == labels[i][1] for i in right) >= 0.95 * len(right)


def test_a_links_weights_are_the_losss(spark):
    rng = np.random.default_rng(9)
    n = 500
    slots = rng.integers(0, 40, (n, 5))
    x = toxicity._Rows(np.repeat(np.arange(n), 5), slots.reshape(-1), n)
    y, w, earlier = ((slots < 6).any(1) ^ (rng.random(n) < 0.1)).astype(float), rng.random(n) + 0.5, rng.random((n, 1))
    link = toxicity.fit_link(x, earlier, y, w)
    counts = np.zeros((n, len(link.slots)))
    for k, s in enumerate(link.slots):
        counts[:, k] = (slots == s).sum(1)
    p = 1 / (1 + np.exp(-(counts @ link.weights + earlier @ link.earlier + link.bias)))
    slope = np.concatenate([counts.T @ (w * (p - y)) + 0.05 * link.weights, earlier.T @ (w * (p - y)) + 0.05 * link.earlier, [(w * (p - y)).sum()]])
    assert len(link.slots) and np.abs(slope).max() < 1e-2


# vectors over several blocks and shards


def planted(spark, dim=24):
    """Random vectors, with clusters of near copies, pairs at cosines about 0.9 and exact copies among them."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((9000, dim))
    centres = rng.standard_normal((30, dim))
    near = np.repeat(centres, 100, 0) + 0.15 * rng.standard_normal((3000, dim))
    turn = rng.standard_normal((500, dim))
    u = base[:500] / np.linalg.norm(base[:500], axis=1)[:, None]
    turn -= (turn * u).sum(1)[:, None] * u
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    c = rng.uniform(0.88, 0.92, 500)[:, None]
    x = np.concatenate([base, near, c * u + np.sqrt(1 - c * c) * turn, base[:50]])
    x = x[rng.permutation(len(x))].astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    return rows, x.astype(np.float64)


def test_op8_over_blocks(spark, monkeypatch):
    rows, x = planted(spark)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    n = np.zeros(len(x), int)
    pairs = []
    for at in range(0, len(x), 1000):
        i, j = np.nonzero(u[at : at + 1000] @ u.T >= 0.9)
        i = i + at
        other = i != j
        n += np.bincount(i[other], minlength=len(x))
        pairs += zip(i[i > j].tolist(), j[i > j].tolist(), strict=True)
    top = slow_components(len(x), pairs)
    wanted = {i: (int(n[i]), top[i], top[i] == i) for i in range(len(x))}
    assert n.sum() > 100_000
    for sizes in ({}, {"BLOCK_ROWS": 500, "MOST_ROWS": 800, "MOST_PIVOTS": 4, "PLACE_ROWS": 2000}):  # by themselves, and with pivots inside cells
        for name, value in sizes.items():
            monkeypatch.setattr(embedding_dedup, name, value)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(rows).collect()}
        assert got == wanted, sizes


def test_a_pair_links_alike_in_dense_and_thin_tiles():
    rng = np.random.default_rng(3)
    u = rng.standard_normal((300, 33))
    u /= np.linalg.norm(u, axis=1)[:, None]
    least = float((u[0] * u[1]).sum())  # this very pair is at the limit

    def links(v):
        codes, factors = embedding_dedup.encode(v)
        block = {"vec": v, "codes": codes, "factors": factors, "ids": np.arange(len(v)), "weight": np.ones(len(v), np.int64)}
        near, _, _, _ = embedding_dedup.tile(block, block, least, True)
        return near

    x = embedding_dedup._unit(u)
    least = float(embedding_dedup._cosines(x, x, np.array([0]), np.array([1]))[0])
    crowd = np.concatenate([u[:2], u[:1] + 1e-3 * rng.standard_normal((298, 33))])
    thin = np.concatenate([u[:2], -u[:1] + 1e-3 * rng.standard_normal((298, 33))])
    assert links(thin)[1] == 1 and links(crowd)[1] >= 1
    cos = embedding_dedup._cosines(embedding_dedup._unit(crowd), embedding_dedup._unit(crowd), np.ones(300, int), np.arange(300))
    assert links(crowd)[1] == (np.delete(cos, 1) >= least).sum()


def test_op1_over_shards(spark):
    rows, x = planted(spark)
    asked = rows.where(F.col("vec_id") % 100 == 0)
    got = {}
    for r in neighbours.nearest(rows, asked).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r["id"]))
    hits = 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and mine == sorted(mine, key=lambda m: (m[1], m[2]))
        assert all(m[1] == pytest.approx(d[m[2]], abs=1e-12) for m in mine)
        hits += len({m[2] for m in mine} & set(best.tolist()))
    assert len(x) > neighbours.SHARD_ROWS and hits >= 0.9 * 10 * len(got)
