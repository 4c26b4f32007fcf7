"""Importance resampling, the Merkle manifest and the rule ledger against brute force, and on odd tables."""

import hashlib
import math
import re
import sys
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_operators import ODD

from weftline.llm import hnsw, importance, merkle, quality_rules

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "wordwordword" * 9 + " ähnlich " * 30 + "x"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    texts = [*ODD, LONG, "x y " * 40, "x y " * 40, "ABC abc AbC " * 10]
    rows = [(i, t, None if i % 4 == 0 else "de" if i % 3 else "en", f"s{i % 2}", None if i % 5 == 0 else len(t or ""), 1) for i, t in enumerate(texts)]
    rows += [rows[-1]] * 3 + [(3, "other text of an id that is there", "de", None, 4, 1), (None, LONG, "de", None, None, 1), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank int").withColumns({c: F.lit(f"own {c}") for c in ("id", "g", "node", "place", "run", "score", "weight", "n_words", "failures", "top")}).repartition(3).cache()


# draw


def test_word_crcs():
    texts = ["", None, "Ab-cD9é!", LONG, "日本語 x", " a", "b ", "c" * 200 + " d"]
    crcs, sizes = importance.word_crcs(pa.array(["cut", *texts, "cut"]).slice(1, len(texts)))
    words = [WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert sizes.tolist() == [len(w) for w in words]
    assert crcs.tolist() == [zlib.crc32(w.encode()) for ws in words for w in ws]


def drawn(rows, target, percent, least, buckets, seed):
    words = [[zlib.crc32(w.encode()) % buckets for w in WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] for _, t in rows]
    s = Counter(b for ws in words for b in ws)
    t = Counter(zlib.crc32(w.encode()) % buckets for x in target for w in WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or "")))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), ws in zip(rows, words, strict=True):
        h = int(sha(f"{seed}:{'' if i is None else i}")[:8], 16)
        weight = sum(gain[b] for b in ws) // len(ws) if ws else 0
        out.append([i, len(ws), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(may[: len(may) * percent // 100]):
        r[4] = n + 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("percent, run_rows, range_rows", [(10, 10**6, 10**6), (60, 7, 3), (100, 50, 1), (0, 9, 9)])
def test_draw_is_brute_forces(spark, odd, monkeypatch, percent, run_rows, range_rows):
    monkeypatch.setattr(importance, "RUN_ROWS", run_rows), monkeypatch.setattr(importance, "RANGE_ROWS", range_rows), monkeypatch.setattr(importance, "BLOCK_ROWS", 2)
    target = spark.createDataFrame([("abc x ähnlich",), (None,), ("ABC",)], "words string")
    got = importance.resample(odd, target, target_col="words", percent=percent, least=3, buckets=50, seed=7)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(list, got.collect()), key=repr) == drawn(rows, ["abc x ähnlich", None, "ABC"], percent, 3, 50, 7)
    whole = importance.drawn_rows(odd.dropDuplicates(["doc_id"]), got)
    assert whole.columns == odd.columns and (percent or not whole.count())
    assert importance.resample(odd.limit(0), target, target_col="words").count() == 0
    assert importance.resample(odd, target.limit(0), target_col="words").count() == odd.count()


def test_merge_takes_blocks_in_order_and_stops():
    rng = np.random.default_rng(1)
    runs = [sorted(map(int, rng.integers(0, 60, n))) for n in (0, 1, 40, 90, 300)]
    blocks = sorted(((r, [(x,) for x in run[a : a + 7]]) for r, run in enumerate(runs) for a in range(0, len(run), 7)), key=lambda b: (b[1][0], b[1][-1]))
    for most in (0, 1, 100, 431, 500):
        read = []
        source = (read.append(b) or b for b in blocks)
        got = []
        for row, ranked in importance.merged(source, most):
            if ranked:
                got.append(row[0])
                assert all(b[1][0] <= row or b is read[-1] for b in read), "a block was read before its turn"
        assert got == sorted(x for run in runs for x in run)[:most]


# manifest


def brute_manifest(rows):
    leaf = lambda r: sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def climb(nodes):
        paths = [[] for _ in nodes]
        spans = [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            nxt, held = [], []
            for a in range(0, len(nodes), 2):
                pair = nodes[a : a + 2]
                for k, _ in enumerate(pair):
                    for i in spans[a + k]:
                        paths[i].append((k, pair[1 - k] if len(pair) == 2 else None))
                nxt.append(sha(*pair)), held.append([i for s in spans[a : a + 2] for i in s])
            nodes, spans = nxt, held
        return nodes[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf(r)))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ordered = {g: sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for g in langs}
    subs = {g: climb([x[1] for x in ordered[g]]) for g in langs}
    root, tops = climb([subs[g][0] for g in langs])
    return sorted(((i, x, subs[g][0], root, sha(*(s for _, s in subs[g][1][n] + tops[k] if s))) for k, g in enumerate(langs) for n, (i, x) in enumerate(ordered[g])), key=repr)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@pytest.mark.parametrize("height", [1, 2, 12])
def test_manifest_is_brute_forces(odd, height):
    leaves = odd.select("doc_id", "lang", merkle.leaf(FIELDS).alias("leaf"), F.lit(1).alias("kept"))
    got = merkle.fold(merkle.proofs(leaves, ("kept",), height=height))
    assert got.where("folded_root <> root OR kept <> 1").count() == 0
    rows = [tuple(r[c] for c in FIELDS) for r in odd.collect()]
    assert sorted(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256").collect()), key=repr) == brute_manifest(rows)
    assert merkle.proofs(leaves.limit(0), height=height).count() == 0
    assert merkle.proofs(leaves.where("doc_id = 5"), height=height).select("proof", F.col("leaf") == F.col("root")).collect() == [(bytearray(), True)]


def test_verify_tells_changed_rows(odd):
    proven = merkle.proofs(odd.select("doc_id", "lang", merkle.leaf(FIELDS).alias("leaf"))).cache()
    once = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).where("doc_id <> 3")
    changed = once.withColumn("text", F.when(F.col("doc_id") == 7, F.lit("another")).otherwise(F.col("text"))).unionByName(once.where("doc_id = 5").withColumn("doc_id", F.lit(99).cast("long")))
    told = {}
    for r in merkle.verify(changed, proven, FIELDS).collect():
        told.setdefault(r.doc_id, set()).add(r.verified)
    assert {i for i, v in told.items() if v != {True}} == {7, 99} and len(told) == changed.select("doc_id").distinct().count()


# rules


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


TEXTS = ["a a a a", "a b c", "a b c a b c", "x\n\nx\r\n x\nx", "#*|<> a&b", "é x y z\x1c\x85", *[" ".join("ab"[int(b)] for b in f"{i:012b}") for i in range(0, 4096, 117)]]


def test_measures_are_brute_forces():
    for t in [*ODD, *TEXTS, LONG]:
        assert quality_rules.measure((t or "").encode()) == brute_measures(t), t


def test_ledger_policies_and_ablations(spark, odd, tmp_path):
    df = odd.unionByName(spark.createDataFrame([(500 + i, "good words of some lengths and kinds here " * 1 + " ".join(f"w{i}x{j}" for j in range(60)) + "\nx" * i) for i in range(9)], "doc_id long, text string"), allowMissingColumns=True)
    quality_rules.write_ledger(df, str(tmp_path / "l"))
    rows = spark.read.parquet(str(tmp_path / "l"))
    held = rows.collect()
    assert sorted((repr(r.doc_id), *(r[m] for m in quality_rules.MEASURES)) for r in held) == sorted((repr(r.doc_id), *brute_measures(r.text)) for r in df.collect())
    fails = lambda r, rule: eval(quality_rules.RULES[rule].replace(" AND ", " and "), {}, {m: r[m] for m in quality_rules.MEASURES})
    policies = {**quality_rules.POLICIES, "none": ()}
    for r in quality_rules.apply_policies(rows, policies).collect():
        for version, rules in policies.items():
            assert r[f"kept_{version}"] == (not any(fails(r, x) for x in rules))
    for a in quality_rules.ablations(rows).collect():
        rules = quality_rules.POLICIES[a.version]
        failed = [[x for x in rules if fails(r, x)] for r in held]
        wanted = sum(a.rule in f for f in failed), sum(f == [a.rule] for f in failed), sum(not f for f in failed), sum(not set(f) - {a.rule} for f in failed)
        assert (a.failed, a.failed_alone, a.kept, a.kept_without) == wanted
    assert quality_rules.ablations(rows.limit(0)).select(F.sum("kept")).first()[0] == 0
    assert rows.where(quality_rules.sole_rule(("few_words",)) == "few_words").count() == sum(r.n_words < 50 for r in held)
    with pytest.raises(KeyError):
        quality_rules.mask(("unknown",))


# search


@pytest.mark.parametrize("clusters", [40, 100, 160, 200, 300])
def test_every_tight_cluster_is_found(clusters):
    for seed in range(3):
        rng = np.random.default_rng(seed)
        v = (rng.standard_normal((clusters, 64))[rng.integers(0, clusters, 4000)] + 0.05 * rng.standard_normal((4000, 64))).astype(np.float32)
        g, order = hnsw.build(v)
        asked = np.arange(0, 4000, 40)
        found, _ = hnsw.search(g, v[asked], 11)
        hits = [len(set(order[f[f >= 0]].tolist()) & set(np.argsort(((v - v[i]) ** 2).sum(1), kind="stable")[:11].tolist())) / 11 for i, f in zip(asked, found, strict=True)]
        assert np.mean(hits) >= 0.9, (clusters, seed)
