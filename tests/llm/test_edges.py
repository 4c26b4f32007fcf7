"""Odd tables: nulls, empties, repeated ids, dotted and clashing names, in operators and in every stage of the pipeline."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_operators import WORD, library

from weftline.llm import bpe, common, mixing, quality, sharding, simhash, token_counts, token_store, toxicity

LONG = " ".join(f"word{i % 997} and{i}" for i in range(30_000))
TEXTS = [None, "", " \t\n", "one", LONG, LONG + " more", "the same text of some words here", "the same text of some words here", "the same text of other words there"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, x, None if i % 2 else "s", 1.5, {"k": i}, "u") for i, x in enumerate(TEXTS)] + [(3, "three", "s", 1.5, {}, "v"), (3, "three", "s", 1.5, {}, "w"), (None, "nameless", None, None, None, None), (None, None, None, None, None, None)]
    names = ["doc_id", "text", "source", "a.b", "row", "n"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, c double, d map<string,int>, e string").toDF(*names)
    more = {c: F.lit(f"own {c}") for c in ("lang", "size", "copies", "target", "key", "id", "th", "hash", "kept_th", "score", "predicted", "toxic", "bucket", "start", "`", "block")}
    return df.withColumns({c: v for c, v in more.items() if c != "`"}).withColumn("tick`", F.lit(1)).repartition(3).cache()


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_every_stage_takes_odd_tables(spark, sf_dir, odd):
    import corpus_pipeline as P

    for name, stage in P.STAGES[:-1]:
        got = stage(spark, odd, sf_dir)
        assert got.columns == odd.columns and got.schema.simpleString() == odd.schema.simpleString(), name
        wanted = {repr(r) for r in odd.collect()}
        assert {repr(r) for r in got.collect()} <= wanted, name
        assert stage(spark, odd.limit(0), sf_dir).count() == 0, name
    last = P.STAGES[-1][1](spark, odd, sf_dir)
    assert last.count() == odd.count() and last.where("n_tokens = 0").count() == 4
    assert P.STAGES[-1][1](spark, odd.limit(0), sf_dir).count() == 0


def test_dedup_stage_on_odd_tables(spark, sf_dir, odd):
    import corpus_pipeline as P

    got = sorted((r.doc_id is None, r.doc_id, r.n) for r in P.keep_distinct(spark, odd, sf_dir).collect())
    again = sorted((r.doc_id is None, r.doc_id, r.n) for r in P.keep_distinct(spark, odd.repartition(5), sf_dir).collect())
    assert got == again
    ids = [r[1] for r in got]
    assert ids == [0, 3, 3, 4, 6, 8, None], "one text without words, two of id 3, one long text, one of the same, the nameless text"


def test_mix_and_shards_keep_every_column(odd):
    assert mixing.mix(odd).columns == odd.columns
    dealt = sharding.shuffle_into_shards(odd, 4, names=("in", "at"))
    assert dealt.columns == [*odd.columns, "in", "at"] and same(dealt.drop("in", "at"), odd)
    replaced = sharding.shuffle_into_shards(odd.withColumnRenamed("n", "slot"), 4)
    assert replaced.columns.count("slot") == 1 and replaced.select("slot").dtypes == [("slot", "bigint")]


def test_dotted_names(odd):
    df = odd.withColumnsRenamed({"doc_id": "the.id", "text": "the.text", "source": "the.source"})
    n = df.count()
    assert token_counts.count_tokens(df, WORD.replace("word_bpe_49k", "byte_bpe_50k"), "the.text", id_cols=("the.id", "a.b")).count() == n
    assert bpe.encode(df, WORD, ("the.id", "row"), "the.text").count() == n
    assert mixing.copies(df, "the.id", "the.text", "the.source").count() == n
    assert sharding.shuffle_into_shards(df, 4, id_col="the.id", text_col="the.text").count() == n
    assert simhash.near_duplicates(df, "the.id", "the.text").count() == n
    assert simhash.representatives(df, "the.id", "the.text").columns == df.columns


def test_repeated_ids_do_not_grow_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 5, f"text {i} " * (i + 1)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 5, i % 2, i % 2) for i in range(5)] * 20, "doc_id long, quality int, toxic int")
    sizes = []
    monkeypatch.setattr(quality, "fit_ranking", lambda x, y: sizes.append(len(x)))
    monkeypatch.setattr(toxicity, "fit_chain", lambda x, y, w, fold: sizes.append(x.n))
    quality.train(docs, labels)
    toxicity.train(docs, labels, {"toxic": F.col("toxic")})
    assert sizes == [5, 5]


def test_documents_without_ids_are_read_back(spark, tmp_path):
    rows = [(1, ""), (1, None), (2, " "), (2, "word"), (3, ""), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "s")
    token_store.write_store(df, path, WORD)
    got = token_store.read_digests(spark, path).collect()
    n = len(library(WORD).encode("word", add_special_tokens=False).ids)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 0), (2, n), (3, 0)]
    assert all(r.ids_crc32 == 0 for r in got if not r.n_tokens)
    assert sorted(len(r.ids) for r in token_store.read_ids(spark, path).collect()) == [0, 0, 0, 0, 0, n]


def test_decode_is_the_librarys_on_any_ids(spark):
    t = library(WORD)
    rows = [(1, [5, 0, 2, 700, 5, 5]), (2, []), (3, None), (1, [9]), (None, [1])]
    df = spark.createDataFrame(rows, "`the.id` long, ids array<int>")
    got = bpe.decode(df, WORD, ("the.id",)).collect()
    assert sorted((r[0] or 0, r.text or "none") for r in got) == sorted((i or 0, "none" if x is None else t.decode(x, skip_special_tokens=False) or "none") for i, x in rows)
    with pytest.raises(Exception, match="no such id"):
        bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), WORD).collect()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
