"""A stored collection of vectors against exact search, encoding in batches and parts, term pages in ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import collection as C
from weftline.operators import embedding as E
from weftline.operators import terms as T
from weftline.plans.asked import engine
from weftline.sources.parts import Parts, by_range


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 32))[rng.integers(0, 60, 4000)] + 0.3 * rng.standard_normal((4000, 32))
    rows = [(i, [float(v) for v in x[i]], int(i % 10), f"s{i % 3}") for i in range(4000)]
    rows += [(5000, None, 1, "s0"), (5001, [], 1, "s0"), (5002, [0.0] * 32, 1, "s0"), (5003, [float("nan")] * 32, 1, "s0"), (5004, [None] * 32, 1, "s0")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, source string")
    return C.create(df, str(tmp_path_factory.mktemp("vectors"))), df


def asked(df, n=40):
    return df.where(f"vec_id % {4000 // n} = 0 AND vec_id < 4000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def test_few_cells_find_most(stored):
    found, df = stored
    q = asked(df)
    for where in (None, F.col("label") == 3, (F.col("label") == 3) & (F.col("source") == "s1")):
        assert found.recall(q, 10, where) >= 0.9
    assert len(found.cells) > 40
    one = q.limit(1)
    pairs = found._nearest_cells([(r.query_id, r["query"]) for r in one.collect()], 10, None, C.PROBE)
    assert len(pairs) < len(found.cells) / 3, "a search reads few cells"
    plan = found.search(one, 10, F.col("label") == 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PushedFilters: [" in plan and "EqualTo(label,3)" in plan


def test_all_cells_are_exact(spark, stored):
    found, df = stored
    where = F.col("label").isin(1, 7)
    a, b = (found.search(asked(df, 10), 5, where, **how).select("query_id", "rank", "vec_id", "score") for how in ({"probe": C.MOST_CELLS}, {"exact": True}))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() == 50
    assert found.rows.count() == 4000, "vectors without a direction are in no cell"
    assert found.search(asked(df, 10), 3, F.col("label") == 99).count() == 0
    assert found.search(asked(df, 10), 3, but_self=True).where("query_id = vec_id").count() == 0
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [0.0] * 32)], "query_id long, query array<double>")
    assert found.search(odd).count() == 0 and found.search(odd, exact=True).count() == 0
    reopened = C.VectorCollection(spark, found.rows.inputFiles()[0].split("/rows/")[0])
    assert reopened.recall(asked(df, 10)) >= 0.9


def test_empty_collection(spark, stored, tmp_path):
    _, df = stored
    none = C.create(df.limit(0), str(tmp_path))
    assert none.search(asked(df, 10)).count() == 0 and none.search(asked(df, 10), exact=True).count() == 0


def test_an_engine_over_stored_vectors(spark, sf_dir, tmp_path):
    e, plain = engine(spark, sf_dir), engine(spark, sf_dir)
    e.store_vectors(str(tmp_path), exact=True)
    calls = [("semantic_search", {"query": "1996-07 延期 30"}), ("semantic_search", {"query": "款号42", "style_ids": [42, 7]}), ("semantic_search_by_date", {"query": "1997", "start": "1997-01-01", "end": "1997-03-01"}), ("semantic_search_by_conditions", {"query": "30", "categories": ["RF"], "min_delay_days": 100, "top_k": 4})]
    for name, p in calls:
        assert e.call(name, **p).collect() == plain.call(name, **p).collect() and not plain.call(name, **p).isEmpty()
    e.open_vectors(C.VectorCollection(spark, str(tmp_path), "key"))
    found = {tuple(r) for name, p in calls for r in e.call(name, **p).collect()}
    wanted = {tuple(r) for name, p in calls for r in plain.call(name, **p).collect()}
    scores = lambda rows: sorted(r[-1] for r in rows)
    assert len(found) == len(wanted) and sum(a == b for a, b in zip(scores(found), scores(wanted), strict=True)) >= 0.9 * len(wanted)


def test_batches_are_tried_again(spark, tmp_path):
    log = tmp_path / "log"

    def load():
        calls = {"n": 0}
        with open(log, "a") as f:
            f.write("loaded\n")

        def encoder(texts):
            calls["n"] += 1
            assert len(texts) <= 7
            if calls["n"] % 2:
                raise OSError("busy")
            with open(log, "a") as f:
                f.write(f"{len(texts)}\n")
            return [[float(len(t)), 1.0] for t in texts]

        return encoder

    df = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(50)], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.vector for r in E.encode(df, load, batch=7, wait=0).collect()}
    assert got == {i: [0.0 if i == 3 else float(i), 1.0] for i in range(50)}
    lines = log.read_text().split()
    assert lines.count("loaded") == 2 and sum(int(x) for x in lines if x != "loaded") == 50
    with pytest.raises(Exception, match="busy"):
        E.encode(df, load, batch=7, retries=0, wait=0).collect()


def test_a_stopped_encoding_goes_on(spark, tmp_path):
    df = spark.createDataFrame([(i, f"{i} text {i * 7}") for i in range(200)], "doc_id long, text string")
    broken = {"left": 2}

    class Stopping(Parts):
        def run(self, names, make):
            def some(name):
                if not broken["left"]:
                    raise KeyboardInterrupt
                broken["left"] -= 1
                return make(name)

            return super().run(names, some)

    whole = {r.doc_id: r.vector for r in E.encode(df, E.character_counter()).collect()}
    names, rows = E.by_hash(df, "doc_id", 5)
    make = lambda name: E.encode(rows(name), E.character_counter())
    with pytest.raises(KeyboardInterrupt):
        Stopping(spark, str(tmp_path / "e")).run(names, make)
    job = Parts(spark, str(tmp_path / "e"))
    assert len(job.done()) == 2
    assert len(job.run(names, make)) == 3 and job.run(names, make) == []
    assert {r.doc_id: r.vector for r in job.read().collect()} == whole
    assert {r.doc_id: r.vector for r in E.encode_in_parts(spark, df, str(tmp_path / "e"), E.character_counter(), parts=5).collect()} == whole


def test_term_pages_by_ranges(spark, tmp_path):
    def line(page, y, text, x=50.0):
        return [(page, x + i, y, c) for i, c in enumerate(text)]

    rows = line(20, 200.0, "上衣") + line(20, 180.5, "ｃｏａｔ") + line(70, 200.0, "衬衫") + line(70, 180.5, "ｓｈｉｒｔ") + line(170, 200.0, "ｄｒｅｓｓ［x］连衣裙")
    chars = spark.createDataFrame(rows, "page int, x0 double, y0 double, text string")
    names, pages = by_range(chars, "page", 50)
    assert names == ["0-49", "50-99", "150-199"]
    job, read = Parts(spark, str(tmp_path / "terms")), []

    def make(name):
        read.append(name)
        if len(read) == 2:
            raise OSError("stopped")
        return T.page_terms(pages(name))

    with pytest.raises(OSError):
        job.run(names, make)
    assert Parts(spark, str(tmp_path / "terms")).run(names, make) == ["50-99", "150-199"] and read == ["0-49", "50-99", "50-99", "150-199"]
    out = job.finish(str(tmp_path / "out"))
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in T.page_terms(chars).collect()} and out.count() == 3
    assert job.done() == [] and job.read() is None
