"""Which row of a near-duplicate group stays."""

from weftline.llm import shingles, simhash


def test_one_row_of_each_component(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    c, d = (" ".join(f"{x}{i}" for i in range(50)) for x in "cd")
    for keep in (simhash.representatives, shingles.representatives):
        rows = [(5, a), (5, b), (3, a), (None, a), (None, c), (None, c), (7, d), (None, d), (9, d), (7, d)]
        got = keep(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, c), (3, a), (5, b), (7, d)]
