"""Labels of documents that are not there take no places of the sample."""

from pyspark.sql import functions as F

from weftline.llm import toxicity


def test_only_labels_of_docs_are_sampled(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda x, y, w, fold: fitted.append((y["toxic"].tolist(), w.tolist())) or toxicity.Chain(("toxic",)))
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(400)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400) if i % 10 in (0, 1, 3)], "doc_id long, text string")
    toxicity.train(docs, labels, {"toxic": F.col("toxic")}, most=30)
    y, w = fitted[0]
    assert sum(y) == 30 and len(y) == 60
    assert abs(sum(w[i] for i in range(60) if not y[i]) / sum(w[i] for i in range(60) if y[i]) - 2) < 1e-9
