"""A corpus pipeline: quality, toxicity, near-duplicates, source mix, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared
folder and reads it again as the next one's docs. In every stage null, empty, blank and very long texts are texts like
any other (a null one counts as empty), rows with a null id are rows, repeated rows are judged each by itself unless said
otherwise, columns of any name and type pass through, and an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, mixing, quality, shingles
from weftline.llm.common import col, fresh_path, table
from weftline.llm.queries import toxic_scores, vocabulary

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def whole_rows(docs: DataFrame) -> DataFrame:
    """Texts beside whole rows, so that columns of any name pass a stage."""
    return docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), "text")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking (operator 3), fitted on labelled ones, lets pass. Without labels all pass."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(whole_rows(docs), model, ("row",))
    return scored.where("predicted = 1").select("row.*")


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain (operator 2) does not find toxic. Without labels none is toxic."""
    labels = table(spark, sf_dir, "labels")
    return toxic_scores(whole_rows(docs), labels, ("row",), train_on=docs).where("toxic = 0").select("row.*")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets are similar at 0.8 or more.

    SimHash fingerprints of five-word shingles, linked through Golay keys (operator 9), and keys for the pairs that three
    bits do not reach find candidates; the shingle sets decide. The least id stays, a null one only if its group has no
    other; ties go to the text's hash, then to the row's. Repeated rows are copies: one stays. Texts without words are
    copies of each other.
    """
    return shingles.representatives(docs, shingle=SHINGLE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights (operator 7): documents left out, kept or repeated.

    Texts without words weigh nothing. A null source is a source, the last.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and digests of every document's ids and of the text that decodes from them (operator 6).

    A text without words has no ids and decodes to the empty text. Rows repeat as they come.
    """
    return bpe.round_trip_digests(docs, vocabulary("word_bpe_49k.json"), reread=True)


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", keep_civil),
    ("SimHash near-dedup", keep_distinct),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Trained models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{n}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
