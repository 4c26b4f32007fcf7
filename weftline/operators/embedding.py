"""Vectors of documents from any encoder: batches of texts, the encoder loaded once a task, failed batches tried again."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.parts import Parts, by_hash

#: Texts that an encoder gets at once, and times that a failed batch is tried again.
BATCH, RETRIES = 100, 2
Encoder = Callable[[list[str]], list[list[float]]]


def encode(df: DataFrame, load: Callable[[], Encoder], id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH, retries: int = RETRIES, wait: float = 0.5) -> DataFrame:
    """id_col and vector (array<float>) of every row. load() runs once a task and gives a function from at most `batch`
    texts to their vectors; a batch that fails is tried again, then the task fails (and Spark tries it anew). Null texts
    are encoded as empty ones. The rows of a task's batches stay in their order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                texts = ["" if t is None else t for t in part["text"]]
                for attempt in range(retries + 1):
                    try:
                        vectors = encoder(texts)
                        break
                    except Exception:
                        if attempt == retries:
                            raise
                        time.sleep(wait * 2**attempt)
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(vectors)} vectors of {len(texts)} texts")
                yield pd.DataFrame({"id": part["id"], "vector": [[float(x) for x in v] for v in vectors]})

    kind = df.schema[id_col].dataType.simpleString()
    found = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, vector array<float>")
    return found.select(F.col("id").alias(id_col), "vector")


def encode_in_parts(spark: SparkSession, df: DataFrame, path: str, load: Callable[[], Encoder], parts: int = 16, id_col: str = "doc_id", **how) -> DataFrame:
    """encode() of df in parts under path: run again after a stop, it encodes only the parts that are not done."""
    job = Parts(spark, path)
    names, rows = by_hash(df, id_col, parts)
    job.run(names, lambda name: encode(rows(name), load, id_col, **how))
    return job.read()


def character_counter(alphabet: str = "0123456789") -> Callable[[], Encoder]:
    """An encoder that needs no model: how often each character of an alphabet occurs."""
    return lambda: lambda texts: [[float(t.count(c)) for c in alphabet] for t in texts]
