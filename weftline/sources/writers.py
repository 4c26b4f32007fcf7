"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_tiers(events: DataFrame, path: str) -> None:
    events.write.partitionBy("tier").json(path)


def write_graph(edges: dict[str, DataFrame], path: str) -> None:
    """One folder a relation, so a lookup reads its relation only."""
    for name, rows in edges.items():
        rows.write.mode("overwrite").parquet(f"{path}/edges/rel_type={name}")


def write_splits(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").partitionBy("split").json(path)


def write_vectors(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_evaluation(summary: DataFrame, details: DataFrame, path: str) -> None:
    """The figures of an evaluation as one JSON file a summary of a few rows, and its cases as JSON lines."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    details.write.mode("overwrite").json(f"{path}/details")
