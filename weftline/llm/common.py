"""What the operators of this subpackage share: tables, worker imports, shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def col(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package where it is on the driver's own path only.

    On a cluster the package is installed, or sent with --py-files; an entry that does not exist there is harmless.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    parts = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, parts)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset a local master, whose executors are
    this machine, gets one of its own; a cluster is an error, since a machine's own folder is none that others can read."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="weftline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: later reads survive the loss of any executor. Its columns are new
    ones, so that it can be joined to what it came from."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True).toDF(*df.columns)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}/{what}"


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which whoever runs the job fits to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def renamed_columns(df: DataFrame, names: dict[str, str], more: str) -> StructType:
    """The schema of columns of df that names(new, old) renames, whatever their types, and of those that `more` declares."""
    return StructType([StructField(new, df.schema[old].dataType) for new, old in names.items()] + _parse_datatype_string(more).fields)


def over_texts(df: DataFrame, keep: list[str], text_col: str, make: Callable[[], Callable[[pa.Array], list]], more: str) -> DataFrame:
    """The columns `keep` of df, whatever their names, and those that `more` declares: make() gives each task a function
    from the texts of a batch to their values, a list of arrays."""
    names = {f"__k{i}": c for i, c in enumerate(keep)}
    schema = renamed_columns(df, names, more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values_of = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *values_of(batch.column(len(names)))], schema.names)

    found = df.select(*[col(c).alias(k) for k, c in names.items()], col(text_col).alias("__text")).mapInArrow(run, schema)
    return found.select(*[F.col(k).alias(c) for k, c in names.items()], *schema.names[len(names) :])


def text_bytes(name: str = "text"):
    """UTF-8 bytes of a text; null has none."""
    return F.coalesce(F.octet_length(col(name)), F.lit(0)).cast("long")
