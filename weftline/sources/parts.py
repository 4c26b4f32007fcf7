"""Long jobs in parts: each part's rows are written and then marked, so a job that was stopped goes on with the others."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.pointer import Pointer


class Parts:
    """Parts of a result by name, in a folder of the shared storage. A part without a mark counts as not done, whatever of
    it was written; one with a mark is never written again. Parts are to be few and large: each is a Spark job."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.marks = spark, path, Pointer(spark, path)

    def done(self) -> list[str]:
        return sorted(self.marks.read_all())

    def run(self, names: Iterable[str], make: Callable[[str], DataFrame]) -> list[str]:
        """Makes and writes the parts that are not done; returns their names."""
        before, made = set(self.done()), []
        for name in names:
            if name in before:
                continue
            make(name).write.mode("overwrite").parquet(f"{self.path}/part={name}")
            self.marks.write_named(name, {})
            made.append(name)
        return made

    def read(self) -> DataFrame | None:
        """The rows of all parts that are done; None before the first."""
        paths = [f"{self.path}/part={n}" for n in self.done()]
        return self.spark.read.parquet(*paths) if paths else None

    def finish(self, target: str, dedup: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Writes all rows to target, then drops the parts and their marks: nothing of a finished job is left to go on with."""
        rows = self.read()
        (rows if dedup is None else dedup(rows)).write.mode("overwrite").parquet(target)
        self.marks.delete(self.path)
        return self.spark.read.parquet(target)


def by_hash(df: DataFrame, key: str, parts: int) -> tuple[list[str], Callable[[str], DataFrame]]:
    """Names of so many parts of df, told by a hash of a column, and the rows of each."""
    return [str(i) for i in range(parts)], lambda name: df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == int(name))


def by_range(df: DataFrame, column: str, size: int = 50) -> tuple[list[str], Callable[[str], DataFrame]]:
    """Names of the ranges of `size` numbers of a column (pages, say) that occur, and the rows of each."""
    at = F.floor(F.col(column) / size)
    found = sorted(r[0] for r in df.select(at.alias("at")).where("at IS NOT NULL").distinct().collect())
    return [f"{n * size}-{n * size + size - 1}" for n in found], lambda name: df.where(at == int(name.split("-")[0]) // size)
