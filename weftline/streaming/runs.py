"""Tables kept as a few runs: a batch adds one run a table, and FAN runs of one level are merged into one of the next.

What a batch writes follows the batch, and every row is rewritten once a level, so with n batches log(n) times in all; a
table is read as the union of at most FAN - 1 runs a level, merged by its key. A merged run is sorted by the key, in files
as large as Spark's own sort makes them, so look-ups by key are pruned and files split as a table grows.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from .pointer import Pointer

#: Runs of a level that are merged into one of the next.
FAN = 8


class Runs:
    """Tables by name in a folder. A content, which the caller's pointer keeps, lists each table's runs as [level, name,
    files]; nothing counts that no pointer lists, so a batch that failed leaves nothing behind but files to vacuum()."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, list[str]], merge: Callable[[str, DataFrame], DataFrame], fan: int = FAN):
        self.spark, self.path, self.keys, self.merge, self.fan = spark, path, keys, merge, fan
        self.pointer = Pointer(spark, path)

    def _at(self, table: str, run: str) -> str:
        return f"{self.path}/{table}/{run}"

    def _write(self, table: str, run: str, rows: DataFrame) -> int:
        rows.write.mode("overwrite").parquet(self._at(table, run))
        return sum(n.startswith("part-") for n in self.pointer.names(self._at(table, run)))

    def _read(self, table: str, runs: list[list]) -> DataFrame:
        return self.spark.read.parquet(*[self._at(table, name) for _, name, _ in runs])

    def read(self, table: str, content: dict) -> DataFrame | None:
        """The table, a row a key; None before its first batch."""
        runs = content.get("runs", {}).get(table, [])
        if not runs:
            return None
        rows = self._read(table, runs)
        return rows if len(runs) == 1 else self.merge(table, rows)

    def _add(self, table: str, rows: DataFrame, runs: list[list], batch: int) -> tuple[list[list], int, int]:
        """The table's runs with one more, and the files that were written and read for it."""
        files = self._write(table, f"{batch}-0", rows)
        runs, written, read, level = [*runs, [0, f"{batch}-0", files]], files, 0, 0
        while len(tier := [r for r in runs if r[0] == level]) >= self.fan:
            name = f"{batch}-{level + 1}"
            files = self._write(table, name, self.merge(table, self._read(table, tier)).sort(*self.keys[table]))
            runs = [r for r in runs if r[0] != level] + [[level + 1, name, files]]
            written, read, level = written + files, read + sum(r[2] for r in tier), level + 1
        return runs, written, read

    def add(self, new: dict[str, DataFrame], batch: int, content: dict) -> dict:
        """content after a batch that adds these rows; small jobs, side by side."""
        runs = content.get("runs", {})
        with ThreadPoolExecutor(len(new)) as pool:
            done = dict(zip(new, pool.map(lambda t: self._add(t, new[t], runs.get(t, []), batch), new), strict=True))
        return content | {"runs": runs | {t: d[0] for t, d in done.items()}, "files": {"written": sum(d[1] for d in done.values()), "read": sum(d[2] for d in done.values())}}

    def vacuum(self, content: dict) -> list[str]:
        """Deletes runs that the content does not list, once no reader of an earlier one is left; returns their names."""
        gone = []
        for table, runs in content.get("runs", {}).items():
            for name in set(self.pointer.names(f"{self.path}/{table}")) - {r[1] for r in runs}:
                self.pointer.delete(self._at(table, name))
                gone.append(f"{table}/{name}")
        return sorted(gone)
