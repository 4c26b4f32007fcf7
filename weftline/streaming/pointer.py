"""Which tables a state is made of: a small file for each batch, written after the batch's tables."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a local one, which only a local master can use."""
    sc = spark.sparkContext
    parent = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if parent is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix="weftline-")
    return f"{parent.rstrip('/')}/weftline-{uuid.uuid4().hex}"


class Pointer:
    """(batch, content) of the last batch that a folder's state holds. A pointer is written to one side and then renamed,
    so a batch is in the state whole or not at all, and any new object or driver finds it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, f"{path}/pointers"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self) -> tuple[int, dict]:
        """The newest pointer; (-1, {}) before the first batch."""
        done = [int(n.removesuffix(".json")) for n in self.names(self.folder) if n.endswith(".json") and not n.startswith("_")]
        if not done:
            return -1, {}
        return max(done), self._load(f"{max(done)}.json")

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read_all(self) -> dict[str, dict]:
        """Every pointer by its name."""
        return {n.removesuffix(".json"): self._load(n) for n in self.names(self.folder) if n.endswith(".json") and not n.startswith("_")}

    def remove(self, name: str) -> None:
        self.delete(f"{self.folder}/{name}.json")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def write(self, batch: int, content: dict, keep: int = 16) -> None:
        """Moves on to a batch; of the pointers before it the last ones are kept."""
        self.write_named(str(batch), content)
        for n in self.names(self.folder):
            if n.endswith(".json") and not n.startswith("_") and int(n.removesuffix(".json")) <= batch - keep:
                self.remove(n.removesuffix(".json"))

    def write_named(self, batch: str, content: dict) -> None:
        aside = self._path(f"{self.folder}/_{batch}-{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if not self._fs.rename(aside, self._path(f"{self.folder}/{batch}.json")):
            raise OSError(f"batch {batch} is in {self.folder} already")
