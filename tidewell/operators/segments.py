"""Tables kept as a log of immutable segments, for what grows by batches and is read between them.

A batch writes its own rows as a new folder (a segment) and then commits by one small file
that names all live segments; readers take the newest commit.  What is written before a
crash and never committed is not read, and a batch whose number is committed already is
not applied again.  One writer at a time, as a streaming query is.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class SegmentLog:
    """`root`/log has a JSON file for each commit, named by its batch; `root`/segments the folders."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("log").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str) -> object:
        return self._hadoop.Path("/".join((self.root, *parts)))

    def batches(self) -> list[int]:
        """Numbers of the committed batches, in order."""
        if not self._fs.exists(self._path("log")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("log"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def live(self) -> list[str]:
        """Folders of the newest commit's segments, oldest first."""
        done = self.batches()
        if not done:
            return []
        text = self.spark.read.text(f"{self.root}/log/{done[-1]:020d}.json", wholetext=True).first()[0]
        return [f"{self.root}/segments/{name}" for name in json.loads(text)["segments"]]

    def new_segment(self, batch: int) -> str:
        """A folder of its own for each attempt of a batch."""
        return f"{self.root}/segments/{batch:020d}-{uuid.uuid4().hex}"

    def commit(self, batch: int, folders: list[str]) -> bool:
        """Make `folders` the live segments; False, and nothing changes, if the batch is committed or a later one is."""
        done = self.batches()
        if done and batch <= done[-1]:
            return False
        body = json.dumps({"batch": batch, "segments": [f.rsplit("/", 1)[-1] for f in folders]})
        draft = self._path("log", f".{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        try:
            out.write(bytearray(body, "utf-8"))
        finally:
            out.close()
        return bool(self._fs.rename(draft, self._path("log", f"{batch:020d}.json")))

    def vacuum(self) -> int:
        """Delete segments that no commit but older ones names; how many.  Only while nobody reads an older commit."""
        live = {f.rsplit("/", 1)[-1] for f in self.live()}
        dead = [f.getPath() for f in self._fs.listStatus(self._path("segments")) if f.getPath().getName() not in live] if self._fs.exists(self._path("segments")) else []
        for path in dead:
            self._fs.delete(path, True)
        return len(dead)


def union_of(spark: SparkSession, folders: list[str], schema: object) -> DataFrame:
    """All rows of the folders, which may be none."""
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
