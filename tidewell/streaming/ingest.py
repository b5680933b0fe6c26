"""A table of versions by id that a stream keeps up to date, batch by batch, exactly once.

Each batch is one segment with the last version of every id in it; the segment log is the
ledger of batches and the pointer to what is current.  A batch that runs twice, because the
stream failed after writing it or before its own checkpoint did, changes nothing the second
time.  Readers see the newest version of each id over all live segments, whatever order they
came in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.segments import SegmentLog, union_of


class KeptTable:
    """Rows by `key`, newest by `order`, of equal ones by batch; `schema` is the rows' own."""

    def __init__(self, spark: SparkSession, root: str, schema: object, key: str = "id", order: str = "seq", most_segments: int = 16) -> None:
        self.spark, self.log, self.key, self.order, self.most = spark, SegmentLog(spark, root), key, order, most_segments
        names = spark.createDataFrame([], schema)
        self.schema = names.withColumn("__batch", F.lit(0).cast("long")).schema

    def _newest(self, folders: list[str]) -> DataFrame:
        every = union_of(self.spark, folders, self.schema)
        rest = [c for c in every.columns if c != self.key]
        newest = every.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(self.order, "__batch")).alias("r"))
        return newest.select(self.key, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*every.columns)

    def current(self) -> DataFrame:
        return self._newest(self.log.live()).drop("__batch")

    def write(self, batch: DataFrame, number: int) -> bool:
        """Apply a batch; False if it is in the ledger."""
        done = self.log.batches()
        if done and number <= done[-1]:
            return False
        rest = [c for c in batch.columns if c != self.key]
        last = batch.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.col(self.order)).alias("r")).select(self.key, *(F.col(f"r.{c}").alias(c) for c in rest))
        folder = self.log.new_segment(number)
        last.withColumn("__batch", F.lit(number).cast("long")).select(*self.schema.names).write.parquet(folder)
        live = [*self.log.live(), folder]
        if len(live) > self.most:
            merged = self.log.new_segment(number)
            self._newest(live).write.parquet(merged)
            live = [merged]
        return self.log.commit(number, live)


def ingest(stream: DataFrame, table: KeptTable, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda d: d, before_commit: Callable[[int], None] | None = None) -> None:
    """Drive a stream into the table over all that is there; `change` prepares a batch.

    `before_commit` is called with each batch's number when it is written and committed but the stream has not noted it
    yet; if it raises, the stream stops there, and a run with the same checkpoint goes on.
    """

    def write(batch: DataFrame, number: int) -> None:
        table.write(change(batch), number)
        if before_commit:
            before_commit(number)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
