"""What each stage of a retrieval did, observed while it runs: rows in and out and the range of its scores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

SCHEMA = "place int, stage string, rows_in long, rows_out long, dropped long, least double, most double"


class Trace:
    """Hand one to a pipeline, run its result once, then read `rows()`.

    A stage's metrics are counted in the job that runs it; nothing is run for them alone.
    """

    def __init__(self) -> None:
        self.stages: list[tuple[str, tuple[str, ...], Observation]] = []

    def stage(self, df: DataFrame, name: str, after: tuple[str, ...] | None = None) -> DataFrame:
        """`df`, which has a score, observed under a name; `after` are the stages that it gets its rows from, if not the one before."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        before = after if after is not None else (self.stages[-1][0],) if self.stages else ()
        self.stages.append((name, before, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.min("score").alias("least"), F.max("score").alias("most"))

    def rows(self) -> list[tuple]:
        """(place, stage, rows_in, rows_out, dropped, least, most) of each stage, in order; a stage without any before it has no rows in."""
        out, counts = [], {}
        for place, (name, before, seen) in enumerate(self.stages, 1):
            m = seen.get
            counts[name] = m["rows"]
            came = sum(counts[b] for b in before)
            out.append((place, name, came, m["rows"], max(came - m["rows"], 0), m["least"], m["most"]))
        return out


def staged(trace: Trace | None, df: DataFrame, name: str, after: tuple[str, ...] | None = None) -> DataFrame:
    return df if trace is None else trace.stage(df, name, after)
