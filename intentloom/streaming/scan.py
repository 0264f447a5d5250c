"""Findings kept up to date as source files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scan import MARKER, scan


def scan_arrivals(arrivals: DataFrame, globs: DataFrame, out: str, checkpoint: str, marker: str = MARKER, after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Scan each micro-batch of a stream (file, text) and write nodes, clauses and findings below ``out``, one folder a batch.

    A batch that is run again replaces its own folders, so nothing counts twice. A file that arrives again is scanned
    again; the newest batch's rows are those that hold (``latest``).
    """

    def each(batch: DataFrame, number: int) -> None:
        for name, df in zip(("nodes", "clauses", "findings"), scan(batch, globs, marker)):
            df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{name}/{number:09d}")
        if after:
            after(batch)

    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(df: DataFrame) -> DataFrame:
    """Of rows (file, batch, …) each file's newest batch."""
    newest = df.groupBy("file").agg(F.max("batch").alias("batch"))
    return df.join(newest, ["file", "batch"], "left_semi")
