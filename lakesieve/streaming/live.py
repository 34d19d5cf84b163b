"""Continuous forms: scan of arriving texts, live states of slots, findings in time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakesieve.operators import scan


def scan_stream(store: DataFrame, items: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, min_overlap: int = scan.MIN_OVERLAP) -> StreamingQuery:
    """Scans each micro-batch of (store_file, text) against the manifest; texts are independent, so no state is kept."""

    def each(batch: DataFrame, epoch: int) -> None:
        sink(scan.findings(batch, items, min_overlap), epoch)

    return store.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def live_states(log: DataFrame) -> DataFrame:
    """Streaming (slot, seq, kind, status) -> the state of each slot so far; for update mode. Holds one record a slot."""
    last = F.max_by(F.struct("kind", "status"), F.when(F.col("kind") != "trial-created", F.col("seq")).otherwise(-1))
    state = F.when(F.col("r.kind") == "trial-created", "created").when(F.col("r.kind") == "closed", F.col("r.status")).otherwise(F.col("r.kind"))
    return log.groupBy("slot").agg(last.alias("r")).select("slot", state.alias("state"))


def windowed_findings(hits: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Streaming (ts, severity) -> counts by window and severity; events later than `late` are left out, which bounds the state."""
    return hits.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "severity").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "severity", "n")
