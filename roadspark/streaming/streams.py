"""Incremental forms: flagged runs over an unbounded stream of vertices, and a ledger that is resumed.

The windowed counts are an extension of this engine; surveys themselves come as files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each kind in tumbling windows of event time (ts), late ones up to a bound."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def _runs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    begin, last, count = state.get if state.exists else (None, None, 0)
    for rows in batches:  # one Arrow batch at a time, however many vertices a key has
        out = []
        rows = rows.sort_values("seq")
        for seq, flag in zip(rows["seq"], rows["flag"]):
            if flag:
                begin, last, count = (int(seq) if count == 0 else begin), int(seq), count + 1
            else:
                if count > 1:
                    out.append((key[0], begin, last))
                begin, last, count = None, None, 0
        yield pd.DataFrame(out, columns=["line_id", "start", "stop"])
    state.update((begin, last, count))


def closed_runs(vertices: DataFrame) -> DataFrame:
    """Maximal runs of two or more true flags (line_id, seq, flag), each given out once a false flag ends it.

    The state of a line is one open run, however long the line.  Vertices of a line must come in order.
    """
    return vertices.select("line_id", "seq", "flag").groupBy("line_id").applyInPandasWithState(_runs, "line_id long, start long, stop long", "start long, last long, count long", "append", GroupStateTimeout.NoTimeout)


def unfinished(candidates: DataFrame, ledger: DataFrame, key: str = "building") -> DataFrame:
    """Candidates that the ledger has no row for: what a resumed run still has to do."""
    return candidates.join(ledger.select(key), key, "left_anti")


def append_to_ledger(rows: DataFrame, path: str, key: str = "building"):
    """A streaming query that adds each micro-batch's new keys to a Parquet ledger."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.schema(batch.schema).parquet(path)
        except Exception as e:  # the first batch finds no ledger
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        fresh = batch.dropDuplicates([key])
        (unfinished(fresh, known, key) if known is not None else fresh).write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(add)
