"""Change detection over file events: batch forms, and the same with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_feed(events: DataFrame) -> DataFrame:
    """(path, mtime, change) of events(path, mtime, order_, hash): added at first sight, changed when the hash differs from the one before."""
    before = Window.partitionBy("path").orderBy("mtime", "order_")
    rows = events.withColumn("_b", F.lag("hash").over(before)).withColumn("_n", F.row_number().over(before))
    return rows.select("path", "mtime", "order_", F.when(F.col("_n") == 1, "added").when(~F.col("hash").eqNullSafe(F.col("_b")), "changed").otherwise("same").alias("change"))


def debounce(events: DataFrame, gap: str) -> DataFrame:
    """(path, start, end, n, last): a row per burst of events(path, mtime, order_, kind) with less than `gap` between; of its changes only the last counts."""
    sessions = events.groupBy("path", F.session_window("mtime", gap).alias("w"))
    return sessions.agg(F.count(F.lit(1)).alias("n"), F.max("mtime").alias("end"), F.max_by("kind", F.struct("mtime", "order_")).alias("last")).select("path", F.col("w.start").alias("start"), "end", "n", "last")


def debounce_stream(events: DataFrame, gap: str, late: str) -> DataFrame:
    """The same of a stream; bursts are given out once the watermark has passed them."""
    return debounce(events.withWatermark("mtime", late), gap)


def rebuild_on_change(changes: DataFrame, rebuild, flag, code=("click", "view")):
    """Writes a stream of changes(kind): a batch of code only calls rebuild(batch), any other flag(batch)."""

    def act(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        (flag if not batch.where(~F.col("kind").isin(list(code))).isEmpty() else rebuild)(batch)

    return changes.writeStream.foreachBatch(act)
