"""Sliding usage per model, rolling counters and the newest events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import gateway as g
from ..session import fresh_path
from .feeds import run_available, totals


def stream_usage(usage: DataFrame, slide: str = "5 seconds") -> DataFrame:
    """Tokens and requests per model over sliding minutes, after the last batch.

    Windows of one instant differ only in their start, so a record adds to twelve small sums. Sums need no order:
    nothing is late and nothing expires. The exact value at each request stays a batch job.
    """
    window = F.window("ts", f"{g.USAGE_WINDOW_SECONDS} seconds", slide)
    rows = usage.select(window.alias("w"), "model", "tokens").select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "model", "tokens"
    )
    return totals(rows, ["window_start", "window_end", "model"], {"tpm": "sum(tokens)", "rpm": "count(1)"})


def stream_counters(events: DataFrame, kind: str, every: str = "1 hour") -> DataFrame:
    """Counts per kind of event and hour, after the last batch; they never expire."""
    rows = events.select(F.window("ts", every).alias("w"), kind).select(F.col("w.start").alias("window_start"), kind)
    return totals(rows, ["window_start", kind], {"n": "count(1)"})


def stream_latest(events: DataFrame, id_col: str, n: int = g.LATEST_EVENTS) -> DataFrame:
    """The newest ``n`` events after the last batch.

    Each batch merges its own newest rows with those kept so far, at most 2n rows; every state is
    a folder of its own, so that a repeated batch starts from the same predecessor.
    """
    spark = events.sparkSession
    path = fresh_path(spark, "latest")
    order = [F.desc("ts"), F.desc(id_col)]
    done: list[int] = []

    def sink(batch: DataFrame, number: int) -> None:
        kept = batch.orderBy(*order).limit(n)
        earlier = [b for b in done if b < number]
        if earlier:
            before = spark.read.schema(events.schema).parquet(f"{path}/{earlier[-1]:09d}")
            kept = kept.unionByName(before).orderBy(*order).limit(n)
        kept.write.mode("overwrite").parquet(f"{path}/{number:09d}")
        if number not in done:
            done.append(number)

    run_available(events, "append", sink)
    if not done:
        return spark.createDataFrame([], events.schema)
    return spark.read.schema(events.schema).parquet(f"{path}/{done[-1]:09d}")
