"""Trailing usage per physical model.

The window before an instant q is the whole seconds in between, the part of q's own second
before q, and what is left of the second sixty seconds earlier. Every window below therefore
covers one (model, second) or one (model, minute), never a model's whole history, and equal
instants are added up before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog.gateway import USAGE_WINDOW_SECONDS

_SECOND = 1_000_000


def usage_at(points: DataFrame, usage: DataFrame, seconds: int = USAGE_WINDOW_SECONDS) -> DataFrame:
    """(model, at) -> tpm, rpm over usage strictly before ``at`` and after ``at - seconds``.

    ``points`` holds (model, at) with ``at`` in microseconds; ``usage`` (ts, model, tokens).
    """
    added = usage.groupBy("model", F.unix_micros("ts").alias("at")).agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")
    )
    zero = F.lit(0).cast("long")
    span = seconds * _SECOND
    arrivals = F.struct(
        F.col("at").alias("at"), F.col("tokens").alias("tok_in"), F.col("n").alias("n_in"),
        zero.alias("tok_out"), zero.alias("n_out"),
    )
    expiries = F.struct(
        (F.col("at") + span).alias("at"), zero.alias("tok_in"), zero.alias("n_in"),
        F.col("tokens").alias("tok_out"), F.col("n").alias("n_out"),
    )
    marks = added.select("model", F.explode(F.array(arrivals, expiries)).alias("m")).select(
        "model", "m.*", F.lit(False).alias("asked")
    )
    asked = points.select("model", "at").distinct().select(
        "model", "at", zero.alias("tok_in"), zero.alias("n_in"), zero.alias("tok_out"),
        zero.alias("n_out"), F.lit(True).alias("asked"),
    )
    second = F.col("at") - F.pmod("at", F.lit(_SECOND))
    line = marks.unionByName(asked).withColumn("second", second)
    own = Window.partitionBy("model", "second").orderBy("at")
    before = own.rangeBetween(Window.unboundedPreceding, -1)
    upto = own.rangeBetween(Window.unboundedPreceding, 0)

    def part(name):
        arrived = F.coalesce(F.sum(f"{name}_in").over(before), zero)
        return arrived - F.coalesce(F.sum(f"{name}_out").over(upto), zero)

    partial = line.select(
        "model", "at", "second", "asked", part("tok").alias("tok_part"), part("n").alias("n_part")
    ).filter("asked").drop("asked")

    base = _whole_seconds(line, seconds)
    out = partial.join(base, ["model", "second"], "left")
    return out.select(
        "model", "at",
        (F.col("tok_part") + F.coalesce("tok_base", zero)).alias("tpm"),
        (F.col("n_part") + F.coalesce("n_base", zero)).alias("rpm"),
    )


def _whole_seconds(line: DataFrame, seconds: int) -> DataFrame:
    """Usage of the ``seconds`` whole seconds before each second that is asked for.

    Seconds are named by their first microsecond. One counts for its own chunk of that length
    and for the next one, so each window sees at most two chunks.
    """
    per_second = line.groupBy("model", "second").agg(
        F.sum("tok_in").alias("tok"), F.sum("n_in").alias("n"), F.max("asked").alias("asked")
    )
    span = seconds * _SECOND
    chunk = F.col("second") - F.pmod("second", F.lit(span))
    copies = per_second.withColumn(
        "c", F.explode(F.array(F.struct(chunk.alias("chunk"), F.lit(True).alias("home")),
                               F.struct((chunk + span).alias("chunk"), F.lit(False).alias("home"))))
    ).select("model", "second", "tok", "n", "asked", "c.*")
    w = Window.partitionBy("model", "chunk").orderBy("second").rangeBetween(-span, -1)
    return (
        copies.withColumns({"tok_base": F.sum("tok").over(w), "n_base": F.sum("n").over(w)})
        .filter("asked AND home")
        .select("model", "second", "tok_base", "n_base")
    )


def trailing_usage(usage: DataFrame, seconds: int = USAGE_WINDOW_SECONDS) -> DataFrame:
    """Each usage row with the usage of its model just before it."""
    rows = usage.withColumn("at", F.unix_micros("ts"))
    return rows.join(usage_at(rows, usage, seconds), ["model", "at"]).drop("at")


def request_usage(requests: DataFrame, chains: DataFrame, usage: DataFrame) -> DataFrame:
    """Requests with ``usage``: map from each model of their search chain to (tpm, rpm).

    The map holds at most one entry per endpoint of the catalogue.
    """
    models = chains.select("cluster", F.array_distinct(F.col("chain.model")).alias("models"))
    pairs = (
        requests.select("request_id", "cluster", F.unix_micros("ts").alias("at"))
        .join(models, "cluster")
        .select("request_id", "at", F.explode("models").alias("model"))
    )
    values = pairs.join(usage_at(pairs, usage), ["model", "at"])
    maps = values.groupBy("request_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct("model", F.struct("tpm", "rpm")))
        ).alias("usage")
    )
    return requests.join(maps, "request_id", "left")
