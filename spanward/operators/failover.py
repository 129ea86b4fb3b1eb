"""Failover over a table of attempt outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import flatten


def resolve_failover(routed: DataFrame, attempts: DataFrame) -> DataFrame:
    """First attempt that worked, in failover order; null answered_by where none did.

    Order: the selected endpoint, the others of its cluster, then the first endpoint of every
    other cluster of the chain. Attempts outside that order do not count.
    """
    order = routed.select(
        "request_id",
        F.filter(
            F.concat(
                F.array(
                    F.struct(F.lit(0).alias("step"), F.col("selected_cluster").alias("cluster"), "model")
                ),
                F.transform(
                    F.filter(
                        "candidates",
                        lambda c: (c["cluster"] == F.col("selected_cluster")) & (c["model"] != F.col("model")),
                    ),
                    lambda c, i: F.struct((i + 1).alias("step"), c["cluster"].alias("cluster"), c["model"].alias("model")),
                ),
                F.transform(
                    F.filter(
                        "candidates",
                        lambda c: (c["cluster"] != F.col("selected_cluster"))
                        & (
                            c["ord"]
                            == F.array_min(
                                F.transform(
                                    F.filter("candidates", lambda d: d["cluster"] == c["cluster"]),
                                    lambda d: d["ord"],
                                )
                            )
                        ),
                    ),
                    lambda c, i: F.struct((i + 10_000).alias("step"), c["cluster"].alias("cluster"), c["model"].alias("model")),
                ),
            ),
            lambda s: s["model"].isNotNull(),
        ).alias("steps"),
    )
    steps = flatten(order, "steps", "s", "request_id").select("request_id", "s.*")
    worked = (
        attempts.filter("ok").select("request_id", "cluster", "model")
        .join(steps, ["request_id", "cluster", "model"])
        .groupBy("request_id")
        .agg(F.min(F.struct("step", "cluster", "model")).alias("first"))
    )
    return routed.join(worked, "request_id", "left").select(
        "request_id",
        F.col("model").alias("selected_model"),
        F.col("first.model").alias("answered_by"),
        F.col("first.cluster").alias("answered_cluster"),
        F.when(F.col("first").isNull(), "failed").otherwise("success").alias("status"),
        F.coalesce(F.col("first.step") > 0, F.lit(False)).alias("failed_over"),
    )
