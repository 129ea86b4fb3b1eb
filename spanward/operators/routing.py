"""Endpoint selection.

A request carries its whole search chain (a bounded array of the catalogue), so
filtering, ranking and escalation are array expressions on one row: no shuffle, no sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import gateway as g
from ..functions.spans import flatten, lookup
from ..sources.config import search_chains


def _tier_number(tier: Column) -> Column:
    return lookup(tier, g.TIER_NUMBER, F.lit(g.UNKNOWN_TIER))


def mismatch(wanted: Column, offered: Column) -> Column:
    clash = ((wanted == "high") & (offered == "low")) | ((wanted == "low") & (offered == "high"))
    penalty = F.when(clash, F.lit(g.TIER_CLASH_PENALTY)).otherwise(F.lit(0.0))
    return F.abs(_tier_number(wanted) - _tier_number(offered)) + penalty


def with_candidates(requests: DataFrame, endpoints: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """Add ``candidates``: the chain with usage, first failed limit and ranking values."""
    live = "usage" in requests.columns
    chains = search_chains(endpoints, fallbacks)
    joined = requests.join(chains, "cluster", "left")
    context, wanted = F.col("required_context"), F.col("complexity")
    zero = F.lit(0).cast("long")

    def used(e, field):
        if not live:
            return zero
        return F.coalesce(F.try_element_at("usage", e["model"])[field], zero)

    def candidate(e):
        tpm, rpm = used(e, "tpm"), used(e, "rpm")
        reason = (
            F.when(context > e["tpr"], "tpr")
            .when(tpm + context > e["tpm"], "tpm")
            .when(rpm + 1 > e["rpm"], "rpm")
        )
        return F.struct(
            e["cluster_rank"].alias("cluster_rank"),
            mismatch(wanted, e["complexity_tier"]).alias("mismatch"),
            e["cost_per_million"].alias("cost"),
            F.greatest(tpm / e["tpm"], rpm / e["rpm"]).alias("util"),
            e["ord"].alias("ord"),
            e["cluster"].alias("cluster"),
            e["model"].alias("model"),
            e["tpr"].alias("tpr"),
            tpm.alias("tpm_used"),
            rpm.alias("rpm_used"),
            reason.alias("reject_reason"),
        )

    return joined.withColumn("candidates", F.transform("chain", candidate)).drop("chain")


def candidates(requests: DataFrame, endpoints: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """One row per request and endpoint of its chain, with the first limit it fails."""
    rows = with_candidates(requests, endpoints, fallbacks)
    return flatten(rows, "candidates", "c", "request_id", "required_context", "complexity").select(
        "request_id", "required_context", "complexity", F.col("c.cluster").alias("searched"),
        "c.cluster_rank", "c.ord", "c.model", "c.tpm_used", "c.rpm_used", "c.reject_reason",
    )


def route(requests: DataFrame, endpoints: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """Add model, selected_cluster, is_fallback, over_limit and visited_rank.

    The first cluster of the chain with a fitting endpoint wins; inside it the least tier
    mismatch, then price, then utilisation, then configuration order. If nothing fits, the
    endpoints with the widest context compete, backup cluster first. A request without any
    endpoint keeps a null model.
    """
    rows = with_candidates(requests, endpoints, fallbacks)
    fitting = F.array_min(F.filter("candidates", lambda c: c["reject_reason"].isNull()))
    widest = F.array_max(F.transform("candidates", lambda c: c["tpr"]))
    relaxed = F.array_min(
        F.transform(
            F.filter("candidates", lambda c: c["tpr"] == widest),
            lambda c: F.struct(
                (c["cluster"] != g.BACKUP_CLUSTER).cast("int").alias("after_backup"),
                c["mismatch"].alias("mismatch"),
                c["cost"].alias("cost"),
                c["cluster_rank"].alias("cluster_rank"),
                c["ord"].alias("ord"),
                c["cluster"].alias("cluster"),
                c["model"].alias("model"),
            ),
        )
    )
    rows = rows.withColumns({"_fit": fitting, "_wide": relaxed})
    chosen = F.coalesce(F.col("_fit.cluster"), F.col("_wide.cluster"))
    return rows.withColumns(
        {
            "ord": F.coalesce("_fit.ord", "_wide.ord"),
            "model": F.coalesce("_fit.model", "_wide.model"),
            "selected_cluster": chosen,
            "is_fallback": F.coalesce(chosen != F.col("cluster"), F.lit(False)),
            "over_limit": F.col("_fit").isNull() & F.col("_wide").isNotNull(),
            "visited_rank": F.coalesce(
                F.col("_fit.cluster_rank"), F.array_max(F.transform("candidates", lambda c: c["cluster_rank"]))
            ),
        }
    ).drop("_fit", "_wide")


def escalated(routed: DataFrame) -> DataFrame:
    """Requests that no endpoint could take within its limits."""
    return routed.filter("over_limit")
