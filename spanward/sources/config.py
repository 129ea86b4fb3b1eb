"""Endpoint catalogue, fallback chains and the search order they imply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import gateway
from ..schemas import ENDPOINTS, FALLBACKS
from ..session import small_table

_FIELDS = ENDPOINTS.fieldNames()


def tier_of(cost):
    return (
        F.when(cost >= gateway.HIGH_TIER_COST, "high")
        .when(cost >= gateway.MEDIUM_TIER_COST, "medium")
        .otherwise("low")
    )


def load_endpoints(spark: SparkSession, rows=None, path: str | None = None) -> DataFrame:
    """Endpoints in configuration order, from rows, or a JSON-lines file; defaults filled in.

    The tier follows from the price where it is not given.
    """
    if path is not None:
        given = spark.read.schema(ENDPOINTS).json(path)
    else:
        rows = gateway.ENDPOINTS if rows is None else rows
        given = small_table(spark, [(i + 1, *r) for i, r in enumerate(rows)], ENDPOINTS)
    filled = given.fillna(
        {
            "rpm": gateway.DEFAULT_RPM,
            "tpm": gateway.DEFAULT_TPM,
            "tpr": gateway.DEFAULT_TPR,
            "cost_per_million": gateway.DEFAULT_COST,
        }
    )
    return filled.withColumn(
        "complexity_tier", F.coalesce("complexity_tier", tier_of(F.col("cost_per_million")))
    )


def load_fallbacks(spark: SparkSession, chains: dict | None = None) -> DataFrame:
    chains = gateway.FALLBACKS if chains is None else chains
    rows = [(c, i + 1, f) for c, names in chains.items() for i, f in enumerate(names)]
    return small_table(spark, rows, FALLBACKS)


def search_chains(endpoints: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """(cluster, chain): endpoints in the order searched, own cluster first.

    One row per cluster that can be asked for; bounded by the endpoint catalogue.
    """
    own = endpoints.select("cluster").union(fallbacks.select("cluster")).distinct()
    steps = own.select("cluster", F.lit(0).alias("rank"), F.col("cluster").alias("searched")).union(
        fallbacks.select("cluster", "rank", F.col("fallback").alias("searched"))
    )
    eps = endpoints.withColumnRenamed("cluster", "searched")
    entry = F.struct(
        F.col("rank").alias("cluster_rank"),
        "ord",
        F.col("searched").alias("cluster"),
        "model", "rpm", "tpm", "tpr", "cost_per_million", "complexity_tier",
    )
    return (
        steps.join(eps, "searched")
        .groupBy("cluster")
        .agg(F.sort_array(F.collect_list(entry)).alias("chain"))
    )
