"""Quota, batch and top-up plans of a labelled data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import factory as f
from ..catalog import pii
from ..functions.draws import draw, pick
from ..functions.scale import numbered, running_totals


def label_configs(labels: list[str], definitions: dict | None = None) -> list[tuple[str, str]]:
    """(label, pattern): given definitions first, then the catalogue, else no pattern."""
    given = {k.strip().lower(): v for k, v in (definitions or {}).items()}
    return [(x, given.get(x.lower(), pii.PATTERNS.get(x.lower(), ""))) for x in labels]


def assign_slots(
    df: DataFrame,
    slot: str,
    n: int,
    configs: list[tuple[str, str]],
    ratio: float = f.HARD_NEGATIVE_SHARE,
    domains: list[str] | None = None,
    seed: int = 0,
) -> DataFrame:
    """Give rows numbered 0..n-1 their label, pattern, sign and domain by arithmetic alone.

    Labels share what neutral slots leave over evenly, a fixed part of each share being hard
    negatives; left-over slots go round the labels with a drawn sign.
    """
    i = F.col(slot)
    domain = pick(domains or f.TRAINING_DOMAINS, i, seed, "domain")
    if not configs:
        return df.select(
            "*", F.lit("neutral").alias("part"), F.lit(f.NEUTRAL_LABEL).alias("label"),
            F.lit("").alias("pattern"), F.lit(False).alias("is_hard_negative"), domain.alias("domain"),
        )
    rest = n - max(1, int(n * f.NEUTRAL_SHARE))
    share = rest // len(configs)
    negatives = int(share * ratio)
    quota, left_over = i < share * len(configs), i < rest
    config = F.when(quota, F.floor(i / F.lit(max(share, 1)))).otherwise(
        F.pmod(i - share * len(configs), F.lit(len(configs)))
    )
    at = (config + 1).cast("int")
    labels = F.array(*[F.lit(c[0]) for c in configs])
    patterns = F.array(*[F.lit(c[1]) for c in configs])
    drawn = draw(1_000_000, i, seed, "sign") < int(ratio * 1_000_000)
    return df.select(
        "*",
        F.when(quota, "quota").when(left_over, "remainder").otherwise("neutral").alias("part"),
        F.when(left_over, F.element_at(labels, at)).otherwise(f.NEUTRAL_LABEL).alias("label"),
        F.when(left_over, F.element_at(patterns, at)).otherwise("").alias("pattern"),
        F.when(quota, F.pmod(i, F.lit(max(share, 1))) >= share - negatives)
        .when(left_over, drawn)
        .otherwise(F.lit(False))
        .alias("is_hard_negative"),
        domain.alias("domain"),
    )


def plan_slots(spark: SparkSession, n: int, configs: list[tuple[str, str]], **options) -> DataFrame:
    return assign_slots(spark.range(n).withColumnRenamed("id", "slot"), "slot", n, configs, **options)


def batched_slots(slots: DataFrame, batch_size: int = f.BATCH_SIZE) -> DataFrame:
    """Add batch (number of the chunk inside its group).

    A group of equal (label, sign) may hold most slots, so rows are numbered slice by slice.
    """
    ranked = numbered(slots, ["label", "pattern", "is_hard_negative"], ["slot"], "_rn")
    return ranked.withColumn("batch", F.floor((F.col("_rn") - 1) / F.lit(batch_size))).drop("_rn")


def plan_batches(slots: DataFrame, batch_size: int = f.BATCH_SIZE) -> DataFrame:
    """One row per batch; it takes the domain of its first slot."""
    return (
        batched_slots(slots, batch_size)
        .groupBy("label", "pattern", "is_hard_negative", "batch")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min("slot").alias("first_slot"),
            F.min_by("domain", "slot").alias("domain"),
        )
    )


#: Batches that one task of a top-up plan makes.
TOPUP_RUN = 10_000


def plan_topup(
    requested: DataFrame,
    produced: DataFrame,
    configs: list[tuple[str, str]],
    batch_size: int = f.BATCH_SIZE,
    ratio: float = f.HARD_NEGATIVE_SHARE,
    domains: list[str] | None = None,
    seed: int = 0,
) -> DataFrame:
    """One extra round of batches for what is missing, cycling the labels.

    ``requested`` and ``produced`` are rows, one per sample; what is missing is the difference of their numbers, summed in
    the plan itself: nothing is counted on the driver, and runs of batches are made by as many tasks as it takes.
    """
    both = requested.select(F.lit(1).cast("long").alias("n")).unionByName(produced.select(F.lit(-1).cast("long").alias("n")))
    missing = both.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(0)).cast("long").alias("missing"))
    batches = missing.select("missing", F.ceil(F.col("missing") / batch_size).cast("long").alias("batches")).where("batches > 0")
    runs = batches.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1, F.lit(TOPUP_RUN).cast("long"))).alias("first"))
    last = F.least(F.col("first") + TOPUP_RUN, F.col("batches")) - 1
    i = F.col("batch")
    cycle = configs or [(f.NEUTRAL_LABEL, "")]
    at = (F.pmod(i, F.lit(len(cycle))) + 1).cast("int")
    negative = draw(1_000_000, i, seed, "topup") < int(ratio * 1_000_000)
    drawn = pick(domains or f.TRAINING_DOMAINS, i, seed, "topup")
    formats = F.array(*[F.lit(pii.DATA_FORMATS.get(c[0].lower())).cast("string") for c in cycle])
    return runs.repartition("first").select("missing", F.explode(F.sequence("first", last)).alias("batch")).select(
        "batch",
        F.element_at(F.array(*[F.lit(c[0]) for c in cycle]), at).alias("label"),
        F.element_at(F.array(*[F.lit(c[1]) for c in cycle]), at).alias("pattern"),
        F.least(F.col("missing") - i * batch_size, F.lit(batch_size)).alias("count"),
        (negative if configs else F.lit(False)).alias("is_hard_negative"),
        F.coalesce(F.element_at(formats, at), drawn).alias("domain"),
    )


def progress(batches: DataFrame) -> DataFrame:
    """Running attempts, samples and near-duplicates in batch order.

    ``batches``: batch_id, count, samples, near_dups.
    """
    sums = {
        "total_attempts": F.col("count").cast("long"),
        "successful": F.col("samples").cast("long"),
        "near_dup_count": F.col("near_dups").cast("long"),
    }
    one = batches.withColumn("_all", F.lit(0))
    return running_totals(one, ["_all"], ["batch_id"], sums).drop("_all")
