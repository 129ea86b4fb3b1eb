"""Validation, reports and distributions of labelled samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog.factory import UNKNOWN_DOMAIN
from ..functions.regex import compiles, full_pattern
from ..functions.spans import flatten


def checked(samples: DataFrame, configs: list[tuple[str, str]] = ()) -> DataFrame:
    """Add reject_reason (null when valid): ``offset`` or ``pattern``, by the first bad entity.

    A label's first configured pattern counts; one that does not compile is ignored.
    """
    patterns: dict[str, str] = {}
    for label, pattern in configs:
        patterns.setdefault(label.lower(), pattern)
    text = F.col("text")

    def fault(e):
        got = F.substring(text, e["start"] + 1, e["end"] - e["start"])
        wrong = F.when(~got.eqNullSafe(e["value"]), "offset")
        for label, pattern in patterns.items():
            if pattern and compiles(pattern):
                wrong = wrong.when((F.lower(e["label"]) == label) & ~e["value"].rlike(full_pattern(pattern)), "pattern")
        return wrong

    faults = F.filter(F.transform("entities", fault), lambda r: r.isNotNull())
    return samples.withColumn("reject_reason", F.try_element_at(faults, F.lit(1)))


def validate(samples: DataFrame, configs: list[tuple[str, str]] = ()) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reject_reason)."""
    rows = checked(samples, configs)
    return rows.filter("reject_reason IS NULL").drop("reject_reason"), rows.filter("reject_reason IS NOT NULL")


def generation_report(rows: DataFrame, requested: int, near_dups: int = 0) -> DataFrame:
    """One row of totals over checked samples; counts are taken before the set is cut to size."""
    valid = F.col("reject_reason").isNull()
    negatives = F.coalesce(F.sum((valid & F.col("is_hard_negative")).cast("long")), F.lit(0))
    kept = F.coalesce(F.sum(valid.cast("long")), F.lit(0))
    rate = near_dups / requested if requested else 0.0
    return rows.agg(
        kept.alias("sample_counts"),
        (F.count(F.lit(1)) - kept).alias("dropped_count"),
        negatives.alias("hard_negatives_count"),
        F.coalesce(F.try_divide(negatives * F.lit(100.0), kept), F.lit(0.0)).alias("percent_hard_negatives"),
        F.lit(float(rate)).alias("near_dup_rate"),
    )


def domain_distribution(samples: DataFrame) -> DataFrame:
    counts = samples.groupBy(F.coalesce("domain", F.lit(UNKNOWN_DOMAIN)).alias("domain")).agg(
        F.count(F.lit(1)).alias("samples")
    )
    return _with_share(counts, "samples", "percent")


def label_distribution(samples: DataFrame) -> DataFrame:
    spans = flatten(samples, "entities.label", "label")
    counts = spans.groupBy(F.upper("label").alias("label")).agg(F.count(F.lit(1)).alias("entities"))
    return _with_share(counts, "entities", "percent")


def _with_share(counts: DataFrame, column: str, name: str) -> DataFrame:
    """Share of the column total; ``counts`` has one row per domain or label."""
    total = F.sum(column).over(Window.partitionBy(F.lit(0)))  # of the small aggregate
    return counts.withColumn(name, F.col(column) * 100.0 / total)


def balance(samples: DataFrame) -> DataFrame:
    """Entity instances per label, and neutral samples, as a share of all samples.

    One pass: every sample yields a row for the total, one if it is neutral, one per entity.
    """
    tags = F.concat(
        F.array(F.lit("\0all")),
        F.when(F.size("entities") == 0, F.array(F.lit("\0neutral"))).otherwise(F.array().cast("array<string>")),
        F.transform("entities", lambda e: F.lower(e["label"])),
    )
    counts = flatten(samples, tags, "tag").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    total = F.max(F.when(F.col("tag") == "\0all", F.col("n"))).over(Window.partitionBy(F.lit(0)))
    rows = counts.withColumn("_total", total).filter(F.col("tag") != "\0all")
    neutral = F.col("tag") == "\0neutral"
    return rows.select(
        F.when(neutral, "neutral").otherwise("label").alias("kind"),
        F.when(~neutral, F.col("tag")).alias("label"),
        F.col("n").alias("instances"),
        (F.col("n") * 100.0 / F.col("_total")).alias("percent_of_samples"),
    )


def first_samples(samples: DataFrame, n: int) -> DataFrame:
    """The requested number of samples, in order of their number."""
    return samples.orderBy("sample_id").limit(n)
