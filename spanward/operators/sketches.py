"""Audit counts from stored sketches.

Each part of a corpus is scanned once; what is kept of it is one small row per label and action: numbers of spans and
texts, the sum of scores and a HyperLogLog sketch of the values. Rows of any parts add up to the audit of their union,
so a corpus that grows is audited by scanning the new part alone, and distinct values are counted without a shuffle of
values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import flatten
from .detect import Policy

#: Logarithm of the number of registers; the relative standard error is 1.04 / sqrt(2 ** PRECISION).
PRECISION = 14
ERROR = 1.04 / 2 ** (PRECISION / 2)


def span_sketches(df: DataFrame, policy: Policy, *parts: str) -> DataFrame:
    """(parts, label, action, spans, texts, score_sum, sketch) of texts with ``entities``.

    A text counts with its first span of a label, so texts need no distinct count.
    """
    labels = F.transform("entities", lambda e: e["label"])
    marked = F.transform(
        "entities",
        lambda e, i: F.struct(
            e["label"].alias("label"), e["value"].alias("value"), e["score"].alias("score"),
            (F.array_position(F.col("_labels"), e["label"]) == i + 1).cast("long").alias("first"),
        ),
    )
    rows = flatten(df.withColumn("_labels", labels), marked, "s", *parts)
    return rows.groupBy(*parts, "s.label", policy.action(F.col("s.label")).alias("action")).agg(
        F.count(F.lit(1)).alias("spans"), F.sum("s.first").alias("texts"), F.sum("s.score").alias("score_sum"),
        F.hll_sketch_agg("s.value", PRECISION).alias("sketch"),
    )


def merged(sketches: DataFrame) -> DataFrame:
    """(label, action, spans, texts, mean_score, distinct_values) of all parts given; the last one is an estimate."""
    return sketches.groupBy("label", "action").agg(
        F.sum("spans").alias("spans"), F.sum("texts").alias("texts"), (F.sum("score_sum") / F.sum("spans")).alias("mean_score"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"),
    )
