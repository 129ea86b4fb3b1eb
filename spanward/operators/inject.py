"""Placing values into carrier sentences with exact spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import factory as f
from ..catalog import pii
from ..functions.spans import entity, no_entities, resolve
from .detect import catalogue_detectors, detected


def placeholders(sentence):
    return F.size(F.split(sentence, r"\[PII\]", -1)) - 1


def inject(df: DataFrame, sentence: str = "sentence", cross_label: bool = False) -> DataFrame:
    """Add text and entities to rows with sentence, label, is_hard_negative and values.

    Placeholders are filled from left to right; a sentence without any gets the first value
    at its end. Hard negatives carry no label and always get a value at the end, one more than they have
    placeholders; neutral rows pass through. If values run out, the last one is used again.
    """
    carrier = F.col(sentence)
    negative = F.col("is_hard_negative")
    gaps = F.split(carrier, r"\[PII\]", -1)
    blank = F.lit("")
    healed = F.array(
        F.when((carrier == "") | carrier.endswith(" "), carrier).otherwise(F.concat(carrier, F.lit(" "))), blank
    )
    # a hard negative never gets entities, so one more value goes behind those that fill its places
    last_gap, places = F.element_at(gaps, -1), F.size(gaps) - 1
    last_value = F.element_at("values", F.least(places, F.size("values")))
    spaced = F.when(last_gap == "", last_value).otherwise(last_gap).endswith(" ")
    longer = F.concat(F.slice(gaps, F.lit(1), places), F.array(F.concat(last_gap, F.when(spaced, "").otherwise(" ")), blank))
    gaps = F.when(places == 0, healed).when(negative, longer).otherwise(gaps)
    state = F.struct(
        F.array().cast("array<string>").alias("parts"),
        F.lit(0).alias("pos"),
        F.lit(0).alias("i"),
        no_entities().alias("spans"),
    )
    last = F.size("_gaps") - 1

    def step(acc, gap):
        more = acc["i"] < last
        val = F.when(more, F.element_at("values", F.least(acc["i"] + 1, F.size("values")))).otherwise(blank)
        begin = acc["pos"] + F.char_length(gap)
        end = begin + F.char_length(val)
        span = entity(F.lower("label"), begin, end, F.lit(None).cast("double"), val)
        return F.struct(
            F.concat(acc["parts"], F.array(gap, val)).alias("parts"),
            end.alias("pos"),
            (acc["i"] + 1).alias("i"),
            F.when(more & ~negative, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    neutral = F.upper("label") == f.NEUTRAL_LABEL
    out = df.withColumn("_gaps", gaps)
    out = out.withColumn("_f", F.when(~neutral, F.aggregate("_gaps", state, step))).withColumns(
        {
            "text": F.when(neutral, carrier).otherwise(F.array_join("_f.parts", "")),
            "entities": F.when(neutral, no_entities()).otherwise(F.col("_f.spans")),
        }
    )
    if cross_label:
        others = detected("text", catalogue_detectors(list(pii.PATTERNS)), overlaps=True)
        out = out.withColumn("_o", others)
        out = out.withColumn(
            "_o", F.concat("entities", F.filter("_o", lambda e: e["label"] != F.lower("label")))
        )
        both = resolve("_o", "label")
        out = out.withColumn("entities", F.when(neutral, F.col("entities")).otherwise(both)).drop("_o")
    return out.drop("_gaps", "_f")


def as_samples(df: DataFrame, id_col: str) -> DataFrame:
    """Injected rows in the layout of the samples table."""
    return df.select(
        F.col(id_col).cast("long").alias("sample_id"), "text", "domain",
        F.lit(f.SAMPLE_STYLE).alias("style"), "is_hard_negative", "entities",
    )
