"""Labelled samples: reading with quarantine, and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog.factory import SAMPLE_STYLE, UNKNOWN_DOMAIN
from ..schemas import ENTITIES_DDL, SAMPLES

_CORRUPT = "_corrupt_record"


def well_formed() -> "F.Column":
    """A sample needs a text and an entity list (which may be empty)."""
    return F.col("text").isNotNull() & F.col("entities").isNotNull()


def read_samples(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(samples, quarantined) from JSON arrays, or from JSON lines.

    One bad byte makes a whole array file unreadable, so it is quarantined as a file; with
    JSON lines only the row is. Missing optional fields get their defaults; a missing number is a hash of the content,
    so it is the same in every run and equal for repeated samples.
    """
    schema = T.StructType([*SAMPLES.fields, T.StructField(_CORRUPT, T.StringType())])
    raw = (
        spark.read.schema(schema)
        .option("multiLine", not lines)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .json(path)
        .withColumn("source_file", F.input_file_name())
    )
    bad = F.col(_CORRUPT).isNotNull() | ~well_formed()
    defaults = {
        "sample_id": F.coalesce("sample_id", F.xxhash64("text", F.to_json("entities"), "domain", "style")),
        "domain": F.coalesce("domain", F.lit(UNKNOWN_DOMAIN)),
        "style": F.coalesce("style", F.lit(SAMPLE_STYLE)),
        "is_hard_negative": F.coalesce("is_hard_negative", F.lit(False)),
    }
    good = raw.filter(~bad).withColumns(defaults).select(*SAMPLES.fieldNames())
    reason = F.when(F.col(_CORRUPT).isNotNull(), "malformed").otherwise("missing field")
    held = raw.filter(bad).select(
        "source_file", reason.alias("reason"), F.coalesce(_CORRUPT, F.to_json(F.struct("text", "entities"))).alias("record")
    )
    return good, held


def split_well_formed(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    return samples.filter(well_formed()), samples.filter(~well_formed())


def as_entities(column) -> "F.Column":
    return column.cast(ENTITIES_DDL)


def write_samples(samples: DataFrame, path: str, form: str = "json") -> None:
    samples.write.mode("overwrite").format(form).save(path)


def write_eval(result: DataFrame, path: str) -> None:
    """One folder per run, so that a run can be replaced or read on its own."""
    result.write.mode("overwrite").partitionBy("run_id").json(path)
