"""File-based streams and running a stream to the end of what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import USAGE
from ..session import fresh_path, prepare


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None, names: str = "*.parquet"
) -> DataFrame:
    """Parquet files of a folder as a stream; zone-less timestamps become instants, as watermarks need."""
    reader = prepare(spark).readStream.schema(schema).option("pathGlobFilter", names)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(path)
    casts = {
        f.name: F.col(f.name).cast("timestamp") for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)
    }
    return stream.withColumns(casts) if casts else stream


def read_usage_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Completed requests as (ts, model, tokens)."""
    return read_stream(spark, path, USAGE, files_per_batch)


def run_available(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], **options) -> None:
    """Process what is there, batch by batch, and stop."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", fresh_path(spark, "offsets"))
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()


def to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run to the end and return what was written, with the number of its batch.

    A batch that is run again after a failure replaces its own folder.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, "stream")
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/{number:09d}")

    run_available(stream, mode, sink)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def totals(stream: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """Sums per key over everything that a stateless stream holds.

    Every batch writes its own partial sums, a batch that is run again replaces them, and they are added up by key at
    the end: the result depends neither on how rows are cut into batches nor on their order.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, "totals")

    def partial(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.expr(e).cast("long").alias(name) for name, e in sums.items()])

    def sink(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path}/{number:09d}")

    run_available(stream, "append", sink)
    kinds = [*[stream.schema[k] for k in keys], *[T.StructField(name, T.LongType()) for name in sums]]
    parts = spark.read.schema(T.StructType(kinds)).option("recursiveFileLookup", "true").parquet(path)
    return parts.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in sums])
