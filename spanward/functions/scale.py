"""Running totals that split hot keys.

A plain window puts every row of one key into one task. Here rows are range-partitioned by
(key, order), so a hot key spreads over many slices; each slice is summed on its own and the
slice totals, one small row each, give the offsets.

Joins need no such help: ``session.prepare`` keeps adaptive skew joins on, which split the rows of
a hot join key over tasks without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, slices

SLICE = "_slice"


def sliced(df: DataFrame, keys: list[str], order: list[str], n: int | None = None) -> DataFrame:
    """Rows tagged with the slice of their range partition.

    Written once to the shared folder: totals and rows must see the same slice bounds.
    ``order`` has to be unique within a key for a hot key to split evenly.
    """
    ranged = df.repartitionByRange(n or slices(df.sparkSession), *keys, *order).withColumn(SLICE, F.spark_partition_id())
    return materialise(ranged, "sliced")


def slice_offsets(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per (key, slice): what all earlier slices of the key add up to."""
    totals = rows.groupBy(*keys, SLICE).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys, SLICE, *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_before_{k}") for k in sums]
    )


def within_slice(keys: list[str], order: list[str], inclusive: bool = True):
    w = Window.partitionBy(*keys, SLICE).orderBy(*order)
    return w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    inclusive: bool = True,
    presliced: bool = False,
) -> DataFrame:
    """Add one running sum per entry of ``sums``; keys must not be null."""
    rows = df if presliced else sliced(df, keys, order)
    w = within_slice(keys, order, inclusive)
    local = rows.withColumns({f"_in_{k}": F.coalesce(F.sum(c).over(w), F.lit(0)) for k, c in sums.items()})
    out = local.join(slice_offsets(rows, keys, sums), [*keys, SLICE])
    out = out.withColumns({k: F.col(f"_before_{k}") + F.col(f"_in_{k}") for k in sums})
    drop = [f"_before_{k}" for k in sums] + [f"_in_{k}" for k in sums]
    return out.drop(*drop) if presliced else out.drop(SLICE, *drop)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``row_number`` per key without one task per key."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("long")})
