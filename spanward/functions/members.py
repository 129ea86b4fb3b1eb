"""Membership in a set of any size as a bitmap of bounded size, looked up before a shuffle.

A key is a cell of the bitmap; words of 64 cells are rows of a table of at most ``MAX_WORDS`` rows, which is what makes
broadcasting it safe whatever the set's size. No member is ever missed; other keys pass with the share of cells set,
about one in sixteen until the bound is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

MAX_WORDS = 1 << 17
CELLS_PER_KEY = 16


def bitmap(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(word, bits) of the distinct longs in ``key``, and the number of words."""
    n = keys.select(F.approx_count_distinct(key)).first()[0]
    words = min(MAX_WORDS, 1 << max(6, (n * CELLS_PER_KEY // 64).bit_length()))
    cells = keys.select(F.pmod(key, F.lit(words * 64)).alias("cell"))
    bits = cells.selectExpr("cell div 64 AS word", "shiftleft(1L, cast(cell % 64 AS int)) AS bit")
    return materialise(bits.groupBy("word").agg(F.bit_or("bit").alias("bits")), "bitmap"), words


def maybe_members(df: DataFrame, key: Column, marked: tuple[DataFrame, int]) -> DataFrame:
    """Rows of ``df`` whose key may be in the set: all members and few others, without a shuffle."""
    table, words = marked
    cells = df.withColumn("_cell", F.pmod(key, F.lit(words * 64))).withColumn("word", F.expr("_cell div 64"))
    hit = F.expr("shiftright(bits, cast(_cell % 64 AS int)) & 1 = 1")
    return cells.join(F.broadcast(table), "word").where(hit).drop("_cell", "word", "bits")
