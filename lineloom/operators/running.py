"""Sums along numbered lines, in three levels, so that no task holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines that one task sums, and sums of blocks that one task sums; what is left is a row for each 2^32 lines.
BLOCK = 1 << 16


def _above(block: str) -> Column:
    return F.floor(F.col(block) / BLOCK)


def _past(*partition) -> Column:
    rows = Window.partitionBy(*partition).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_sum").over(rows), F.lit(0))


def bases(sums: DataFrame) -> DataFrame:
    """(_block, _base): the sum of all blocks before, from (_block, _sum) of numbered blocks."""
    high = sums.groupBy(_above("_block").alias("_block")).agg(F.sum("_sum").alias("_sum")).select(F.col("_block").alias("_high"), _past(F.lit(0)).alias("_far"))
    near = sums.withColumn("_high", _above("_block"))
    return near.withColumn("_near", _past("_high")).join(high, "_high").select("_block", (F.col("_far") + F.col("_near")).alias("_base"))


def before(df: DataFrame, number: str, amount: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over the lines before; ``number`` is dense from 1."""
    rows = df.withColumn("_amount", amount.cast("long")).withColumn("_block", F.floor((F.col(number) - 1) / BLOCK))
    sums = bases(rows.groupBy("_block").agg(F.sum("_amount").alias("_sum")))
    within = F.coalesce(F.sum("_amount").over(Window.partitionBy("_block").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_within", within).join(sums, "_block").withColumn(name, F.col("_base") + F.col("_within")).drop("_amount", "_block", "_within", "_base")
