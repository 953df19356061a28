"""Statistics of lines, and of daily work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from .frame import LineFrame


def statistics(frame: LineFrame, unique: bool = False) -> DataFrame:
    """One row: lines, empty_lines, shortest, longest, average, characters, and unique_lines (null unless asked for)."""
    size = S.len16(F.col("value"))
    df = frame.df.withColumn("_size", size)
    zero = lambda c: F.coalesce(c, F.lit(0))
    number = F.count_distinct("value") if unique else F.lit(None).cast("long")
    return df.agg(
        F.count("*").alias("lines"),
        F.count_if(F.col("_size") == 0).alias("empty_lines"),
        zero(F.min("_size")).cast("long").alias("shortest"),
        zero(F.max("_size")).cast("long").alias("longest"),
        F.coalesce(F.avg("_size"), F.lit(0.0)).alias("average"),
        zero(F.sum("_size")).cast("long").alias("characters"),
        number.alias("unique_lines"),
    )


def text_counters(text: Column) -> tuple[Column, Column]:
    """(characters, lines) of a whole text as an editor shows them: no line if empty, else one more than line feeds."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return S.len16(text), F.when(text == "", 0).otherwise(feeds + 1)


def daily_totals(jobs: DataFrame, when: str = "finished", lines: str = "lines") -> DataFrame:
    """Lines of finished jobs by day."""
    return jobs.groupBy(F.to_date(when).alias("day")).agg(F.sum(lines).alias("lines"))
