"""Merge: the lines of several inputs, one after the other."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frame import LineFrame


@dataclass(frozen=True)
class Merge:
    blank_between: bool = True
    separator: str | None = None

    def apply(self, frames: list[LineFrame]) -> LineFrame:
        """Ordered by (input, separator after lines, own order)."""
        if not frames:
            raise ValueError("an input is needed")
        frames = [f.ranked() for f in frames]
        width = max(len(f.order) for f in frames)
        names = [f"order_{k}" for k in range(width)]
        parts = []
        for k, frame in enumerate(frames):
            own = [F.col(frame.columns[j]).alias(names[j]) if j < len(frame.order) else F.lit(None).alias(names[j]) for j in range(width)]
            parts.append(frame.df.select(F.lit(k).alias("input"), F.lit(0).alias("after"), *own, "value"))
        line = self.separator or ("" if self.blank_between else None)
        if line is not None and len(frames) > 1:
            between = frames[0].df.sparkSession.range(len(frames) - 1)
            parts.append(between.select(F.col("id").cast("int").alias("input"), F.lit(1).alias("after"), *[F.lit(None).cast(parts[0].schema[n].dataType).alias(n) for n in names], F.lit(line).alias("value")))
        df = functools.reduce(DataFrame.unionByName, parts)
        return LineFrame(df, (("input", True), ("after", True), *((n, True) for n in names)))

    def counts(self, frames: list[LineFrame]) -> DataFrame:
        """Lines without separators."""
        every = functools.reduce(DataFrame.union, [f.df.select("value") for f in frames])
        return every.agg(F.count("*").alias("input"), F.count("*").alias("output"), F.lit(0).cast("long").alias("affected"))
