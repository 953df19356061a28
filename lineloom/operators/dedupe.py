"""Dedupe: one line of each text, the first or the last, in the order of the lines kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from .frame import LineFrame


@dataclass(frozen=True)
class Dedupe:
    case_sensitive: bool = True
    keep: str = "first"

    def __post_init__(self):
        if self.keep not in ("first", "last"):
            raise ValueError(f"keep: {self.keep}")

    def apply(self, frame: LineFrame) -> LineFrame:
        """An aggregate with partial sums, so that copies meet before the shuffle."""
        frame = frame.ranked()
        place = F.struct(*frame.columns)
        pick = F.min_by if self.keep == "first" else F.max_by
        row = F.struct(*[F.col(c) for c in frame.df.columns])
        kept = frame.df.groupBy(S.key(F.col("value"), self.case_sensitive).alias("_key")).agg(pick(row, place).alias("_row"))
        return frame.with_df(kept.select("_row.*"))

    def counts(self, frame: LineFrame) -> DataFrame:
        """input, output and affected lines: copies dropped."""
        groups = frame.df.groupBy(S.key(F.col("value"), self.case_sensitive).alias("_key")).agg(F.count("*").alias("_n"))
        total, kept = F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")
        return groups.agg(total.alias("input"), kept.alias("output"), (total - kept).alias("affected"))
