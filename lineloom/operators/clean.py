"""Clean: trimming, dropping, white space, length and case, in this fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from .frame import LineFrame


@dataclass(frozen=True)
class Clean:
    trim: bool = True
    drop_blank: bool = True
    drop_empty: bool = True
    normalise_space: bool = False
    squeeze_blanks: bool = False
    min_length: int | None = None
    max_length: int | None = None
    case: str = "none"
    line_ending: str = "\r\n"

    def __post_init__(self):
        if self.case not in ("none", "lower", "upper"):
            raise ValueError(f"case: {self.case}")

    def text(self, value: Column) -> Column:
        """The cleaned line, before case."""
        if self.trim:
            value = S.trim_ws(value)
        if self.normalise_space:
            return S.squeeze_ws(value)
        return S.squeeze_blanks(value) if self.squeeze_blanks else value

    def keeps(self, trimmed: Column, text: Column) -> Column:
        keep = F.lit(True)
        if self.drop_blank:
            keep = keep & ~S.is_blank(trimmed)
        if self.drop_empty:
            keep = keep & (trimmed != "")
        if self.min_length is not None:
            keep = keep & (S.len16(text) >= self.min_length)
        if self.max_length is not None:
            keep = keep & (S.len16(text) <= self.max_length)
        return keep

    def _marked(self, frame: LineFrame) -> DataFrame:
        value = F.col("value")
        trimmed = S.trim_ws(value) if self.trim else value
        df = frame.df.withColumn("_raw", value).withColumn("_trimmed", trimmed).withColumn("value", self.text(value))
        return df.withColumn("_keep", self.keeps(F.col("_trimmed"), F.col("value")))

    def _cased(self, value: Column) -> Column:
        return {"none": lambda v: v, "lower": S.lower_inv, "upper": S.upper_inv}[self.case](value)

    def apply(self, frame: LineFrame) -> LineFrame:
        kept = self._marked(frame).where("_keep").drop("_raw", "_trimmed", "_keep")
        return frame.with_df(kept.withColumn("value", self._cased(F.col("value"))))

    def counts(self, frame: LineFrame) -> DataFrame:
        """input, output and affected lines: dropped or changed ones."""
        changed = ~F.col("_keep") | (self._cased(F.col("value")) != F.col("_raw"))
        return self._marked(frame).agg(F.count("*").alias("input"), F.count_if("_keep").alias("output"), F.count_if(changed).alias("affected"))
