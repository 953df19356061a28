"""Columns of delimited lines, cut at a literal delimiter without quoting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S
from .filter import Filter, Rule
from .frame import LineFrame

OPERATIONS = ("extract", "remove", "reorder", "join", "filter")


def split(value: Column, delimiter: str) -> Column:
    """All columns, empty ones too."""
    if not delimiter:
        raise ValueError("a delimiter is needed")
    return F.split(value, S.quote(delimiter), -1)


@dataclass(frozen=True)
class Columns:
    delimiter: str
    operation: str
    column: int = 0
    columns: tuple[int, ...] | None = None
    join_with: str = "|"
    rule: Rule | None = None

    def __post_init__(self):
        if not self.delimiter:
            raise ValueError("a delimiter is needed")
        if self.operation not in OPERATIONS:
            raise ValueError(f"operation: {self.operation}")
        if self.operation in ("reorder", "join") and not self.columns:
            raise ValueError("columns are needed")
        if self.operation == "filter" and self.rule is None:
            raise ValueError("a rule is needed")
        if min((self.column, *(self.columns or ()))) < 0:
            raise ValueError("columns are numbered from 0")

    @property
    def used(self) -> tuple[int, ...]:
        return self.columns if self.operation in ("reorder", "join") else (self.column,)

    def _split(self, frame: LineFrame) -> tuple[DataFrame, Column]:
        if self.rule is not None:
            self.rule.validate(frame.df.sparkSession)
        df = frame.df.withColumn("_parts", split(F.col("value"), self.delimiter))
        return df, F.size("_parts") > max(self.used)

    def _test(self, spark: SparkSession) -> Column:
        return Filter((self.rule,)).test(spark, F.get("_parts", F.lit(self.column)))

    def _text(self) -> Column:
        parts, one = F.col("_parts"), lambda i: F.get(F.col("_parts"), F.lit(i))
        match self.operation:
            case "extract":
                return one(self.column)
            case "remove":
                rest = F.concat(F.slice(parts, 1, self.column), F.slice(parts, F.lit(self.column + 2), F.greatest(F.size(parts) - self.column - 1, F.lit(0))))
                return F.array_join(rest, self.delimiter)
            case "reorder":
                return F.concat_ws(self.delimiter, *[one(i) for i in self.columns])
            case "join":
                return F.concat_ws(self.join_with, *[one(i) for i in self.columns])
        return F.col("value")

    def apply(self, frame: LineFrame) -> LineFrame:
        """Lines that lack a column used are left out."""
        df, whole = self._split(frame)
        df = df.where(whole)
        if self.operation == "filter":
            df = df.where(self._test(df.sparkSession))
        return frame.with_df(df.withColumn("value", self._text()).drop("_parts"))

    def counts(self, frame: LineFrame) -> DataFrame:
        """input, output and affected lines: those that lack a column; lines that the rule rejects are neither."""
        df, whole = self._split(frame)
        kept = whole & self._test(df.sparkSession) if self.operation == "filter" else whole
        return df.agg(F.count("*").alias("input"), F.count_if(kept).alias("output"), F.count_if(~whole).alias("affected"))
