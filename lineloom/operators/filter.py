"""Filter: rules on single lines, all or any of which must hold."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S
from .frame import LineFrame

CONDITIONS = ("contains", "not_contains", "starts", "ends", "equals", "not_equals", "regex", "not_regex", "longer", "shorter", "length_between")


def _number(text: str | None) -> int:
    if text is None or not text.isascii() or not text.isdigit() or int(text) > 0x7FFFFFFF:
        raise ValueError(f"not a length: {text!r}")
    return int(text)


@dataclass(frozen=True)
class Rule:
    condition: str
    value: str
    second: str | None = None
    case_sensitive: bool = False

    def validate(self, spark: SparkSession) -> None:
        """Raise ValueError for a rule that can't be evaluated, before any line is read."""
        if self.condition not in CONDITIONS:
            raise ValueError(f"condition: {self.condition}")
        if self.condition.endswith("regex"):
            S.validate(spark, self.value, self.case_sensitive)
        if self.condition in ("longer", "shorter", "length_between"):
            _number(self.value)
        if self.condition == "length_between":
            _number(self.second)

    def test(self, line: Column) -> Column:
        same = lambda c: S.key(c, self.case_sensitive)
        wanted = same(F.lit(self.value))
        match self.condition:
            case "contains":
                return F.contains(same(line), wanted)
            case "not_contains":
                return ~F.contains(same(line), wanted)
            case "starts":
                return F.startswith(same(line), wanted)
            case "ends":
                return F.endswith(same(line), wanted)
            case "equals":
                return same(line) == wanted
            case "not_equals":
                return same(line) != wanted
            case "regex":
                return line.rlike(S.pattern(self.value, self.case_sensitive))
            case "not_regex":
                return ~line.rlike(S.pattern(self.value, self.case_sensitive))
            case "longer":
                return S.len16(line) > _number(self.value)
            case "shorter":
                return S.len16(line) < _number(self.value)
            case "length_between":
                a, b = _number(self.value), _number(self.second)
                return S.len16(line).between(min(a, b), max(a, b))
        raise ValueError(f"condition: {self.condition}")


@dataclass(frozen=True)
class Filter:
    rules: tuple[Rule, ...]
    mode: str = "and"

    def test(self, spark: SparkSession, line: Column) -> Column:
        if not self.rules:
            raise ValueError("a filter needs a rule")
        if self.mode not in ("and", "or"):
            raise ValueError(f"mode: {self.mode}")
        for rule in self.rules:
            rule.validate(spark)
        return functools.reduce(operator.and_ if self.mode == "and" else operator.or_, [r.test(line) for r in self.rules])

    def apply(self, frame: LineFrame) -> LineFrame:
        return frame.with_df(frame.df.where(self.test(frame.df.sparkSession, F.col("value"))))

    def counts(self, frame: LineFrame) -> DataFrame:
        """input, output and affected lines: rejected ones."""
        test = self.test(frame.df.sparkSession, F.col("value"))
        return frame.df.agg(F.count("*").alias("input"), F.count_if(test).alias("output"), F.count_if(~test).alias("affected"))
