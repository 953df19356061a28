"""Compare: two inputs as sets of lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from .frame import LineFrame

MODES = ("only_a", "only_b", "both", "different")


@dataclass(frozen=True)
class Compare:
    mode: str = "only_a"
    case_sensitive: bool = False

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode: {self.mode}")

    def _joined(self, a: LineFrame, b: LineFrame) -> DataFrame:
        """(k, a, b): the first line of each side by key; both sides are aggregated before they meet."""

        def side(frame: LineFrame, name: str) -> DataFrame:
            frame = frame.ranked()
            first = F.min_by("value", F.struct(*frame.columns)).alias(name)
            return frame.df.groupBy(S.key(F.col("value"), self.case_sensitive).alias("k")).agg(first)

        return side(a, "a").join(side(b, "b"), "k", "full")

    def apply(self, a: LineFrame, b: LineFrame) -> LineFrame:
        """Lines ordered by their key; of lines in both, the text in A."""
        both = self._joined(a, b)
        test = {
            "only_a": F.col("b").isNull(),
            "only_b": F.col("a").isNull(),
            "both": F.col("a").isNotNull() & F.col("b").isNotNull(),
            "different": F.col("a").isNull() | F.col("b").isNull(),
        }[self.mode]
        return LineFrame.of(both.where(test).select("k", F.coalesce("a", "b").alias("value")), "k")

    def counts(self, a: LineFrame, b: LineFrame) -> DataFrame:
        both = self._joined(a, b)
        none_a, none_b = F.col("a").isNull(), F.col("b").isNull()
        return both.agg(F.count_if(none_b).alias("only_a"), F.count_if(none_a).alias("only_b"), F.count_if(~none_a & ~none_b).alias("both"))
