"""Extract: every match of a pattern, as a line of its own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S
from .dedupe import Dedupe
from .frame import LineFrame
from .sort import Sort

# The pattern of each kind.
PATTERNS = {
    "url": r"""\bhttps?://[^\s<>"']+""",
    "domain": r"\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}\b",
    "email": r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,63}\b",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "ipv6": r"(?<![0-9A-F:])(?:[0-9A-F]{0,4}:){2,7}[0-9A-F]{0,4}(?![0-9A-F:])",
    "md5": r"\b[A-F0-9]{32}\b",
    "sha1": r"\b[A-F0-9]{40}\b",
    "sha256": r"\b[A-F0-9]{64}\b",
}


def is_ipv6(address: Column) -> Column:
    """Eight groups, or fewer with one '::' that stands for one group or more."""
    group = "[0-9A-Fa-f]{1,4}"
    sides = f"^({group}(:{group})*)?::({group}(:{group})*)?$"
    groups = F.size(F.filter(F.split(address, ":"), lambda g: g != ""))
    return address.rlike(f"^{group}(:{group}){{7}}$") | (address.rlike(sides) & (groups <= 7))


@dataclass(frozen=True)
class Extract:
    kind: str
    custom: str | None = None
    unique: bool = True
    sort: bool = False
    case_sensitive: bool = False
    csv: bool = False

    def pattern(self, spark: SparkSession) -> str:
        if self.kind == "custom":
            if not self.custom:
                raise ValueError("a custom pattern is needed")
            S.validate(spark, self.custom, self.case_sensitive)
            return S.pattern(self.custom, self.case_sensitive)
        if self.kind not in PATTERNS:
            raise ValueError(f"kind: {self.kind}")
        return S.pattern(PATTERNS[self.kind], self.case_sensitive)

    def _matches(self, frame: LineFrame) -> LineFrame:
        spark = frame.df.sparkSession
        found = F.regexp_extract_all(F.col("value"), F.lit(self.pattern(spark)), F.lit(0))
        others = [c for c in frame.df.columns if c != "value"]
        df = frame.df.select(*others, F.posexplode(found).alias("match_pos", "value"))
        if self.kind == "ipv6":
            df = df.where(is_ipv6(F.col("value")))
        return LineFrame(df, (*frame.order, ("match_pos", True)))

    def apply(self, frame: LineFrame) -> LineFrame:
        out = self._matches(frame.ranked())
        if self.unique:
            out = Dedupe(self.case_sensitive).apply(out)
        if self.sort:
            out = Sort("alpha", self.case_sensitive).apply(out)
        if self.csv:
            quoted = F.concat(F.lit('"'), F.replace(F.col("value"), F.lit('"'), F.lit('""')), F.lit('"'))
            out = out.with_df(out.df.withColumn("value", quoted))
        return out

    def counts(self, frame: LineFrame) -> DataFrame:
        """input lines, output values and affected values: copies dropped."""
        found = self._matches(frame.ranked()).df
        none = F.lit(0).cast("long")
        lines = frame.df.agg(F.count("*").alias("input"), none.alias("output"), none.alias("affected"))
        if self.unique:
            found = found.groupBy(S.key(F.col("value"), self.case_sensitive).alias("_k")).agg(F.count("*").alias("_n"))
            affected = F.coalesce(F.sum("_n") - F.count("*"), none)
        else:
            affected = none
        values = found.agg(none.alias("input"), F.count("*").alias("output"), affected.alias("affected"))
        return lines.union(values).agg(*[F.sum(c).alias(c) for c in ("input", "output", "affected")])
