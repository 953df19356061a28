"""Lines with an explicit order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, stash


@dataclass(frozen=True)
class LineFrame:
    """A DataFrame with a column ``value`` of lines, and the columns that order them.

    ``order`` holds (column, ascending).  Operators keep, extend or replace it; nothing
    relies on the order in which Spark happens to hold rows.
    """

    df: DataFrame
    order: tuple[tuple[str, bool], ...]
    #: Whether the order is worth writing before it is used, since ranges read it twice.
    costly: bool = False

    @classmethod
    def of(cls, df: DataFrame, *order: str, value: str = "value") -> LineFrame:
        named = df if value == "value" else df.withColumnRenamed(value, "value")
        return cls(named, tuple((c, True) for c in order))

    @property
    def columns(self) -> list[str]:
        return [c for c, _ in self.order]

    def by(self) -> list[Column]:
        """Sort expressions of the order."""
        return [F.col(c).asc() if up else F.col(c).desc() for c, up in self.order]

    def with_df(self, df: DataFrame) -> LineFrame:
        return LineFrame(df, self.order, self.costly)

    def ranked(self) -> LineFrame:
        """The same lines ordered by ascending columns only."""
        if all(up for _, up in self.order):
            return self
        return self.numbered("line_no")

    def numbered(self, name: str = "line_no") -> LineFrame:
        """The lines with dense numbers from 1, which become the order.

        Lines are sorted by ranges and written; the number of a line is its place in
        its range and the lines of the ranges before, so no task holds them all.
        """
        spark = self.df.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        source = stash(self.df, "keys") if self.costly else self.df
        ranged = source.repartitionByRange(parts, *self.by()).sortWithinPartitions(*self.by())
        mark = F.monotonically_increasing_id()
        ranged = stash(ranged.select("value", *[c for c in self.df.columns if c not in ("value", name)], mark.alias("_at")), "lines")
        if self.costly:
            discard(source)
        part, place = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
        sizes = ranged.groupBy(part).agg((F.max(place) + 1).alias("_n"))
        # One row for each range, of which the session sets the number.
        past = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        before = sizes.select("_part", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before"))
        joined = ranged.withColumn("_part", part).join(F.broadcast(before), "_part")
        done = joined.withColumn(name, F.col("_before") + place + 1).drop("_part", "_before", "_at")
        return LineFrame(done, ((name, True),))

    def lines(self) -> DataFrame:
        """The lines alone, in order."""
        return self.df.orderBy(*self.by()).select("value")
