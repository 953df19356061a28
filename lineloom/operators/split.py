"""Split: consecutive lines into numbered parts."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..sources.scratch import discard, stash
from .frame import LineFrame
from .running import bases, before

MODES = ("lines", "bytes", "before", "after")


#: Bytes of text whose lines one task searches for the ends of parts.
SPAN = 1 << 20


def following(sizes: DataFrame, limit: int) -> DataFrame:
    """(line_no, next): the line that begins the next part if a part begins at line_no; lines of the last part have none.

    That is the line in which byte ``limit`` after the start of line_no lies, or the next
    one if that is the line itself.  Its number is that of lines which start at this byte
    or before: those of the spans before, and of this one.
    """
    lines = stash(before(sizes, "line_no", F.col("size"), "start").select("line_no", "start", "size"), "sizes")
    total = lines.agg(F.max(F.col("start") + F.col("size"))).first()[0] or 0
    point = lambda at, kind: lines.select((F.col("start") + at).alias("at"), F.lit(kind).alias("kind"), "line_no")
    points = point(0, 0).union(point(limit, 1).where(F.col("at") < total)).withColumn("_block", F.floor(F.col("at") / SPAN))
    counts = points.groupBy("_block").agg(F.count_if(F.col("kind") == 0).alias("_sum"))
    seen = Window.partitionBy("_block").orderBy("at", "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    within = points.withColumn("within", F.count_if(F.col("kind") == 0).over(seen)).where("kind = 1")
    found = within.join(bases(counts), "_block").select("line_no", F.greatest(F.col("_base") + F.col("within"), F.col("line_no") + 1).alias("next"))
    last = lines.agg(F.max("line_no")).first()[0] or 0
    done = stash(found.where(F.col("next") <= last), "next")
    discard(lines)
    return done


def first_lines_of_parts(sizes: DataFrame, limit: int) -> DataFrame:
    """(line_no) of the lines that begin a part, by doubling of the pointers to the next part."""
    hop = following(sizes, limit)
    starts = stash(sizes.where("line_no = 1").select("line_no"), "starts")
    while True:
        # After k rounds ``hop`` goes 2^k parts on, and the first 2^k starts are known.
        more = stash(starts.join(hop, "line_no").select(F.col("next").alias("line_no")), "starts")
        if not more.count():
            discard(hop, more)
            return starts
        both = stash(starts.union(more), "starts")
        again = hop.select(F.col("line_no").alias("next"), F.col("next").alias("then"))
        twice = stash(hop.join(again, "next").select("line_no", F.col("then").alias("next")), "next")
        discard(hop, starts, more)
        hop, starts = twice, both


@dataclass(frozen=True)
class Split:
    mode: str = "lines"
    size: int = 0
    regex: str | None = None
    padding: int = 3
    newline_bytes: int = 2

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode: {self.mode}")
        if self.mode in ("lines", "bytes") and self.size <= 0:
            raise ValueError("the size must be positive")
        if self.mode in ("before", "after") and not (self.regex or "").strip():
            raise ValueError("a pattern is needed")

    def _matches(self, frame: LineFrame) -> Column:
        S.validate(frame.df.sparkSession, self.regex)
        return F.col("value").rlike(S.pattern(self.regex, True))

    def apply(self, frame: LineFrame) -> LineFrame:
        """The lines with ``line_no`` and ``part``, both from 1; no part is empty."""
        numbered = frame.numbered()
        df, n = numbered.df, F.col("line_no")
        if self.mode == "lines":
            return numbered.with_df(df.withColumn("part", F.floor((n - 1) / self.size) + 1))
        if self.mode == "bytes":
            sizes = df.select("line_no", (F.octet_length("value") + self.newline_bytes).cast("long").alias("size"))
            starts = first_lines_of_parts(sizes, self.size).withColumn("begins", F.lit(1))
            df = df.join(starts, "line_no", "left")
            begins = F.coalesce("begins", F.lit(0))
            df = before(df, "line_no", begins, "part")
            return numbered.with_df(df.withColumn("part", F.col("part") + begins).drop("begins"))
        starts = self._matches(frame)
        if self.mode == "before":
            # A match starts a part, unless it is the first line, which starts one anyhow.
            df = before(df, "line_no", starts & (n > 1), "part")
            return numbered.with_df(df.withColumn("part", F.col("part") + 1 + (starts & (n > 1)).cast("long")))
        df = before(df, "line_no", starts, "part")
        return numbered.with_df(df.withColumn("part", F.col("part") + 1))

    def name(self, path: str, part: int) -> str:
        """The file of a part."""
        stem, ending = os.path.splitext(os.path.basename(path))
        return f"{stem}_part_{part:0{min(8, max(1, self.padding))}d}{ending}"

    def counts(self, frame: LineFrame) -> DataFrame:
        return self.apply(frame).df.agg(F.count("*").alias("input"), F.coalesce(F.max("part"), F.lit(0)).alias("parts"))
