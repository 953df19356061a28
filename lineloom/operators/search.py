"""Search and navigation in large files: numbered lines with byte offsets.

Here only a line feed ends a line; carriage returns before it do not belong to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from .frame import LineFrame
from .running import before

# Limits of results, previews and chunks.
MOST_RESULTS = 10_000
PREVIEW = 240
PREVIEW_BEFORE = 80
MOST_CHUNK = 50_000
LEAST_INTERVAL = 100
MOST_CHARACTERS = 32_768


def with_offsets(frame: LineFrame, newline_bytes: int = 1, preamble: int = 0) -> DataFrame:
    """``line_no`` from 1, ``byte_offset`` of the line's start, ``byte_end`` after its terminator, ``value``."""
    df = frame.numbered().df
    size = F.octet_length("value") + newline_bytes
    df = before(df, "line_no", size, "byte_offset").withColumn("byte_offset", F.col("byte_offset") + preamble)
    return df.select("line_no", "byte_offset", (F.col("byte_offset") + size).alias("byte_end"), F.regexp_replace("value", "\\r+$", "").alias("value"))


def preview(value: Column, query: str | None, case_sensitive: bool = False) -> Column:
    """The line, or a window of it that begins a little before the text sought."""
    if query:
        at = F.locate(query, value) if case_sensitive else F.instr(S.upper_inv(value), S.upper_inv(F.lit(query)))
    else:
        at = F.lit(0)
    start = F.greatest(F.lit(0), at - 1 - PREVIEW_BEFORE)
    window = F.substring(value, start + 1, F.lit(PREVIEW))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), window, F.when(start + PREVIEW < F.length(value), "…").otherwise(""))
    return F.when(F.length(value) <= PREVIEW, value).otherwise(cut)


@dataclass(frozen=True)
class Search:
    query: str
    regex: bool = False
    case_sensitive: bool = False
    limit: int = MOST_RESULTS

    def _test(self, df: DataFrame) -> Column:
        if not self.query:
            raise ValueError("a query is needed")
        if self.regex:
            S.validate(df.sparkSession, self.query, self.case_sensitive)
            return F.col("value").rlike(S.pattern(self.query, self.case_sensitive))
        return F.contains(S.key(F.col("value"), self.case_sensitive), S.key(F.lit(self.query), self.case_sensitive))

    def apply(self, lines: DataFrame) -> DataFrame:
        """The first matching lines of ``with_offsets``: line_no, byte_offset and preview."""
        hits = lines.where(self._test(lines)).orderBy("line_no").limit(self.limit)
        return hits.select("line_no", "byte_offset", preview(F.col("value"), None if self.regex else self.query, self.case_sensitive).alias("preview"))

    def summary(self, lines: DataFrame) -> DataFrame:
        """matches (of lines, not of places in them) and whether there are more than the limit."""
        n = F.count_if(self._test(lines))
        return lines.agg(n.alias("matches"), (n > self.limit).alias("limit_reached"))


def sparse_index(lines: DataFrame, interval: int = 10_000) -> DataFrame:
    """A checkpoint for every so many lines."""
    step = max(LEAST_INTERVAL, interval)
    return lines.where((F.col("line_no") - 1) % step == 0).select("line_no", "byte_offset")


def line_count(lines: DataFrame, ends_with_newline: bool = True) -> DataFrame:
    """The count of an index: line feeds plus one."""
    return lines.agg((F.count("*") + (1 if ends_with_newline else 0)).alias("line_count"))


def checkpoint_before(index: DataFrame, line: int | None = None, byte: int | None = None) -> DataFrame:
    """The last checkpoint at or before a line, or a byte; else the first."""
    at = F.col("line_no") <= line if line is not None else F.col("byte_offset") <= byte
    first = F.min(F.struct("line_no", "byte_offset"))
    return index.agg(F.coalesce(F.max(F.when(at, F.struct("line_no", "byte_offset"))), first).alias("c")).where("c IS NOT NULL").select("c.*")


def chunk(lines: DataFrame, line: int, count: int) -> DataFrame:
    """``count`` lines (up to 50,000) from a line on; lines beyond the ends are the nearest."""
    count = min(MOST_CHUNK, max(1, count))
    last = lines.agg(F.max("line_no")).first()[0] or 1
    first = min(max(1, line), last)
    return lines.where(F.col("line_no").between(first, first + count - 1))


def chunk_at_byte(lines: DataFrame, byte: int, count: int) -> DataFrame:
    """``count`` lines from the one that holds the byte on."""
    count = min(MOST_CHUNK, max(1, count))
    first = lines.agg(F.coalesce(F.min(F.when(F.col("byte_end") > byte, F.col("line_no"))), F.max("line_no"))).first()[0] or 1
    return lines.where(F.col("line_no").between(first, first + count - 1))


def line_at_percent(line_count: int, percent: float) -> int:
    return max(1, round(line_count * percent / 100))


def find_pattern(query: str, regex: bool = False, whole_word: bool = False) -> str:
    """The pattern by which an editor finds a query."""
    inner = query if regex else S.quote(query)
    return rf"\b(?:{inner})\b" if whole_word else inner


def find(text: Column, query: str, start: int = 0, regex: bool = False, whole_word: bool = False, case_sensitive: bool = False) -> Column:
    """0-based place of the next match in the text from ``start`` on, else of the first one; null if there is none."""
    wanted = F.lit(S.pattern(find_pattern(query, regex, whole_word), case_sensitive))
    rest = F.regexp_instr(F.substring(text, F.lit(start + 1), F.length(text)), wanted)
    whole = F.regexp_instr(text, wanted)
    return F.when(rest > 0, rest - 1 + start).when(whole > 0, whole - 1)


def find_previous(text: Column, query: str, start: int, regex: bool = False, whole_word: bool = False, case_sensitive: bool = False) -> Column:
    """0-based place of the last match before ``start``, else of the last one; null if there is none."""
    wanted = S.pattern(find_pattern(query, regex, whole_word), case_sensitive)
    # The greedy prefix leaves the last match; its length is the match's place.
    place = lambda t: F.length(F.regexp_extract(t, f"(?s)^(.*)(?:{wanted})", 1))
    has = lambda t: t.rlike(wanted)
    head = F.substring(text, 1, start)
    return F.when(has(head), place(head)).when(has(text), place(text))


def replace_at(text: Column, place: Column, length: int, by: str) -> Column:
    """The text with the selection replaced by a literal."""
    return F.concat(F.substring(text, F.lit(1), place), F.lit(by), F.substring(text, place + 1 + length, F.length(text)))


def first_lines(frame: LineFrame, operator, count: int = 50) -> LineFrame:
    """The preview of an operator: it runs on the first lines."""
    return operator.apply(frame.with_df(frame.df.orderBy(*frame.by()).limit(count)))


def bounded(value: Column, most: int = MOST_CHARACTERS, marker: str = " … [truncated]") -> Column:
    """A line of at most so many characters, marked if cut."""
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit(marker))).otherwise(value)
