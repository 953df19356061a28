"""Operators over files: files in, one new file (or its parts) out, and counters."""

from __future__ import annotations

from dataclasses import dataclass
from time import monotonic

from pyspark.sql import SparkSession

from ..operators.clean import Clean
from ..operators.compare import Compare
from ..operators.extract import Extract
from ..operators.merge import Merge
from ..operators.split import Split
from ..sources.encoding import ANSI, TextEncoding, detect_file
from ..sources.files import Files
from ..sources.text import read_lines, write_file, write_parts


@dataclass(frozen=True)
class Result:
    output: str
    input_lines: int
    output_lines: int
    affected: int
    seconds: float


def new(spark: SparkSession, target: str) -> None:
    """Raise now, not after the work, if the target exists."""
    if Files(spark).exists(target):
        raise FileExistsError(target)


def run_steps(spark: SparkSession, operators: list, source: str, target: str, encoding: TextEncoding | None = None, fallback: str = ANSI) -> Result:
    """Operators one after the other, as one plan; the counters are those of the last.

    The result has the encoding of the source, but what is extracted is UTF-8.
    ``fallback`` is the code page of a source that is neither UTF-8 nor UTF-16.
    """
    began = monotonic()
    new(spark, target)
    found = detect_file(spark, source, fallback)
    frame = read_lines(spark, source, found)
    for operator in operators[:-1]:
        frame = operator.apply(frame)
    counts = operators[-1].counts(frame).first()
    ending = operators[-1].line_ending if isinstance(operators[-1], Clean) else "\n"
    plain = any(isinstance(o, Extract) for o in operators)
    written = write_file(operators[-1].apply(frame), target, ending, encoding or (None if plain else found))
    return Result(target, counts["input"], written, counts["affected"], monotonic() - began)


def run(spark: SparkSession, operator, source: str, target: str, encoding: TextEncoding | None = None, fallback: str = ANSI) -> Result:
    return run_steps(spark, [operator], source, target, encoding, fallback)


def merge_files(spark: SparkSession, merge: Merge, sources: list[str], target: str, encoding: TextEncoding | None = None, fallback: str = ANSI) -> Result:
    """Each source by its own encoding; the result has the first one's unless told otherwise."""
    began = monotonic()
    new(spark, target)
    if not sources:
        raise ValueError("an input is needed")
    found = [detect_file(spark, s, fallback) for s in sources]
    # Files of different kinds are ordered by different columns; numbers are common to all.
    frames = [read_lines(spark, s, e).numbered() for s, e in zip(sources, found, strict=True)]
    frames = [f.with_df(f.df.select("line_no", "value")) for f in frames]
    lines = merge.counts(frames).first()["input"]
    write_file(merge.apply(frames), target, encoding=encoding or found[0])
    return Result(target, lines, lines, 0, monotonic() - began)


def compare_files(spark: SparkSession, compare: Compare, a: str, b: str, target: str, fallback: str = ANSI) -> dict[str, int]:
    """The lines asked for, in UTF-8; how many are only in a, only in b, and in both."""
    new(spark, target)
    left, right = (read_lines(spark, f, detect_file(spark, f, fallback)) for f in (a, b))
    counts = compare.counts(left, right).first().asDict()
    write_file(compare.apply(left, right), target)
    return counts


def split_file(spark: SparkSession, split: Split, source: str, folder: str, fallback: str = ANSI) -> list[str]:
    """The parts' paths; they have the encoding of the source."""
    encoding = detect_file(spark, source, fallback)
    return write_parts(read_lines(spark, source, encoding), split, source, folder, encoding=encoding)
