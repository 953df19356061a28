"""Operators that look at one line at a time run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.clean import Clean
from ..operators.columns import Columns
from ..operators.filter import Filter
from ..operators.frame import LineFrame


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New text files of a folder, line by line."""
    return spark.readStream.text(folder)


def apply(stream: DataFrame, *operators: Clean | Filter | Columns) -> DataFrame:
    """The operators over a stream of lines; those that need all lines are refused."""
    frame = LineFrame(stream, ())
    for operator in operators:
        if not isinstance(operator, (Clean, Filter, Columns)):
            raise TypeError(f"{type(operator).__name__} needs all lines")
        frame = operator.apply(frame)
    return frame.df
