"""Files of lines in and out."""

from __future__ import annotations

import functools
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.frame import LineFrame
from ..operators.search import MOST_CHARACTERS, bounded
from .encoding import ANSI, SAMPLE_BYTES, UTF8, TextEncoding, detect, detect_file, line_ending
from .files import Files
from .scratch import discard, remove, scratch, stash

#: Endings that are taken for text.
ENDINGS = (".txt", ".log", ".csv", ".tsv", ".jsonl")
NORMAL_BYTES = 32 << 20


def is_supported(path: str) -> bool:
    return path.lower().endswith(ENDINGS)


def _decoded(encoding, batches):
    for batch in batches:
        texts = [bytes(b).decode(encoding).removeprefix("﻿") for b in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["path", "text"])


def _is_wide(encoding: TextEncoding) -> bool:
    return encoding.name.startswith("utf-16")


def _charset(encoding: TextEncoding) -> str:
    return "UTF-16BE" if encoding.name == "utf-16-be" else "UTF-16LE"


def read_lines(spark: SparkSession, path: str, encoding: TextEncoding | None = None, only_lf: bool = False, strict: bool = True, most: int | None = None) -> LineFrame:
    """The lines of a file, or of the files of a folder, in order.

    CR, LF and CRLF end a line; with ``only_lf`` LF alone does, and CRs before it are cut.
    UTF-8 and UTF-16 are read in splits; what lies between two LFs of a UTF-16 file must
    fit in a task.  Code pages are decoded a file at a time, and such a file must fit.  Invalid bytes raise when the
    line is read, unless not ``strict``.  ``most``: longer lines are cut to so many
    characters and marked; the task that cuts a line holds that one line.
    """
    frame = _read(spark, path, encoding or detect_file(spark, path), only_lf, strict)
    return frame if most is None else frame.with_df(frame.df.withColumn("value", bounded(F.col("value"), most)))


def read_large(spark: SparkSession, path: str, encoding: TextEncoding | None = None) -> LineFrame:
    """The lines of a large file: LF alone ends a line, invalid bytes are replaced, and lines are bounded."""
    frame = read_lines(spark, path, encoding, only_lf=True, strict=False, most=MOST_CHARACTERS)
    return frame.with_df(frame.df.withColumn("value", F.make_valid_utf8("value")))


def _read(spark: SparkSession, path: str, encoding: TextEncoding, only_lf: bool, strict: bool) -> LineFrame:
    if encoding.name == "utf-8":
        reader = spark.read.option("lineSep", "\n") if only_lf else spark.read
        df = reader.text(path).select(
            "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
        )
        if strict:
            df = df.withColumn("value", F.validate_utf8("value"))
        if only_lf:
            df = df.withColumn("value", F.regexp_replace("value", "^\\x{FEFF}|\\r+$", ""))
        return LineFrame.of(df, "file", "block", "at")
    if _is_wide(encoding):
        return _read_wide(spark, path, encoding, only_lf)
    files = spark.read.format("binaryFile").load(path)
    texts = files.select("path", "content").mapInArrow(functools.partial(_decoded, encoding.name), "path string, text string").toDF("file", "text")
    ends = "\\r*\\n" if only_lf else "\\r\\n|\\n|\\r"
    lines = F.split("text", ends, -1)
    # What follows the last terminator is a line only if it is not empty.
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return LineFrame.of(texts.select("file", F.posexplode(lines).alias("at", "value")), "file", "at")


def _read_wide(spark: SparkSession, path: str, encoding: TextEncoding, only_lf: bool) -> LineFrame:
    """The lines of UTF-16 files, read in splits that end at the bytes of a LF.

    These two bytes may also be the halves of two characters.  Then, and only then, what
    is before them has an odd number of bytes; ``_aligned`` puts such pieces together.
    """
    lf = "\n".encode(_charset(encoding)).decode()
    raw = spark.read.option("lineSep", lf).text(path).select(
        F.col("value").cast("binary").alias("bytes"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_size").alias("size"),
    )
    if encoding.bom:
        mark = F.lit("\ufeff".encode(_charset(encoding)))
        heads = raw.where("block = 0").groupBy("file").agg(F.min("at").alias("at"), F.lit(True).alias("head"))  # a row for each file
        marked = F.col("head").isNotNull() & F.startswith("bytes", mark)
        # A mark with nothing behind it is no line.
        raw = raw.join(F.broadcast(heads), ["file", "at"], "left").where(~marked | (F.col("size") > 2))
        raw = raw.withColumn("bytes", F.when(marked, F.substring("bytes", 3, 0x7FFFFFFF)).otherwise(F.col("bytes")))
    raw = raw.select("file", "block", "at", "bytes")
    odd = F.octet_length("bytes") % 2 == 1
    if not raw.where(odd).limit(1).isEmpty():
        raw = _aligned(raw, odd, lf)
    text = F.decode("bytes", _charset(encoding))
    if only_lf:
        return LineFrame.of(raw.select("file", "block", "at", F.regexp_replace(text, "\r+$", "").alias("value")), "file", "block", "at")
    lines = F.split("text", "\r", -1)
    # A CR before the LF, or at the end of the file, ends no further line.
    lines = F.when((F.size(lines) > 1) & (F.element_at(lines, -1) == ""), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return LineFrame.of(raw.withColumn("text", text).select("file", "block", "at", F.posexplode(lines).alias("cr", "value")), "file", "block", "at", "cr")


def _aligned(raw: DataFrame, odd: Column, lf: str) -> DataFrame:
    """(file, block, at, bytes) of whole lines: a piece with an odd number of bytes goes on to the next such piece."""
    blocks = raw.groupBy("file", "block").agg(F.count_if(odd).alias("n"))
    past = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(past("file", "block")), F.lit(0)).alias("base"))
    pieces = raw.join(blocks, ["file", "block"]).withColumn("seen", F.col("base") + F.count_if(odd).over(past("file", "block", "at")))
    apart = odd | (F.col("seen") % 2 == 1)
    # The pieces of a line are gathered, and so are in one task, as the line is.
    runs = pieces.where(apart).groupBy("file", F.floor(F.col("seen") / 2).alias("run")).agg(F.sort_array(F.collect_list(F.struct("block", "at", "bytes"))).alias("own"))
    whole = F.array_join(F.transform("own", lambda x: x["bytes"].cast("string")), lf).cast("binary")
    runs = runs.select("file", F.col("own")[0]["block"].alias("block"), F.col("own")[0]["at"].alias("at"), whole.alias("bytes"))
    return pieces.where(~apart).select("file", "block", "at", "bytes").union(runs)


def read_text(spark: SparkSession, path: str, most: int = NORMAL_BYTES, fallback: str = ANSI) -> str:
    """A whole file of normal size."""
    files = Files(spark)
    if files.status(path)[1] > most:
        raise ValueError(f"larger than {most} bytes: {path}")
    data = files.read(path)
    return data.decode(detect(data[:SAMPLE_BYTES], whole=len(data) <= SAMPLE_BYTES, fallback=fallback).name).removeprefix("﻿")


def save_text(spark: SparkSession, path: str, text: str, encoding: TextEncoding | None = None) -> None:
    """Replace a file, as a whole or not at all."""
    encoding = encoding or UTF8
    with Files(spark).writing(path, overwrite=True) as write:
        write((("﻿" if encoding.bom else "") + text).encode(encoding.name))


def write_folder(frame: LineFrame, path: str, ending: str = "\n") -> None:
    """The lines in order as part files of a new folder, by all executors; an existing one raises."""
    frame.lines().write.mode("errorifexists").option("lineSep", ending).text(path)


def write_file(frame: LineFrame, path: str, ending: str = "\n", encoding: TextEncoding | None = None) -> int:
    """The lines in order as one new file; how many.

    UTF-8 and UTF-16 are written in parts by all executors and joined by the driver's JVM,
    which copies bytes.  Code pages go line by line through the driver, with as much
    memory as a partition takes.
    """
    encoding = encoding or UTF8
    spark = frame.df.sparkSession
    with Files(spark).writing(path) as write:  # it raises first if the file exists
        if encoding.bom:
            write("\ufeff".encode(encoding.name))
        if _by_executors(encoding):
            return _join(frame, write, ending, encoding)
        block: list[str] = []
        n = 0
        for row in frame.lines().toLocalIterator(prefetchPartitions=True):
            block.append(row[0])
            n += 1
            if len(block) == 8192:
                write((ending.join(block) + ending).encode(encoding.name))
                block.clear()
        if block:
            write((ending.join(block) + ending).encode(encoding.name))
        return n


def _by_executors(encoding: TextEncoding) -> bool:
    return encoding.name == "utf-8" or _is_wide(encoding)


def _bytes(encoding: TextEncoding, value: Column) -> Column:
    """A line as the text writer, which copies bytes, is to write it."""
    return F.encode(value, _charset(encoding)).cast("string") if _is_wide(encoding) else value


def _ending(encoding: TextEncoding, ending: str) -> str:
    return ending.encode(_charset(encoding)).decode() if _is_wide(encoding) else ending


def _join(frame: LineFrame, write, ending: str, encoding: TextEncoding) -> int:
    spark = frame.df.sparkSession
    parts, seen = scratch(spark, "parts"), Observation()
    try:
        lines = frame.lines().observe(seen, F.count("*").alias("n")).select(_bytes(encoding, F.col("value")).alias("value"))
        lines.write.option("lineSep", _ending(encoding, ending)).text(parts)
        for name in Files(spark).names(parts):
            if name.startswith("part-"):
                write(f"{parts}/{name}")
        return seen.get["n"]
    finally:
        remove(spark, parts)


def write_parts(frame: LineFrame, split, source: str, folder: str, ending: str = "\n", encoding: TextEncoding | None = None) -> list[str]:
    """A file for each part of a split, in order; if one fails, those written go.

    In UTF-8 and UTF-16 one Spark job writes them all, a task for each part at a time, and
    the files are then renamed; in code pages each goes through the driver.
    """
    encoding = encoding or UTF8
    spark, files = frame.df.sparkSession, Files(frame.df.sparkSession)
    parts = split.apply(frame)
    parts = parts.with_df(stash(parts.df.select("line_no", "part", "value"), "split"))
    draft = scratch(spark, "parts")
    written: list[str] = []
    try:
        if _by_executors(encoding):
            count = _write_parts(parts.df, draft, ending, encoding)
        else:
            count = parts.df.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
        for k in range(1, count + 1):
            path = f"{folder}/{split.name(source, k)}"
            if _by_executors(encoding):
                (own,) = files.names(f"{draft}/part={k}")
                files.bring(f"{draft}/part={k}/{own}", path)
            else:
                write_file(parts.with_df(parts.df.where(F.col("part") == k)), path, ending, encoding)
            written.append(path)
    except BaseException:
        for path in written:
            files.delete(path)
        raise
    finally:
        discard(parts.df)
        remove(spark, draft)
    return written


def _write_parts(df: DataFrame, folder: str, ending: str, encoding: TextEncoding) -> int:
    """A folder for each part, with one file; how many parts."""
    first = F.row_number().over(Window.partitionBy("part").orderBy("line_no")) == 1
    seen = Observation()
    df = df.observe(seen, F.coalesce(F.max("part"), F.lit(0)).alias("n"))
    if encoding.bom:
        df = df.withColumn("value", F.when(first, F.concat(F.lit("\ufeff"), "value")).otherwise(F.col("value")))
    df = df.repartition("part").sortWithinPartitions("part", "line_no").select(_bytes(encoding, F.col("value")).alias("value"), "part")
    df.write.option("lineSep", _ending(encoding, ending)).option("maxRecordsPerFile", 0).partitionBy("part").text(folder)
    return seen.get["n"]


@dataclass(frozen=True)
class TextFile:
    path: str
    size: int
    modified: datetime
    encoding: TextEncoding
    line_ending: str
    mode: str


def inspect(spark: SparkSession, path: str, normal: int = NORMAL_BYTES, fallback: str = ANSI) -> TextFile:
    files = Files(spark)
    _, size, modified = files.status(path)
    sample = files.head(path, SAMPLE_BYTES)
    encoding = detect(sample, whole=size <= SAMPLE_BYTES, fallback=fallback)
    text = sample[encoding.preamble :].decode(encoding.name, "ignore")
    return TextFile(path, size, datetime.fromtimestamp(modified / 1000, UTC), encoding, line_ending(text), "normal" if size <= normal else "large")


def generate(spark: SparkSession, lines: int) -> LineFrame:
    """Numbered synthetic lines of four columns, every 17th of them in a frequent category."""
    n = F.col("id") + 1
    # The lines are to be these.
    kind = F.when(n % 17 == 0, "duplicate-heavy").otherwise("dataset")
    user = F.format_string("user%06d@example.test", n % 100_000)
    item = F.format_string("https://example.test/items/%d", n % 10_000)
    df = spark.range(lines).select(n.alias("line_no"), F.concat_ws("|", F.lpad(n.cast("string"), 12, "0"), kind, user, item).alias("value"))
    return LineFrame.of(df, "line_no")


def generate_bytes(spark: SparkSession, size: int, newline_bytes: int = 1) -> LineFrame:
    """So many lines that they take ``size`` bytes or a little more; no line is shorter than 63 bytes."""
    frame = generate(spark, size // 63 + 1)
    from ..operators.running import before

    df = before(frame.df, "line_no", F.octet_length("value") + newline_bytes, "_past")
    return frame.with_df(df.where(F.col("_past") < size).drop("_past"))


def lines_of(df: DataFrame, id_col: str, text_col: str) -> LineFrame:
    """The lines of the texts of a table, ordered by (id, position)."""
    return LineFrame.of(df.select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "value")), id_col, "pos")
