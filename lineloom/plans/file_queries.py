"""Sources, sinks, runs over files, batches and jobs as queries: tables are written as files in the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import search as N
from ..operators.clean import Clean
from ..operators.compare import Compare
from ..operators.frame import LineFrame
from ..operators.merge import Merge
from ..operators.split import Split
from ..sources import state
from ..sources.encoding import UTF8, TextEncoding, detect_file
from ..sources.files import Files, unique_directory, unique_path
from ..sources.scratch import scratch
from ..sources.text import inspect, lines_of, read_large, read_lines, read_text, save_text, write_file, write_folder
from . import runs
from .jobs import Jobs
from .pipeline import Batch, Pipeline, clean_and_dedupe

UTF8_BOM = TextEncoding("utf-8", "UTF-8 BOM", True, 3)
UTF16 = TextEncoding("utf-16-le", "UTF-16 LE", True, 2)
UTF16_PLAIN = TextEncoding("utf-16-be", "UTF-16 BE")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> LineFrame:
    return lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")


def names(prefix: str, spark: SparkSession, sf_dir: str) -> LineFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(prefix), "p_name").alias("value"))
    return LineFrame.of(df, "p_partkey")


def put(spark: SparkSession, frame: LineFrame, name: str = "in.txt", ending: str = "\n", encoding: TextEncoding | None = None, folder: str | None = None) -> str:
    path = f"{folder or scratch(spark, 'files')}/{name}"
    write_file(frame, path, ending, encoding)
    return path


def numbered(frame: LineFrame) -> DataFrame:
    return frame.numbered().df.select("line_no", "value")


def there_and_back(spark, sf_dir, source=documents, ending="\n", encoding=None, fallback="cp1252") -> DataFrame:
    """Lines written with an encoding, which is then detected."""
    path = put(spark, source(spark, sf_dir), ending=ending, encoding=encoding)
    found = inspect(spark, path, fallback=fallback).encoding
    return numbered(read_lines(spark, path, found))


def folder(spark, sf_dir) -> DataFrame:
    path = scratch(spark, "files")
    write_folder(documents(spark, sf_dir), path)
    return numbered(read_lines(spark, path, UTF8))


def inspected(spark, sf_dir) -> DataFrame:
    rows, lines = [], names("", spark, sf_dir)
    for name, ending, encoding in (("a", "\n", None), ("b", "\r\n", UTF8_BOM), ("c", "\n", UTF16), ("d", "\r", TextEncoding("cp1252", "ANSI (cp1252)"))):
        source = names("é ", spark, sf_dir) if name == "d" else lines
        got = inspect(spark, put(spark, source, f"{name}.txt", ending, encoding), normal=50_000)
        rows.append((name, got.encoding.label, got.line_ending, got.size, got.mode == ("normal" if got.size <= 50_000 else "large")))
    return spark.createDataFrame(rows, "name string, label string, line_ending string, size long, mode boolean")


def parts(spark, sf_dir, encoding=None) -> DataFrame:
    """Every line of the parts of a file, with the name of its part."""
    source = put(spark, documents(spark, sf_dir), "data.txt", encoding=encoding)
    folder = scratch(spark, "parts")
    written = runs.split_file(spark, Split("lines", 1_000, padding=4), source, folder)
    (found,) = {detect_file(spark, path) for path in written}
    frame = read_lines(spark, folder, found)  # all parts at once; they are small, so each is numbered by one task
    place = F.row_number().over(Window.partitionBy("file").orderBy(*frame.columns)).cast("long")
    return frame.df.select(F.substring_index("file", "/", -1).alias("file"), place.alias("line_no"), "value")


def merge(spark, sf_dir) -> DataFrame:
    a, b = put(spark, names("", spark, sf_dir), encoding=UTF16), put(spark, names("é ", spark, sf_dir), encoding=TextEncoding("cp1252", "ANSI"))
    target = f"{scratch(spark, 'files')}/merged.txt"
    runs.merge_files(spark, Merge(separator="--"), [a, b], target, UTF8)
    return numbered(read_lines(spark, target))


def compare(spark, sf_dir) -> DataFrame:
    column = lambda name, key, value: LineFrame.of(table(spark, sf_dir, name).select(key, F.expr(value).alias("value")), key)
    a = put(spark, column("nation", "n_nationkey", "n_name"))
    b = put(spark, column("nation", "n_nationkey", "CASE WHEN n_regionkey = 1 THEN concat(n_name, '!') ELSE lower(n_name) END"), encoding=UTF16)
    target = f"{scratch(spark, 'files')}/both.txt"
    counts = runs.compare_files(spark, Compare("both"), a, b, target)
    return read_lines(spark, target).df.select("value", *[F.lit(counts[c]).cast("long").alias(c) for c in ("only_a", "only_b", "both")])


def pipeline(spark, sf_dir, flagship: Pipeline) -> DataFrame:
    """A pipeline that was saved as JSON and loaded, over a file."""
    saved = f"{scratch(spark, 'files')}/pipeline.json"
    save_text(spark, saved, flagship.to_json())
    target = f"{scratch(spark, 'files')}/out.txt"
    result = Pipeline.from_json(read_text(spark, saved)).run(spark, put(spark, documents(spark, sf_dir)), target)
    return numbered(read_lines(spark, target)).withColumn("n", F.lit(result.output_lines).cast("long"))


def batch(spark, sf_dir) -> DataFrame:
    """Cleaning and deduplication over files of several encodings, one of which is missing."""
    base, out = scratch(spark, "files"), scratch(spark, "files")
    sources = [put(spark, names("  ", spark, sf_dir), "a/one.txt", folder=base), put(spark, documents(spark, sf_dir), "two.log", encoding=UTF16, folder=base), f"{base}/none.txt"]
    rows = []
    for r in Batch(clean_and_dedupe(Clean()), "_clean").run(spark, sources, out, base):
        name = r.result.output.removeprefix(out) if r.result else None
        rows.append((r.source.removeprefix(base), name, r.result.input_lines if r.result else None, r.result.output_lines if r.result else None, r.error is not None))
    return spark.createDataFrame(rows, "source string, output string, input long, lines long, failed boolean")


def large(spark, sf_dir) -> DataFrame:
    """The lengths of bounded lines, one of them very long, and their offsets in the file."""
    df = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") == 7, F.repeat("p_name", 5_000)).otherwise(F.col("p_name")).alias("value"))
    lines = read_large(spark, put(spark, LineFrame.of(df, "p_partkey")))
    return lines.numbered().df.select("line_no", F.length("value").cast("long").alias("size"), F.endswith("value", F.lit("[truncated]")).alias("cut"))


def strict(spark, sf_dir) -> DataFrame:
    """Invalid bytes: the strict reader raises, the other one reads on."""
    path = f"{scratch(spark, 'files')}/bad.txt"
    with Files(spark).writing(path) as write:
        write(b"good\n\xff\xfe\xfd\nlast\n")
    try:
        read_lines(spark, path, UTF8).df.collect()
        raised = False
    except Exception as e:
        raised = "INVALID_UTF8" in str(e)
    return read_large(spark, path, UTF8).df.agg(F.count("*").alias("lines"), F.lit(raised).alias("raised"))


def kept_state(spark, sf_dir) -> DataFrame:
    """History and recent files after a round trip through JSON."""
    import datetime

    path, history = f"{scratch(spark, 'files')}/history.json", state.History()
    for k in range(25):
        history.add_lines(datetime.date(2024, 1, 1 + k % 3), k)
        history.add_file(f"/Data/{k % 22}.txt")
    state.save(spark, path, history)
    state.save(spark, path, history)  # replaces the file
    back = state.load(spark, path, state.History)
    rows = [("day", d, n) for d, n in back.lines_by_day.items()] + [("recent", f, k) for k, f in enumerate(back.recent)]
    rows += [("default", k, v) for k, v in vars(state.load(spark, path + ".none", state.Settings)).items()]
    return spark.createDataFrame(rows, "kind string, name string, n long")


def free_names(spark, sf_dir) -> DataFrame:
    folder = scratch(spark, "files")
    rows = []
    for _ in range(3):
        path = unique_path(spark, f"{folder}/data.txt", "_clean")
        save_text(spark, path, "x")
        rows.append((path.rpartition("/")[2],))
        place = unique_directory(spark, f"{folder}/data.txt", "_parts")
        save_text(spark, f"{place}/x.txt", "x")
        rows.append((place.rpartition("/")[2],))
    return spark.createDataFrame(rows, "name string")


def jobs(spark, sf_dir) -> DataFrame:
    """Jobs that end well, fail, are stopped by their limit, and are tried again."""
    pool, tries = Jobs(spark, parallel=2), []

    def second_time(s: SparkSession) -> int:
        tries.append(1)
        if len(tries) == 1:
            raise ValueError("not yet")
        return table(s, sf_dir, "orders").count()

    done = [pool.submit("count", lambda s: table(s, sf_dir, "orders").count()), pool.submit("again", second_time), pool.submit("slow", lambda s: s.range(1 << 50).selectExpr("sum(id % 7)").collect(), limit=2.0)]
    for job in done:
        pool.wait(job)
    first = [(j.name + ", first try", j.state, 0) for j in done if j.name == "again"]
    pool.wait(pool.retry(done[1]))
    rows = first + [(j.name, j.state, j.result or 0) for j in done]
    return spark.createDataFrame(rows, "name string, state string, result long")


def editor(spark, sf_dir) -> DataFrame:
    """The last place of a word before a place, the text with it replaced, and a bounded text."""
    df = table(spark, sf_dir, "documents").select("doc_id", "text", N.find_previous(F.col("text"), "the", 500, case_sensitive=True).alias("place"))
    replaced = F.when(F.col("place").isNotNull(), N.replace_at(F.col("text"), F.col("place"), 3, "[THE]")).otherwise(F.col("text"))
    return df.select("doc_id", "place", F.md5(replaced.cast("binary")).alias("replaced"), F.length(N.bounded(F.col("text"), 100, "~")).alias("bounded"))


def percents(spark, sf_dir) -> DataFrame:
    n = documents(spark, sf_dir).df.count()
    return spark.createDataFrame([(p, N.line_at_percent(n, p)) for p in (0, 25, 50, 100)], "percent int, line long")
