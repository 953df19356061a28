import datetime as dt
import os
import random
import re

import pytest

from lineloom.operators.clean import Clean
from lineloom.operators.columns import Columns
from lineloom.operators.compare import Compare
from lineloom.operators.dedupe import Dedupe
from lineloom.operators.extract import Extract
from lineloom.operators.filter import Filter, Rule
from lineloom.operators.merge import Merge
from lineloom.operators.sort import Sort
from lineloom.operators.split import Split
from lineloom.plans import runs
from lineloom.plans.pipeline import Batch, Pipeline, Step, clean_and_dedupe
from lineloom.sources import encoding as E
from lineloom.sources import state
from lineloom.sources import text as X
from lineloom.sources.files import Files, unique_directory, unique_path
from lineloom.sources.scratch import stash


@pytest.fixture
def put(tmp_path):
    def write(name, data):
        (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(tmp_path / name)

    return write


def test_encodings():
    assert E.detect("Türkçe".encode("utf-8-sig")) == E.TextEncoding("utf-8", "UTF-8 BOM", True, 3)
    assert E.detect("Türkçe".encode("utf-16")).label == "UTF-16 LE"
    assert E.detect(b"\xfe\xff\0a").label == "UTF-16 BE"
    assert E.detect("plain text".encode("utf-16-le")).name == "utf-16-le"
    assert E.detect("plain text".encode("utf-16-be")).name == "utf-16-be"
    assert E.detect("Türkçe".encode("cp1254"), fallback="cp1254").name == "cp1254"
    cut = ("x" * (E.SAMPLE_BYTES - 1) + "é").encode()[: E.SAMPLE_BYTES]
    assert E.detect(cut).name == "utf-8"
    assert E.detect(cut, whole=True).name == "cp1252"
    with pytest.raises(ValueError):
        E.detect(b"\xff\xfe\0\0a\0\0\0")


def test_line_endings():
    assert [E.line_ending(t) for t in ("a\r\nb\n", "a\nb\n\r", "a\rb", "a")] == ["CRLF", "LF", "CR", "unknown"]


@pytest.mark.parametrize("codec, name", [("utf-8", None), ("utf-8-sig", None), ("utf-16", None), ("utf-16-le", None), ("cp1254", "cp1254")])
def test_reading(spark, put, lines, codec, name):
    given = "a\r\nbü\rc\n\nd ş"
    path = put("in.txt", given.encode(codec))
    encoding = E.TextEncoding(name, name) if name else None
    assert lines(X.read_lines(spark, path, encoding)) == ["a", "bü", "c", "", "d ş"]
    assert lines(X.read_lines(spark, path, encoding, only_lf=True)) == ["a", "bü\rc", "", "d ş"]


def test_order_over_many_splits(spark, put, lines):
    given = [f"line {n}" for n in range(5_000)]
    path = put("many.txt", "\n".join(given) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        frame = X.read_lines(spark, path)
        assert frame.df.rdd.getNumPartitions() > 10
        assert lines(frame) == given
        assert [r[0] for r in frame.numbered().df.orderBy("line_no").select("value").collect()] == given
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_invalid_utf8_raises(spark, put):
    path = put("bad.txt", b"ok\n" + b"\xff\xff\n")
    frame = X.read_lines(spark, path, E.TextEncoding("utf-8", "UTF-8"))
    with pytest.raises(Exception, match="INVALID_UTF8"):
        frame.df.collect()


def test_writing(spark, tmp_path, frame):
    f = frame(["b", "a", "ü"], 3)
    path = str(tmp_path / "out.txt")
    assert X.write_file(f, path, "\r\n") == 3
    assert open(path, "rb").read() == "b\r\na\r\nü\r\n".encode()
    with pytest.raises(FileExistsError):
        X.write_file(f, path)
    X.write_file(f, str(tmp_path / "wide.txt"), encoding=E.TextEncoding("utf-16-le", "UTF-16 LE", True, 2))
    assert open(tmp_path / "wide.txt", "rb").read().decode("utf-16") == "b\na\nü\n"
    X.write_folder(f, str(tmp_path / "folder"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        X.write_folder(f, str(tmp_path / "folder"))
    bad = f.with_df(f.df.selectExpr("at", "raise_error('no') AS value"))
    with pytest.raises(Exception, match="no"):
        X.write_file(bad, str(tmp_path / "half.txt"))
    assert not [n for n in os.listdir(tmp_path) if "half" in n]


def test_parts(spark, tmp_path, put, lines):
    source = put("data.csv", "id,name\n1,a\n2,b\n3,c\n4,d\n")
    written = X.write_parts(X.read_lines(spark, source), Split("lines", 2), source, str(tmp_path / "parts"))
    assert [os.path.basename(p) for p in written] == ["data_part_001.csv", "data_part_002.csv", "data_part_003.csv"]
    assert [open(p).read() for p in written] == ["id,name\n1,a\n", "2,b\n3,c\n", "4,d\n"]


def test_save_and_load(spark, put):
    path = put("doc.txt", "old")
    X.save_text(spark, path, "new content")
    assert X.read_text(spark, path) == "new content"
    assert [n for n in os.listdir(os.path.dirname(path)) if n.endswith(".tmp")] == []
    with pytest.raises(ValueError):
        X.read_text(spark, path, most=3)


def test_inspect(spark, put):
    got = X.inspect(spark, put("a.log", "x\r\ny\r\n"))
    assert (got.size, got.encoding.label, got.line_ending, got.mode) == (6, "UTF-8", "CRLF", "normal")
    assert X.inspect(spark, put("b.log", "xxxx"), normal=3).mode == "large"
    assert X.is_supported("A.JSONL") and not X.is_supported("a.exe")
    with pytest.raises(FileNotFoundError):
        X.inspect(spark, "/no/such/file")


def test_names(spark, put, tmp_path):
    path = put("03_columns.csv", "")
    assert unique_path(spark, path, "_x") == str(tmp_path / "03_columns_x.csv")
    put("03_columns_x.csv", "")
    assert unique_path(spark, path, "_x") == str(tmp_path / "03_columns_x_2.csv")
    (tmp_path / "03_columns_parts").mkdir()
    put("03_columns_parts_2", "")
    assert unique_directory(spark, path, "_parts") == str(tmp_path / "03_columns_parts_3")


def test_generator(spark, lines):
    got = lines(X.generate(spark, 17))
    assert got[0] == "000000000001|dataset|user000001@example.test|https://example.test/items/1"
    assert got[16].split("|")[1] == "duplicate-heavy"
    size = sum(len(v) + 1 for v in lines(X.generate_bytes(spark, 10_000)))
    assert 10_000 <= size < 10_100


def test_state(spark, tmp_path):
    path = str(tmp_path / "state" / "history.json")
    history = state.load(spark, path, state.History)
    history.add_lines(dt.date(2024, 1, 2), 5)
    history.add_lines(dt.date(2024, 1, 2), 7)
    for p in ("/a", "/b", "/A"):
        history.add_file(p)
    state.save(spark, path, history)
    assert state.load(spark, path, state.History) == history == state.History({"2024-01-02": 12}, ["/A", "/b"])
    state.save(spark, path, state.Settings(parallel_files=4))
    assert state.load(spark, path, state.Settings).parallel_files == 4


FLOW = Pipeline("p", (Step("clean"), Step("sort", enabled=False), Step("filter", Filter((Rule("contains", "apple"),))), Step("dedupe")))


def test_pipeline(spark, put, tmp_path, frame, lines):
    f = frame(["  apple ", "pear", "apple", "  "])
    assert lines(FLOW.apply(f)) == ["apple"]
    assert [c["output"] for c in FLOW.counts(f)] == [3, 2, 1]
    assert Pipeline.from_json(FLOW.to_json()) == FLOW
    every = Pipeline("all", (Step("extract", Extract("email")), Step("sort", Sort("natural")), Step("dedupe", Dedupe(keep="last")), Step("clean", Clean(case="upper"))))
    assert Pipeline.from_json(every.to_json()) == every
    for bad in (Pipeline("none"), Pipeline("off", (Step("clean", enabled=False),)), Pipeline("x", (Step("filter"),)), Pipeline("y", (Step("no"),))):
        with pytest.raises(ValueError):
            bad.operators()
    source = put("in.txt", "  apple \npear\napple\n  \n")
    got = FLOW.run(spark, source, str(tmp_path / "out.txt"))
    assert (got.input_lines, got.output_lines, got.affected) == (2, 1, 1)
    assert open(got.output).read() == "apple\n"
    with pytest.raises(FileExistsError):
        FLOW.run(spark, source, got.output)
    assert lines(clean_and_dedupe().apply(f)) == ["apple", "pear"]


def test_runs_over_files(spark, put, tmp_path):
    one, two = put("one.txt", "b;1\na;2\nbad\n"), put("two.txt", "ü;3\nA;2".encode("utf-16"))
    out = lambda name: str(tmp_path / "out" / name)
    got = runs.run(spark, Columns(";", "extract", 1), one, out("col.txt"))
    assert (got.input_lines, got.output_lines, got.affected, open(got.output).read()) == (3, 2, 1, "1\n2\n")
    got = runs.run(spark, Sort("alpha"), two, out("sorted.txt"))
    assert open(got.output, "rb").read().decode("utf-16") == "A;2\nü;3\n"
    got = runs.merge_files(spark, Merge(), [one, two], out("merged.txt"))
    assert (got.input_lines, open(got.output).read()) == (5, "b;1\na;2\nbad\n\nü;3\nA;2\n")
    assert runs.compare_files(spark, Compare("both"), one, two, out("both.txt")) == {"only_a": 2, "only_b": 1, "both": 1}
    assert open(out("both.txt")).read() == "a;2\n"
    assert [open(p, "rb").read().decode("utf-16") for p in runs.split_file(spark, Split("lines", 1), two, out("parts"))] == ["ü;3\n", "A;2\n"]
    for again in (lambda: runs.run(spark, Sort(), one, out("col.txt")), lambda: runs.merge_files(spark, Merge(), [one], out("col.txt"))):
        with pytest.raises(FileExistsError):
            again()
    assert open(out("col.txt")).read() == "1\n2\n"


def test_batch(spark, put, tmp_path):
    good, missing, other = put("a.txt", "apple\napple\n"), str(tmp_path / "none.txt"), put("b.txt", "apple pie\n")
    batch = Batch(FLOW, "_x")
    got = batch.run(spark, [good, missing, other], str(tmp_path / "out"), base=str(tmp_path))
    assert [r.source for r in got] == [good, missing, other]
    assert [r.result is not None for r in got] == [True, False, True] and got[1].error
    assert open(tmp_path / "out" / "a_x.txt").read() == "apple\n"
    batch.cancel(spark)
    assert all(r.cancelled for r in batch.run(spark, [good], str(tmp_path / "later")))
    assert not Files(spark).exists(str(tmp_path / "later"))


def test_streams(spark, put, tmp_path):
    from lineloom.streaming import stateless

    (tmp_path / "feed").mkdir()
    put("feed/1.txt", " keep me \ndrop\n\nKEEP too\n")
    stream = stateless.apply(stateless.read_stream(spark, str(tmp_path / "feed")), Clean(), Filter((Rule("contains", "keep"),)))
    query = stream.writeStream.format("memory").queryName("feed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r[0] for r in spark.table("feed").collect()) == ["KEEP too", "keep me"]
    with pytest.raises(TypeError):
        stateless.apply(stream, Dedupe())


def test_parts_with_marks_and_other_encodings(spark, tmp_path, put, lines):
    given = [f"zeile {n} ü" for n in range(50)]
    for name, encoding in (("bom", E.TextEncoding("utf-8", "UTF-8 BOM", True, 3)), ("wide", E.TextEncoding("utf-16-le", "UTF-16 LE", True, 2))):
        source = put(f"{name}.txt", ("\ufeff" + "\n".join(given) + "\n").encode(encoding.name))
        written = runs.split_file(spark, Split("lines", 20), source, str(tmp_path / f"{name}_parts"))
        texts = [open(p, "rb").read().decode("utf-8-sig" if name == "bom" else "utf-16") for p in written]
        assert "".join(texts) == "\n".join(given) + "\n" and [t.count("\n") for t in texts] == [20, 20, 10]
        if name == "bom":
            assert all(open(p, "rb").read().startswith(b"\xef\xbb\xbf") for p in written)
    taken = tmp_path / "taken"
    taken.mkdir()
    (taken / "bom_part_002.txt").write_text("here")
    with pytest.raises(FileExistsError):
        runs.split_file(spark, Split("lines", 20), str(tmp_path / "bom.txt"), str(taken))
    assert sorted(os.listdir(taken)) == ["bom_part_002.txt"] and (taken / "bom_part_002.txt").read_text() == "here"


def test_large_files_have_bounded_lines(spark, put):
    path = put("huge.txt", "x" * 2_000_000 + "\nshort\r\n")
    first, second = (r[0] for r in X.read_large(spark, path).lines().collect())
    assert len(first) < 150_000 and first.endswith("[truncated]") and second == "short"


def test_a_code_page_may_be_chosen(spark, put, tmp_path, lines):
    path = put("tr.txt", "ş ı\n".encode("cp1254"))
    assert X.inspect(spark, path, fallback="cp1254").encoding.name == "cp1254"
    assert X.read_text(spark, path, fallback="cp1254") == "ş ı\n"
    target = str(tmp_path / "out.txt")
    runs.run(spark, Clean(), path, target, fallback="cp1254")
    assert open(target, "rb").read() == "ş ı\r\n".encode("cp1254")
    Batch(Pipeline("p", (Step("clean"),)), fallback="cp1254").run(spark, [path], str(tmp_path / "b"))
    assert open(tmp_path / "b" / "tr_result.txt", "rb").read() == "ş ı\r\n".encode("cp1254")


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    from lineloom.sources import scratch as T

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "a"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        T.scratch(Session(), "x")
    assert T.scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    table = T.stash(spark.range(3), "numbers")
    assert table.count() == 3
    T.discard(table)
    assert not Files(spark).exists(table._scratch)


def test_stashed_tables_have_no_marker_file(spark):
    """Each file that the driver makes on a local disk is a process of its own, with the driver's memory for an instant."""
    back = stash(spark.range(10).repartition(3), "marker")
    assert sorted(r[0] for r in back.collect()) == list(range(10))
    assert all(n.startswith("part-") for n in Files(spark).names(back._scratch))


@pytest.mark.parametrize("codec", ["utf-16-le", "utf-16-be"])
@pytest.mark.parametrize("bom", [True, False])
@pytest.mark.parametrize("step", ["317", "64m"])
def test_wide_files_are_read_in_splits(spark, put, lines, codec, bom, step):
    """Every ending, empty lines, marks inside, and characters whose halves look like a LF, wherever a split begins."""
    rng = random.Random(codec + step)
    # U+0A41 and U+4E00 in a row hold the bytes 0A 4E or 00 0A; U+0100 U+0A00 and U+0A01 U+0100 do in either order.
    some = ["a", "ü", "﻿", "😀", "ੁ", "一", "Ā", "ਁĀ", "Āਊ", "ਊ", "\r", "\n", "\r\n", "\n\n"]
    given = "first" + "".join(rng.choice(some) for _ in range(3_000)) + "\nlast"
    plain = re.split("\r\n|\n|\r", given)
    encoding = E.TextEncoding(codec, codec, bom, 2 * bom)
    spark.conf.set("spark.sql.files.maxPartitionBytes", step)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for name, text, expected in (("none", "", []), ("end", given + "\r", plain), ("odd", given, plain), ("usual", "x\r\n\r\ny\r\rz\n", ["x", "", "y", "", "z"])):
            frame = X.read_lines(spark, put(name, (("﻿" if bom else "") + text).encode(codec)), encoding)
            assert lines(frame) == expected
            if text == given and step == "317":
                assert frame.df.select("block").distinct().count() > 4
        assert lines(X.read_lines(spark, put("lf", ("﻿" * bom + "a\rb\r\nc").encode(codec)), encoding, only_lf=True)) == ["a\rb", "c"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_wide_files_are_written_by_executors(spark, tmp_path, frame, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", None)
    f = frame(["a", "", "ü 😀", "ਁĀ"], 3)
    for codec, bom in (("utf-16-le", True), ("utf-16-be", False)):
        path = str(tmp_path / codec)
        assert X.write_file(f, path, "\r\n", E.TextEncoding(codec, codec, bom, 2 * bom)) == 4
        assert open(path, "rb").read() == ("﻿" * bom + "a\r\n\r\nü 😀\r\nਁĀ\r\n").encode(codec)
        parts = X.write_parts(f, Split("lines", 3), path, str(tmp_path / f"{codec}_parts"), encoding=E.TextEncoding(codec, codec, bom, 2 * bom))
        assert [open(p, "rb").read() for p in parts] == [("﻿" * bom + t).encode(codec) for t in ("a\n\nü 😀\n", "ਁĀ\n")]
