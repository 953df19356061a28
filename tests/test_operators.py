import random
import re

import pytest

from lineloom.operators import search as N
from lineloom.operators.clean import Clean
from lineloom.operators.columns import Columns
from lineloom.operators.compare import Compare
from lineloom.operators.dedupe import Dedupe
from lineloom.operators.extract import Extract
from lineloom.operators.filter import Filter, Rule
from lineloom.operators.merge import Merge
from lineloom.operators.sort import Sort
from lineloom.operators.split import Split
from lineloom.operators.statistics import statistics

ODD = ["  alpha   beta  ", "   ", " gamma ", "", "straße ıiİ éΣς 😀", " nbsp　", "a\u0085b", "\tTab  two", "Alpha", "alpha", "ſ", "😀", "～", "z", "12", "x" * 300]


def upper(text):
    return "".join(c.upper() if len(c.upper()) == 1 and c not in "ıſ" else c for c in text)


def len16(text):
    return len(text.encode("utf-16-le")) // 2


# --- clean


def test_clean(frame, lines):
    f = frame(["  alpha   beta  ", "   ", " gamma "])
    op = Clean(normalise_space=True)
    assert lines(op.apply(f)) == ["alpha beta", "gamma"]
    assert op.counts(f).first().asDict() == {"input": 3, "output": 2, "affected": 3}


SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"


def clean_model(line, o):
    v = line.strip(SPACES) if o.trim else line
    if o.drop_blank and not v.strip(SPACES) or o.drop_empty and v == "":
        return None
    if o.normalise_space:
        v = re.sub(f"[{SPACES}]+", " ", v)
    elif o.squeeze_blanks:
        v = re.sub(" {2,}", " ", v)
    if o.min_length is not None and len16(v) < o.min_length or o.max_length is not None and len16(v) > o.max_length:
        return None
    lower = lambda t: "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
    return {"none": str, "upper": upper, "lower": lower}[o.case](v)


@pytest.mark.parametrize(
    "options",
    [
        Clean(),
        Clean(trim=False),
        Clean(trim=False, drop_blank=False),
        Clean(trim=False, drop_blank=False, drop_empty=False, squeeze_blanks=True),
        Clean(normalise_space=True, squeeze_blanks=True, case="upper"),
        Clean(case="lower", min_length=2, max_length=17),
    ],
)
def test_clean_against_a_model(frame, lines, options):
    f = frame(ODD, parts=3)
    model = [clean_model(v, options) for v in ODD]
    assert lines(options.apply(f)) == [v for v in model if v is not None]
    counts = options.counts(f).first()
    assert counts["affected"] == sum(m is None or m != v for v, m in zip(ODD, model, strict=True))


# --- filter


def test_filter(frame, lines):
    f = frame(["apple", "apricot", "pear", "APPLE PIE"])
    op = Filter((Rule("starts", "ap"), Rule("longer", "5")))
    assert lines(op.apply(f)) == ["apricot", "APPLE PIE"]
    assert op.counts(f).first().asDict() == {"input": 4, "output": 2, "affected": 2}


@pytest.mark.parametrize(
    "rule, test",
    [
        (Rule("contains", "ALPHA"), lambda v: "ALPHA" in upper(v)),
        (Rule("contains", ""), lambda v: True),
        (Rule("not_contains", "a", case_sensitive=True), lambda v: "a" not in v),
        (Rule("starts", "STRA"), lambda v: upper(v).startswith("STRA")),
        (Rule("ends", "\U0001f600"), lambda v: v.endswith("\U0001f600")),
        (Rule("equals", "ALPHA"), lambda v: upper(v) == "ALPHA"),
        (Rule("not_equals", "alpha", case_sensitive=True), lambda v: v != "alpha"),
        (Rule("regex", "^al"), lambda v: upper(v).startswith("AL")),
        (Rule("not_regex", "[0-9]"), lambda v: not re.search("[0-9]", v)),
        (Rule("longer", "2"), lambda v: len16(v) > 2),
        (Rule("shorter", "2"), lambda v: len16(v) < 2),
        (Rule("length_between", "5", "2"), lambda v: 2 <= len16(v) <= 5),
    ],
)
def test_conditions(frame, lines, rule, test):
    assert lines(Filter((rule,)).apply(frame(ODD, parts=2))) == [v for v in ODD if test(v)]


def test_filter_or_and_errors(frame, lines):
    f = frame(["a", "bb", "ccc"])
    assert lines(Filter((Rule("equals", "a"), Rule("longer", "2")), "or").apply(f)) == ["a", "ccc"]
    for bad in (Filter(()), Filter((Rule("regex", "("),)), Filter((Rule("longer", "+3"),)), Filter((Rule("length_between", "3"),)), Filter((Rule("no", ""),))):
        with pytest.raises(ValueError):
            bad.apply(f)


# --- dedupe


def test_dedupe(frame, lines):
    f = frame(["Alpha", "beta", "alpha", "beta", "gamma"], parts=3)
    op = Dedupe(case_sensitive=False)
    assert lines(op.apply(f)) == ["Alpha", "beta", "gamma"]
    assert op.counts(f).first()["affected"] == 2
    assert lines(Dedupe(keep="last").apply(frame(["a", "b", "a", "c", "b"]))) == ["a", "c", "b"]


def test_dedupe_after_sort_keeps_the_first_in_that_order(frame, lines):
    f = Sort("longest").apply(frame(["b", "aa", "B", "AA", "c"]))
    assert lines(Dedupe(case_sensitive=False).apply(f)) == ["aa", "c", "b"]


# --- sort

MIXED = ["10", "2", "1e3", "-1.5", " 7 ", "1,000", "", "abc", "9e28", "a2", "a10", "A2", "a01", "#1", "_1", "Zed", "zed", "1.10", "1.1", "x" + "9" * 25, "x" + "9" * 24, "😀", "～"]


@pytest.mark.parametrize("parts", [1, 5])
def test_orders(frame, lines, parts):
    f = frame(MIXED, parts)
    place = {}
    for i, v in enumerate(MIXED):
        place.setdefault(v, i)
    alpha = sorted(MIXED, key=lambda v: (upper(v), place[v]))
    assert lines(Sort("alpha").apply(f)) == alpha
    assert lines(Sort("shortest").apply(f)) == sorted(MIXED, key=lambda v: (len16(v), upper(v), place[v]))
    assert lines(Sort("alpha", case_sensitive=True).apply(f)) == sorted(MIXED)
    assert lines(Sort("alpha", case_sensitive=True, strict=True).apply(f)) == sorted(MIXED, key=lambda v: v.encode("utf-16-be"))

    def number(v):
        v = v.strip(" \t")
        return float(v) if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", v) and abs(float(v)) <= 7.9228162514264337e28 else None

    numeric = sorted(MIXED, key=lambda v: (number(v) is None, number(v) or 0, upper(v) if number(v) is None else "", place[v]))
    assert lines(Sort("numeric").apply(f)) == numeric
    down = lines(Sort("numeric_desc").apply(f))
    assert [number(v) for v in down if number(v) is not None] == [number(v) for v in numeric if number(v) is not None][::-1]
    assert [number(v) is None for v in down] == sorted((number(v) is None for v in down), reverse=True)
    assert [len16(v) for v in lines(Sort("longest").apply(f))] == sorted(map(len16, MIXED), reverse=True)


def test_natural(frame, lines):
    given = ["z", "_1", "x10", "a-2", "a10b", "x9y", "a2b", "a2-", "A2", "10", "2", "#1", "a", ""]
    assert lines(Sort("natural").apply(frame(given, 4))) == ["", "#1", "2", "10", "a", "A2", "a2-", "a2b", "a10b", "a-2", "x9y", "x10", "z", "_1"]
    assert lines(Sort("natural").apply(frame(["z", "a", "10", "2"]))) == ["2", "10", "a", "z"]
    big = ["x" + "9" * 45, "x" + "9" * 40, "x5"]
    assert lines(Sort("natural").apply(frame(big))) == big[::-1]


# --- extract


def test_extract(frame, lines):
    mail = frame(["mail a@example.com and b@example.com", "a@example.com"])
    assert lines(Extract("email").apply(mail)) == ["a@example.com", "b@example.com"]
    assert lines(Extract("email", unique=False).apply(mail)) == ["a@example.com", "b@example.com", "a@example.com"]
    assert Extract("email").counts(mail).first().asDict() == {"input": 2, "output": 2, "affected": 1}
    assert lines(Extract("email", case_sensitive=True).apply(mail)) == []
    ip = ["2001:db8::1", "::1", "fe80::1", "2001:db8:85a3::8a2e:370:7334", "192.168.1.10"]
    assert lines(Extract("ipv6").apply(frame(ip))) == ip[:4]
    assert lines(Extract("ipv4").apply(frame(ip))) == ip[4:]
    odd = ["12:34:56", "a:::b", "1::2::3", "1:2:3:4:5:6:7:8", "::", "1:2:3:4:5:6::", "std::vector"]
    assert lines(Extract("ipv6").apply(frame(odd))) == ["1:2:3:4:5:6:7:8", "::", "1:2:3:4:5:6::", "d::"]
    urls = frame(["see https://other.example/path https://example.com/path?q=1", "https://example.com/path?q=1"])
    assert lines(Extract("url", sort=True).apply(urls)) == ["https://example.com/path?q=1", "https://other.example/path"]
    assert lines(Extract("custom", '"[^"]*"', csv=True).apply(frame(['say "hi"']))) == ['"""hi"""']
    digest = frame(["d41d8cd98f00b204e9800998ecf8427e da39a3ee5e6b4b0d3255bfef95601890afd80709"])
    assert [len(v) for k in ("md5", "sha1", "sha256") for v in lines(Extract(k).apply(digest))] == [32, 40]
    assert lines(Extract("domain").apply(frame(["a.example.com, B.example.org"]))) == ["a.example.com", "B.example.org"]
    for bad in (Extract("custom"), Extract("no"), Extract("custom", "(")):
        with pytest.raises(ValueError):
            bad.apply(mail)


# --- columns


@pytest.mark.parametrize(
    "operator, expected",
    [
        (Columns(":", "extract", 1), ["two"]),
        (Columns(":", "remove", 1), ["one:three"]),
        (Columns(":", "remove", 2), ["one:two"]),
        (Columns(":", "reorder", columns=(2, 0)), ["three:one"]),
        (Columns(":", "join", columns=(0, 2)), ["one|three"]),
        (Columns(":", "filter", 1, rule=Rule("equals", "TWO")), ["one:two:three"]),
        (Columns(":", "extract", 3), []),
    ],
)
def test_columns(frame, lines, operator, expected):
    assert lines(operator.apply(frame(["one:two:three"]))) == expected


def test_malformed_rows_and_odd_delimiters(frame, lines):
    f = frame(["a,b,c", "1,2,3", "malformed"])
    op = Columns(",", "extract", 1)
    assert lines(op.apply(f)) == ["b", "2"]
    assert op.counts(f).first().asDict() == {"input": 3, "output": 2, "affected": 1}
    assert lines(Columns(",", "remove", 1).apply(frame(["a,,b", ","]))) == ["a,b", ""]
    for delimiter in ("||", ".", r"\E", "a.b", " ", "😀"):
        assert lines(Columns(delimiter, "extract", 1).apply(frame([delimiter.join(["x", "", "y"]), delimiter.join("xy")]))) == ["", "y"]
    for bad in (("", "extract"), (",", "reorder"), (",", "filter"), (",", "no")):
        with pytest.raises(ValueError):
            Columns(*bad)


# --- split, merge, compare


def parts(op, f):
    return [(r["line_no"], r["part"]) for r in op.apply(f).df.orderBy("line_no").collect()]


def test_split_and_merge(frame, lines):
    f = frame(list("12345"), 3)
    cut = Split("lines", 2)
    assert parts(cut, f) == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)]
    assert cut.counts(f).first().asDict() == {"input": 5, "parts": 3}
    done = cut.apply(f)
    pieces = [done.with_df(done.df.where(f"part = {k}").select("line_no", "value")) for k in (1, 2, 3)]
    assert lines(Merge(blank_between=False).apply(pieces)) == list("12345")
    assert lines(Merge().apply(pieces)) == ["1", "2", "", "3", "4", "", "5"]
    assert lines(Merge(separator="--").apply(pieces[:2])) == ["1", "2", "--", "3", "4"]
    assert Merge().counts(pieces).first()["output"] == 5
    assert cut.name("/x/a.csv", 7) == "a_part_007.csv" and Split("lines", 1, padding=0).name("a", 12) == "a_part_12"
    with pytest.raises(ValueError):
        Merge().apply([])


def test_split_by_bytes_and_pattern(frame):
    f = frame(["aaa", "bbb", "ccccc", "ddddddddd", "e"])
    assert [p for _, p in parts(Split("bytes", 6, newline_bytes=0), f)] == [1, 1, 2, 3, 4]
    f = frame(["#1", "a", "#2", "#3", "b"], 2)
    assert [p for _, p in parts(Split("before", regex="^#"), f)] == [1, 1, 2, 3, 3]
    assert [p for _, p in parts(Split("after", regex="^#"), f)] == [1, 2, 2, 3, 4]
    assert Split("lines", 2).counts(frame([])).first()["parts"] == 0
    for bad in (("lines", 0), ("before",), ("no", 1)):
        with pytest.raises(ValueError):
            Split(*bad)


def test_compare(frame, lines):
    a, b = frame(["z", "a", "10", "2", "A"]), frame(["a", "b", "2"])
    assert lines(Compare("different").apply(a, b)) == ["10", "b", "z"]
    assert Compare().counts(a, b).first().asDict() == {"only_a": 2, "only_b": 1, "both": 2}
    assert lines(Compare("only_a").apply(a, b)) == ["10", "z"]
    assert lines(Compare("only_b").apply(a, b)) == ["b"]
    assert lines(Compare("both").apply(a, b)) == ["2", "a"]
    assert lines(Compare("only_a", case_sensitive=True).apply(a, b)) == ["10", "A", "z"]


# --- statistics and navigation


def test_statistics(frame):
    got = statistics(frame(["alpha", "", "beta alpha", "gamma"]), unique=True).first()
    assert (got["lines"], got["empty_lines"], got["shortest"], got["longest"], got["average"], got["characters"], got["unique_lines"]) == (4, 1, 0, 10, 5.0, 20, 4)
    none = statistics(frame([])).first()
    assert (none["lines"], none["shortest"], none["longest"], none["average"], none["unique_lines"]) == (0, 0, 0, 0.0, None)


def test_search_and_offsets(frame):
    numbered = N.with_offsets(frame(["alpha", "", "beta alpha", "gamma\r"], 2))
    assert [(r[0], r[1], r[2]) for r in numbered.orderBy("line_no").collect()] == [(1, 0, 6), (2, 6, 7), (3, 7, 18), (4, 18, 25)]
    found = N.Search("ALPHA")
    assert [(r["line_no"], r["byte_offset"], r["preview"]) for r in found.apply(numbered).collect()] == [(1, 0, "alpha"), (3, 7, "beta alpha")]
    assert found.summary(numbered).first().asDict() == {"matches": 2, "limit_reached": False}
    assert N.Search("a", limit=1).summary(numbered).first()["limit_reached"]
    assert [r["line_no"] for r in N.Search("^g", regex=True).apply(numbered).collect()] == [4]
    assert [r["line_no"] for r in N.chunk_at_byte(numbered, 7, 1).collect()] == [3]
    assert [r["line_no"] for r in N.chunk_at_byte(numbered, 10_000, 1).collect()] == [4]


def test_preview_window(frame):
    numbered = N.with_offsets(frame(["x" * 300 + "needle" + "y" * 300]))
    shown = N.Search("NEEDLE").apply(numbered).first()["preview"]
    assert shown == "…" + "x" * 80 + "needle" + "y" * 154 + "…"


def test_index_and_chunks(spark):
    from lineloom.operators.frame import LineFrame
    from pyspark.sql import functions as F

    df = spark.range(25_000).select("id", F.concat(F.lit("line-"), F.col("id") + 1).alias("value")).repartition(7)
    numbered = N.with_offsets(LineFrame.of(df, "id")).cache()
    index = N.sparse_index(numbered, 1_000)
    assert index.count() == 25
    assert 19_001 <= N.checkpoint_before(index, line=20_500).first()["line_no"] <= 20_500
    assert N.checkpoint_before(index, byte=0).first()["line_no"] == 1
    assert N.line_count(numbered, ends_with_newline=False).first()[0] == 25_000
    assert [r["value"] for r in N.chunk(numbered, 4_250, 25).orderBy("line_no").collect()] == [f"line-{n}" for n in range(4_250, 4_275)]
    assert [r["line_no"] for r in N.chunk(numbered, 10**9, 5).collect()] == [25_000]
    assert N.chunk(numbered, 1, 10**9).count() == 25_000
    assert N.line_at_percent(200, 50) == 100 and N.line_at_percent(10, 0) == 1
    numbered.unpersist()


def test_find_and_replace(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("the other the",)], "t string")
    text = F.col("t")
    row = df.select(
        N.find(text, "the", whole_word=True), N.find(text, "THE", start=1), N.find(text, "the", start=11), N.find(text, "no"), N.find_previous(text, "the", 10), N.find_previous(text, "the", 0),
        N.replace_at(text, F.lit(0), 3, "a"), N.bounded(text, 5, "!"),
    ).first()
    assert tuple(row) == (0, 5, 0, None, 5, 10, "a other the", "the o!")


def test_partitions_do_not_matter(frame, lines):
    rng = random.Random(5)
    given = [rng.choice(["", "a", "A", "b1", "b10", "b9", " x ", "é", "😀"]) * rng.randint(0, 3) for _ in range(200)]
    for op in (Clean(), Dedupe(), Dedupe(keep="last", case_sensitive=False), Sort("natural"), Sort("longest"), Extract("custom", "[a-z]\\d*")):
        assert lines(op.apply(frame(given, 1))) == lines(op.apply(frame(given, 22)))


def test_parts_by_bytes_by_doubled_pointers(spark, frame):
    """Sizes of all kinds, lines beyond the limit too, against the rule in order; sums over blocks of a few lines."""
    import random

    from lineloom.operators import running, split

    rng = random.Random(4)
    for limit, most, newline in ((6, 9, 0), (40, 30, 2), (500, 60, 1), (3, 1, 0), (1, 5, 2)):
        sizes = [rng.randint(0, most) for _ in range(200)]
        expected, part, filled = [], 0, None
        for n in sizes:
            if filled is None or filled + n + newline > limit:
                part, filled = part + 1, 0
            filled += n + newline
            expected.append(part)
        block, span = running.BLOCK, split.SPAN
        running.BLOCK, split.SPAN = 7, 50
        try:
            got = Split("bytes", limit, newline_bytes=newline).apply(frame(["x" * n for n in sizes], 3)).df.orderBy("line_no").collect()
        finally:
            running.BLOCK, split.SPAN = block, span
        assert [r["part"] for r in got] == expected, (limit, most, newline)


def test_case_of_letters_that_change_with_others(spark):
    from lineloom.functions import semantics as S

    given = ["straße ŉ ﬁ", "ΑΣ ΑΣΑ", "İstanbul ıſ", "ǰ ΐ և", "plain", "éÀ漢😀𐐨", "", None]
    df = spark.createDataFrame([(v,) for v in given], "v string")
    one = lambda t, change: None if t is None else "".join(change(c) if len(change(c)) == 1 else c for c in t)
    upper = lambda c: c if c in "ıſ" else c.upper()
    lower = lambda c: c if c == "İ" else c.lower()
    got = df.select(S.upper_inv(df.v), S.lower_inv(df.v)).collect()
    assert [r[0] for r in got] == [one(t, upper) for t in given]
    assert [r[1] for r in got] == [one(t, lower) for t in given]
