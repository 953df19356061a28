"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all benchmark items, in normalised form, are the patterns of one
automaton.  A document is normalised by one byte translation and one join, and is
scanned once; each match ends at a known byte of the normalised text, which gives
the words it covers, and these are mapped to places in the original text.

The items are broadcast, and each Python worker builds the automaton once.  That is
bounded by ``max_bytes`` of item text: a larger benchmark is taken in blocks of whole
items, with a scan of the texts for each.  A scan writes nothing but what it finds: the
document's id and hash, the words covered and the items.  These are merged for each
document, and the texts are read once more to place them.

Defined results
* null text of a document: no words, never contaminated;
* null or empty item: no window; an item of fewer words than the window is one
  window; items of equal text are counted each; rows of the same id are one item;
  a null id is an item of its own, listed as the empty string;
* repeated documents each get their row; a null id of a document is kept;
* a window that occurs in several items counts for each of them;
* text of any length is scanned whole.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, column, discard, fresh, stash

WINDOW = 13
#: Benchmark text that one automaton holds; about 40 times as many bytes of memory.
MAX_BYTES = 4 << 20

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(SPAN)),
    ]
)

#: Bytes of words map to themselves in lower case, all others to a blank.  Non-ASCII bytes are of words.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


def windows_of(items: list[tuple[str, bytes]], width: int) -> dict[bytes, set[str]]:
    """Each distinct window, with blanks at both ends, and the ids of the items that have it."""
    found: dict[bytes, set[str]] = {}
    for name, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            found.setdefault(b" " + b" ".join(words[i : i + width]) + b" ", set()).add(name)
    return found


def automaton_of(windows: dict[bytes, set[str]]):
    import ahocorasick

    built = ahocorasick.Automaton()
    for window, owners in windows.items():
        # One character for each byte: places in it are places in the normalised bytes.
        built.add_word(window.decode("latin-1"), (len(window) - 2, owners))
    built.make_automaton()
    return built


def matches(words: list[bytes], automaton) -> tuple[list[int], set[str]]:
    """Ranges of hit words, as first, past, first, past ... in ascending order, and the items' ids."""
    if not words or not len(automaton):
        return [], set()
    ends, lengths, owners = [], [], set()
    for end, (length, items) in automaton.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
        ends.append(end)
        lengths.append(length)
        owners.update(items)
    if not ends:
        return [], owners
    # Word k begins at byte begins[k] of the line; a match covers bytes end-length .. end-1.
    begins = 1 + np.cumsum([0] + [len(w) + 1 for w in words[:-1]], dtype=np.int64)
    last = np.asarray(ends, dtype=np.int64)
    first = np.searchsorted(begins, last - np.asarray(lengths, dtype=np.int64))
    return ranges(np.stack([first, np.searchsorted(begins, last)], axis=1).ravel(), len(words)), owners


def ranges(pairs, n: int) -> list[int]:
    """The union of ranges, each as first, past."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, np.asarray(pairs[::2], dtype=np.int64), 1)
    np.add.at(change, np.asarray(pairs[1::2], dtype=np.int64), -1)
    inside = np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]])
    return np.flatnonzero(np.diff(inside)).tolist()


def summary(text: bytes | None, n_words: int, cover: list[int], owners: set[str]) -> tuple:
    """The values of RESULT for one text."""
    items = sorted(o[1:] for o in owners)
    n_hit = sum(cover[1::2]) - sum(cover[::2])
    spans = []
    if cover:
        places = [m.span() for m in _WORD.finditer(text)]
        # Places are counted in characters of the original.
        at = lambda k: len(text[:k].decode("utf-8", "replace"))
        spans = [{"start": at(places[a][0]), "end": at(places[b - 1][1])} for a, b in zip(cover[::2], cover[1::2], strict=True)]
    digest = hashlib.sha256(",".join(items).encode("utf-8", "surrogateescape")).hexdigest()
    return n_words, n_hit, len(items), digest, n_hit > 0 and 20 * n_hit >= n_words, items, spans


def scan(text: bytes | None, automaton) -> tuple:
    words = words_of(text)
    return summary(text, len(words), *matches(words, automaton))


_BUILT: dict[str, object] = {}


class _Scanner:
    """Work for append_columns; wanted: names of RESULT to the names of the added columns, or None for a part."""

    def __init__(self, spark, items: list[tuple[str, bytes]], window: int, wanted: dict[str, str] | None):
        self.shared = spark.sparkContext.broadcast(items)
        self.window, self.wanted = window, wanted
        self.key = hashlib.sha256(repr((window, items)).encode("utf-8", "surrogateescape")).hexdigest()

    def automaton(self):
        if self.key not in _BUILT:  # one is kept for each Python worker
            _BUILT.clear()
            _BUILT[self.key] = automaton_of(windows_of(self.shared.value, self.window))
        return _BUILT[self.key]

    def __call__(self):
        automaton = self.automaton()

        def whole(texts):
            got = [scan(t, automaton) for t in texts]
            return {self.wanted[n]: [g[i] for g in got] for i, n in enumerate(RESULT.names) if n in self.wanted}

        def part(texts):
            got = [matches(words_of(t), automaton) for t in texts]
            return {"cover": [c for c, _ in got], "owners": [sorted(o) for _, o in got]}

        return part if self.wanted is None else whole


class _Merger:
    """The result from what the scans of all blocks have found."""

    def __init__(self, wanted: dict[str, str]):
        self.wanted = wanted

    def __call__(self):
        def work(texts, covers, owners):
            got = []
            for text, cover, own in zip(texts, covers, owners, strict=True):
                n = len(words_of(text))
                got.append(summary(text, n, ranges(cover or [], n), set(own or [])))
            return {self.wanted[n]: [g[i] for g in got] for i, n in enumerate(RESULT.names) if n in self.wanted}

        return work


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, most: int):
    """The items (mark and id, text) in blocks of at most ``most`` bytes of text; the driver holds one block at a time."""
    name = F.coalesce(F.concat(F.lit("="), column(benchmark, item_id).cast("string")), F.lit("-"))
    rows = benchmark.select(name.alias("i"), column(benchmark, item_text).cast("binary").alias("t"))
    block, size = [], 0
    for r in rows.where(F.col("t").isNotNull()).distinct().sort("i", "t").toLocalIterator():
        if block and size + len(r.t) > most:
            yield block
            block, size = [], 0
        block.append((r.i, bytes(r.t)))
        size += len(r.t)
    yield block


def _apply(rows: DataFrame, id_col: str, text: str, benchmark: DataFrame, item_id: str, item_text: str, window: int, most: int, wanted: dict[str, str]) -> DataFrame:
    spark, blocks = rows.sparkSession, _blocks(benchmark, item_id, item_text, most)
    added = T.StructType([T.StructField(wanted[f.name], f.dataType) for f in RESULT.fields if f.name in wanted])
    block = next(blocks)
    later = next(blocks, None)
    if later is None:
        return append_columns(rows, text, added, _Scanner(spark, block, window, wanted))
    part = T.StructType([T.StructField("cover", T.ArrayType(T.LongType())), T.StructField("owners", T.ArrayType(T.StringType()))])
    key = lambda df: (column(df, id_col).isNull(), F.coalesce(column(df, id_col).cast("string"), F.lit("")), F.xxhash64(column(df, text)))
    plain = rows.select(*[k.alias(n) for k, n in zip(key(rows), ("none", "name", "th"), strict=True)], column(rows, text).alias("body"))
    found = []
    while block is not None:
        hits = append_columns(plain, "body", part, _Scanner(spark, block, window, None)).where("size(owners) > 0")
        # Each scan ends before the next begins, so that a task holds one automaton.
        found.append(stash(hits.drop("body"), "decontaminate"))
        block, later = later, next(blocks, None)
    marks = [fresh(rows.columns, m) for m in ("none", "name", "th", "cover", "owners")]
    # Sets: repeated rows have found the same.
    one = functools.reduce(DataFrame.union, found).groupBy("none", "name", "th")
    one = one.agg(F.flatten(F.collect_set("cover")), F.array_distinct(F.flatten(F.collect_set("owners"))))
    one = stash(one.toDF(*marks), "decontaminate")
    discard(*found)
    keyed = rows.select("*", *[k.alias(m) for k, m in zip(key(rows), marks, strict=False)])
    joined = keyed.join(one, marks[:3], "left").select(*[column(keyed, c) for c in rows.columns], *marks[3:])
    merged = append_columns(joined, text, added, _Merger(wanted), also=(marks[3], marks[4]))
    return merged.select(*[column(merged, c) for c in rows.columns], *[column(merged, c) for c in added.names])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """For every document ``id_col`` and the fields of RESULT.

    ``spans`` are the contaminated stretches of the original text, in characters.
    """
    rows = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("body"))
    found = _apply(rows, "id", "body", benchmark, item_id, item_text, window, max_bytes, {n: n for n in RESULT.names})
    return found.select(found["id"].alias(id_col), *RESULT.names)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    mark = fresh(docs.columns, "contaminated")
    marked = _apply(docs, id_col, text_col, benchmark, "item_id", "text", window, max_bytes, {"contaminated": mark})
    return marked.where(~column(marked, mark)).select(*[column(marked, c) for c in docs.columns])
