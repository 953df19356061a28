"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text, and a cut comes after each byte at which
it is least among the ``REACH`` bytes on either side.  The test looks at nearby bytes
only, so an insertion moves cuts near it and no others, and cuts are evenly spaced
(16 bytes or more apart, 31 on average).  Chunks are compared by a 128-bit digest.  A chunk that
an earlier document has, or that occurs earlier in the same text, is a later copy;
maximal runs of adjacent later copies in which ``WORDS`` words begin, or of ``BYTES``
bytes or more (text need not have blanks), are the spans to delete.  Chunks are short
(about 32 bytes) against the passages sought (over 50 words), so the partial chunks at
both ends of a passage leave a run.

A document is an id with a text; they are in order of id and then of the text's hash,
those without id last.  Texts are cut once, and the chunks are written.  Digests are
aggregated before they are shuffled, a digest of any frequency is one row of the table
of repeats, and the join with it can be split where a digest is hot.

Defined results
* null text: as empty, without chunks and spans;
* rows of equal id and text are one document: each gets the same spans, neither is a
  copy of the other;
* rows of one id and different texts are different documents, and so are rows without
  id and with different texts; ``copies_of`` names no document without id;
* texts of any length are chunked whole;
* tables without rows, texts without bytes: no spans; text that repeats itself without
  a least place is cut every ``MOST`` bytes.
"""

from __future__ import annotations

import bisect
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import T, _binary, append_columns, column, discard, fresh, release, slices, stash

#: Bytes on either side among which the hash, of 16 bits and as many bytes, is least at a cut.
REACH = 15
#: The longest chunk: text that repeats itself has no least place.
MOST = 256
#: Adjacent copied chunks are a span if so many words begin in them, or if they have so many bytes.
WORDS = 15
BYTES = 256

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@functools.cache
def gear() -> np.ndarray:
    """256 numbers by the splitmix64 rule."""
    state = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        state = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        state = (state ^ (state >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (state ^ (state >> np.uint64(31))).astype(np.uint16)


def cuts(text: bytes) -> np.ndarray:
    """Ends of the chunks of a text, ascending; the last is its length."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    # h[i] = sum of gear[byte i-k] << k, k < 16, by doubling the window four times.
    h = gear()[np.frombuffer(text, dtype=np.uint8)]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint16(k)) if n > k else h[k:]
    # low[i] = least of h[i-REACH .. i-1]: h beyond the ends counts as the greatest.
    padded = np.full(n + 2 * REACH, 0xFFFF, dtype=np.uint16)
    padded[REACH : REACH + n] = h
    low, width = padded, 1
    while 2 * width <= REACH:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (REACH - width)], low[REACH - width :])
    at = np.flatnonzero((h < low[:n]) & (h <= low[REACH + 1 : REACH + 1 + n])) + 1
    ends = np.unique(np.append(at[at < n], n))
    wide = np.diff(ends, prepend=0)
    if (wide > MOST).any():
        starts = ends - wide
        ends = np.unique(np.concatenate([ends, *(np.arange(s + MOST, e, MOST) for s, e in zip(starts[wide > MOST], ends[wide > MOST], strict=True))]))
    return ends


def chunked(text: bytes) -> tuple[list[int], list[bytes]]:
    from xxhash import xxh3_128_digest

    ends = cuts(text).tolist()
    if not ends:
        return [], []
    return ends, [xxh3_128_digest(text[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def word_starts(text: bytes) -> np.ndarray:
    """For each byte whether a word begins there."""
    data = np.frombuffer(text, dtype=np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    return ~blank & np.concatenate([[True], blank[:-1]]) if len(data) else blank


def _lists(offsets: list[int], values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _chunk_rows(text, batches):
    """Each row, its text replaced by lists over its chunks: digests, ends, words that begin, and whether it occurred before in the text."""
    for batch in batches:
        for part in slices(batch, text):
            offsets, digests, ends, words, local = [0], [], [], [], []
            for body in _binary(part.column(text)):
                body = body or b""
                own, found = chunked(body)
                known: set[bytes] = set()
                for digest in found:
                    local.append(digest in known)
                    known.add(digest)
                digests += found
                ends += own
                past = np.cumsum(word_starts(body))[np.asarray(own, dtype=np.int64) - 1] if own else np.zeros(0, np.int64)
                words.append(np.diff(past, prepend=0))
                offsets.append(len(ends))
            both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            columns = [part.column(i) for i in range(part.num_columns) if i != text]
            names = [n for i, n in enumerate(part.schema.names) if i != text]
            columns += [_lists(offsets, np.ascontiguousarray(both[:, k]), pa.int64()) for k in (0, 1)]
            columns += [_lists(offsets, ends, pa.int32()), _lists(offsets, np.concatenate(words), pa.int32()), _lists(offsets, local, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "d1", "d2", "end", "words", "local"])
    release()


def merged(places: list[dict], words: int = WORDS, least: int = BYTES) -> list[tuple[int, int]]:
    """Runs of adjacent places in which so many words begin, or of at least so many bytes."""
    runs: list[list[int]] = []
    for a, b, n in sorted((p["start"], p["end"], p["words"]) for p in places):
        if runs and runs[-1][1] == a:
            runs[-1][1] = b
            runs[-1][2] += n
        else:
            runs.append([a, b, n])
    return [(a, b) for a, b, n in runs if n >= words or b - a >= least]


def _spans(words, least, batches):
    for batch in batches:
        names = batch.schema.names
        spans, owners = [], []
        for own in batch.column(names.index("places")).to_pylist():
            runs = merged(own, words, least)
            starts, stops = [a for a, _ in runs], [b for _, b in runs]
            spans.append([{"start": a, "end": b} for a, b in runs])
            inside = lambda p: (k := bisect.bisect_right(starts, p["start"])) and p["start"] < stops[k - 1]  # noqa: B023, E731
            owners.append(sorted({p["first"] for p in own if p["first"] is not None and inside(p)}))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        first = batch.schema.field("places").type.value_type.field("first").type
        yield pa.RecordBatch.from_arrays(
            [batch.column(names.index("id")), batch.column(names.index("th")), pa.array(spans, kind), pa.array(owners, pa.list_(first))],
            names=["id", "th", "spans", "copies_of"],
        )


def _owner(kind: T.DataType) -> Column:
    """What orders documents by (id, text), null ids last; of whole-number ids a number, which hash aggregates can keep."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        id_ = F.coalesce(F.col("id").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
        return (id_ * F.lit(1 << 48).cast("decimal(15,0)")).cast("decimal(37,0)") + F.shiftrightunsigned("th", 16).cast("decimal(15,0)")
    return F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.shiftrightunsigned("th", 16).alias("place"), F.col("th").alias("th"))


def repeated_spans(rows: DataFrame, words: int = WORDS, least: int = BYTES) -> DataFrame:
    """(id, th, spans, copies_of) for the texts of rows (id, th, body) with spans; th is the hash of the text."""
    field = rows.schema["id"].dataType
    kind = field.simpleString()
    # Ids of several texts, and none: there the text decides which document is first.  Of the former most tables have none.
    several = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b")
    several = stash(several.select(F.col("id").alias("key")), "several")
    marked = rows.join(several, rows["id"] == several["key"], "left").select("id", "th", (F.col("key").isNotNull() | F.col("id").isNull()).alias("tied"), "body")
    lists = "d1 array<long>, d2 array<long>, end array<int>, words array<int>, local array<boolean>"
    cut = stash(marked.mapInArrow(functools.partial(_chunk_rows, 3), f"id {kind}, th long, tied boolean, {lists}"), "chunks")
    owner = F.when(F.col("tied"), _owner(field))
    seen = cut.select("id", owner.alias("owner"), F.inline(F.arrays_zip("d1", "d2", "local"))).where("not local")
    known = seen.groupBy("d1", "d2").agg(
        F.min("id").alias("a"), F.max("id").alias("b"), F.max(F.col("id").isNull()).alias("none"), F.min("owner").alias("x"), F.max("owner").alias("y")
    )
    repeats = stash(known.where("a <> b OR (none AND a IS NOT NULL) OR x <> y").select("d1", "d2", "a", "x"), "repeats")
    start = F.concat(F.array(F.lit(0)), F.slice("end", 1, F.greatest(F.size("end") - 1, F.lit(0)))).alias("start")
    placed = cut.select("id", "th", owner.alias("owner"), F.inline(F.arrays_zip("d1", "d2", start, "end", "words", "local")))
    placed = placed.join(repeats.withColumn("known", F.lit(True)).hint("merge"), ["d1", "d2"], "left")
    earlier = F.when(F.col("id").isNull(), F.col("a").isNotNull() | (F.col("x") < F.col("owner"))).otherwise((F.col("id") > F.col("a")) | ((F.col("id") == F.col("a")) & (F.col("x") < F.col("owner"))))
    copied = placed.where(F.col("local") | F.coalesce(F.col("known") & earlier, F.lit(False)))
    # A set: repeated rows give the same places, which meet before the shuffle.
    place = F.struct("start", "end", "words", F.when(F.col("known"), F.col("a")).otherwise(F.col("id")).alias("first"))
    copies = copied.groupBy("id", "th").agg(F.collect_set(place).alias("places"))
    found = copies.mapInArrow(functools.partial(_spans, words, least), f"id {kind}, th long, spans array<struct<start:long,end:long>>, copies_of array<{kind}>")
    found = stash(found.where("size(spans) > 0"), "spans")
    discard(several, cut, repeats)
    return found


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: int = BYTES) -> DataFrame:
    """For every row ``id_col``, n_bytes, n_removed, spans (bytes of the text to delete) and copies_of (ids that had them first)."""
    rows = docs.select(column(docs, id_col).alias("id"), F.xxhash64(column(docs, text_col)).alias("th"), column(docs, text_col).alias("body"))
    found = repeated_spans(rows, words, least)
    every = rows.select("id", "th", F.coalesce(F.octet_length("body"), F.lit(0)).cast("long").alias("n_bytes"))
    same = every["id"].eqNullSafe(found["id"]) & (every["th"] == found["th"])
    kind = found.schema["copies_of"].dataType.simpleString()
    return every.join(found, same, "left").select(
        every["id"].alias(id_col),
        "n_bytes",
        F.expr("coalesce(aggregate(spans, 0L, (n, s) -> n + s.end - s.start), 0L)").alias("n_removed"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("spans"),
        F.coalesce("copies_of", F.expr(f"cast(array() as {kind})")).alias("copies_of"),
    )


class _Cut:
    def __init__(self, name: str):
        self.name = name

    def __call__(self):
        def work(texts, spans):
            out = []
            for text, own in zip(texts, spans, strict=True):
                if text is not None and own:
                    keep = [(a["end"], b["start"]) for a, b in zip([{"end": 0}, *own], [*own, {"start": len(text)}], strict=True)]
                    # A cut may fall inside a character; its bytes go with the copy.
                    text = b"".join(text[a:b] for a, b in keep)
                out.append(None if text is None else text.decode("utf-8", "ignore"))
            return {self.name: out}

        return work


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: int = BYTES) -> DataFrame:
    """``docs`` with the spans deleted from their texts."""
    rows = docs.select(column(docs, id_col).alias("id"), F.xxhash64(column(docs, text_col)).alias("th"), column(docs, text_col).alias("body"))
    found = repeated_spans(rows, words, least)
    mark, cut = fresh(docs.columns, "spans"), fresh(docs.columns, "cut")
    found = found.withColumnRenamed("spans", mark)
    same = column(docs, id_col).eqNullSafe(found["id"]) & (F.xxhash64(column(docs, text_col)) == found["th"])
    joined = docs.join(found, same, "left").select(*[column(docs, c) for c in docs.columns], F.col(mark))
    done = append_columns(joined, text_col, T.StructType([T.StructField(cut, T.StringType())]), _Cut(cut), also=(mark,))
    return done.select(*[column(done, cut).alias(c) if c == text_col else column(done, c) for c in docs.columns])
