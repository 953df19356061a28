"""Quality rules: word statistics and zstandard compression bands.

A text that repeats itself compresses far better than prose, and text without
structure (encoded binary, random letters) far worse.  Both are told by the ratio
of compressed to raw bytes, over the whole document and over each of its fixed
chunks.  Short texts compress worse than long ones because a frame has fixed costs
and no history, so the limits depend on the length.

Limits are fitted on documents that are labelled good (``fit``): a curve of the ratio
by length, and for each octave of the length how far good documents fall below it or
rise above it.  All of them and all their chunks count, as integers that are summed and
ranked on the executors, so the result does not depend on the order of rows.  Without ``LEAST_GOOD`` of them the fixed, wide bands below hold; a
fitted limit is never wider than these.

Random letters, hexadecimal and the like have few symbols, so they compress as far as
some prose does; but they compress no further than the entropy of their single bytes
allows, while prose of some length does.  So a text is noise, too, if its ratio is high
both as such and against that entropy.  From 3 KB this tells any random symbols, from
1 KB random letters; below, neither measure tells them from prose, and they pass.

Defined results
* null text: no words, so all counts are 0 and it is rejected (``base_failed``);
* empty text: the same;
* texts of any length are used whole; the statistics of one text need memory in
  proportion to that text;
* repeated rows are judged each for itself; null ids are kept as they are;
* labels that are null, of unknown ids or repeated do no harm to the fit; documents of
  one id are one example of it; an empty table of labels leaves the fixed bands.
"""

from __future__ import annotations

import math
from fractions import Fraction
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.frame import LineFrame
from ..operators.running import before
from .common import append_columns, column, discard, fresh, stash

#: Limits of compressed/raw bytes by least length in bytes: (length, lowest, highest).
#: Wide by intent: they hold where nothing is labelled.
DOCUMENT_BANDS = (
    (0, 0.40, 1.10),
    (256, 0.38, 0.90),
    (512, 0.35, 0.82),
    (1024, 0.32, 0.74),
    (2048, 0.30, 0.70),
    (4096, 0.28, 0.66),
    (16384, 0.25, 0.62),
)
#: The same for chunks; the last chunk of a text may be shorter than the others.
CHUNK_BANDS = ((512, 0.25, 0.95), (1024, 0.28, 0.78), (2048, 0.28, 0.74), (4096, 0.28, 0.72))
CHUNK_BYTES = 4096
#: Noise by least length in bytes: (length, ratio, ratio to entropy), both exceeded.
NOISE = ((1024, 0.606, 1.05), (1280, 0.597, 1.04), (1536, 0.589, 1.03), (2048, 0.575, 1.02), (3072, 0.0, 1.02), (4096, 0.0, 1.0))
#: A shorter rest is part of the chunk before: alone, the fixed costs of a frame would decide on it.
CHUNK_LEAST = 512
ZSTD_LEVEL = 3
#: Below so many, in all and in an octave of the length, there is no fit.
LEAST_GOOD = 200
LEAST_OCTAVE = 40
#: The share of good documents beyond a limit, on either side, before it is widened by these factors.
BEYOND = 0.005
WIDER = (1.1, 1.5)
#: The share of its chunks that may lie outside the chunk bands.
CHUNK_SHARE = 0.25

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("ratio", T.DoubleType()),
        T.StructField("n_chunks", T.LongType()),
        T.StructField("n_bad_chunks", T.LongType()),
    ]
)

_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """How many words lie in windows of ``width`` words that occur twice or more."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) == n:
        return 0
    names, size = ids, len(seen)
    for k in range(1, width):
        if size * len(seen) >= 1 << 62:
            names = np.unique(names, return_inverse=True)[1].astype(np.int64)
            size = int(names.max()) + 1
        names = names[:-1] * len(seen) + ids[k:]
        size *= len(seen)
    ordered = np.sort(names)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, names)
    again = twice[np.minimum(at, len(twice) - 1)] == names
    covered = np.zeros(n, dtype=bool)
    for k in range(width):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def band(bands, length: int) -> tuple[float, float]:
    low, high = bands[0][1:]
    for least, a, b in bands:
        if length >= least:
            low, high = a, b
    return low, high


def entropy(data: bytes) -> float:
    """The entropy of single bytes, as a share of 8 bits."""
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8))
    share = counts[counts > 0] / len(data)
    return float(-(share * np.log2(share)).sum() / 8)


class Limits(NamedTuple):
    """Fixed bands and, if there was a fit, the curve's coefficients and (low, high) beside it by octave."""

    bands: tuple
    curve: tuple[float, ...] = ()
    beside: tuple[tuple[float, float] | None, ...] = ()

    def of(self, size: int) -> tuple[float, float]:
        low, high = band(self.bands, size)
        octave = size.bit_length()
        if octave < len(self.beside) and self.beside[octave]:
            middle = sum(c * math.log2(size) ** k for k, c in enumerate(self.curve))
            below, above = self.beside[octave]
            low, high = max(low, middle + below), min(high, middle + above)
        return low, high


FIXED = (Limits(DOCUMENT_BANDS), Limits(CHUNK_BANDS))


#: Powers of logarithms are summed as integers of so many binary places.
PLACES = 40


def _curve(degree: int, powers: list[int], ratios: list[int]) -> tuple[float, ...]:
    """Least squares from the sums of powers of x, and of ratios by powers of x, solved exactly."""
    n = degree + 1
    rows = [[Fraction(powers[i + k]) for k in range(n)] + [Fraction(ratios[i])] for i in range(n)]
    for i in range(n):
        at = next(k for k in range(i, n) if rows[k][i])
        rows[i], rows[at] = rows[at], rows[i]
        rows[i] = [v / rows[i][i] for v in rows[i]]
        for k in range(n):
            if k != i:
                rows[k] = [v - rows[k][i] * w for v, w in zip(rows[k], rows[i], strict=True)]
    return tuple(float(r[-1]) for r in rows)


def _curves(pairs: DataFrame) -> dict[int, tuple[float, ...]]:
    """By kind the coefficients of the curve, from (kind, size, packed, n); none for a kind with few texts."""
    x, times = F.log2("size"), F.col("n").cast("decimal(18,0)")
    whole = lambda value: F.sum(F.floor(value * 2**PLACES).cast("decimal(19,0)") * times)
    sums = [whole(F.pow(x, F.lit(k))).alias(f"p{k}") for k in range(5)] + [whole(F.col("packed") / F.col("size") * F.pow(x, F.lit(k))).alias(f"r{k}") for k in range(3)]
    out = {}
    for r in pairs.groupBy("kind").agg(F.sum("n").alias("n"), F.count_distinct("octave").alias("octaves"), *sums).collect():
        if r["n"] >= LEAST_GOOD:
            out[r["kind"]] = _curve(min(2, r["octaves"] - 1), [int(r[f"p{k}"]) for k in range(5)], [int(r[f"r{k}"]) for k in range(3)])
    return out


def _beside(pairs: DataFrame, curves: dict[int, tuple[float, ...]]) -> dict[tuple[int, int], list[float]]:
    """By kind and octave the three quantiles of the distance from the curve, interpolated between exact ranks."""
    x = F.log2("size")

    def middle(curve: tuple[float, ...]) -> Column:
        return sum((F.lit(c) * F.pow(x, F.lit(k)) for k, c in enumerate(curve)), F.lit(0.0))

    rest = F.coalesce(*[F.when(F.col("kind") == k, F.col("packed") / F.col("size") - middle(c)) for k, c in sorted(curves.items())])
    pairs = pairs.withColumn("rest", rest).where("rest IS NOT NULL").select("kind", "octave", "rest", "n")
    sizes = sorted(tuple(r) for r in pairs.groupBy("kind", "octave").agg(F.sum("n")).collect())  # a row for each octave
    wanted, start = {}, 0
    for kind, octave, n in sizes:
        if n >= LEAST_OCTAVE:
            for q in (BEYOND, 0.5, 1 - BEYOND):
                low = math.floor(q * (n - 1))
                wanted.setdefault((kind, octave), []).append((start + low, start + min(low + 1, n - 1), q * (n - 1) - low))
        start += n
    places = sorted({p for three in wanted.values() for a, b, _ in three for p in (a, b)})
    if not places:
        return {}
    ranked = LineFrame.of(pairs.withColumn("value", F.lit("")), "kind", "octave", "rest").numbered("place")
    past = before(ranked.df, "place", F.col("n"), "past")
    held = F.filter(F.array(*[F.lit(p).cast("long") for p in places]), lambda p: (p >= F.col("past")) & (p < F.col("past") + F.col("n")))
    at = {r[0]: r[1] for r in past.select(F.explode(held), "rest").collect()}  # a row for each place
    return {key: [at[a] + (at[b] - at[a]) * t for a, b, t in three] for key, three in wanted.items()}


def fitted(pairs: DataFrame) -> tuple[Limits, Limits]:
    """Limits of texts (kind 0) and of chunks (kind 1), from (kind, size, packed, n) of good ones."""
    pairs = stash(pairs.withColumn("octave", F.length(F.bin("size"))), "examples")
    curves = _curves(pairs)
    found = _beside(pairs, curves) if curves else {}
    discard(pairs)
    out = []
    for kind, bands in enumerate((DOCUMENT_BANDS, CHUNK_BANDS)):
        octaves = [o for k, o in found if k == kind]
        beside: list[tuple[float, float] | None] = [None] * (max(octaves, default=-1) + 1)
        for octave in octaves:
            low, middle, high = found[kind, octave]
            # Widened about the middle of the octave, where the curve need not be.
            beside[octave] = (middle + WIDER[0] * (low - middle), middle + WIDER[1] * (high - middle))
        out.append(Limits(bands, curves.get(kind, ()), tuple(beside)))
    return out[0], out[1]


def fits(limits: Limits, data: bytes, ratio: float) -> bool:
    """Whether the ratio is within its limits and not that of noise."""
    low, high = limits.of(len(data))
    if not low <= ratio <= high:
        return False
    if len(data) < NOISE[0][0]:
        return True
    least, times = band(NOISE, len(data))
    return ratio <= least or ratio <= times * entropy(data)


def pieces(text: bytes) -> list[bytes]:
    """The fixed chunks; the last one takes up a short rest."""
    if len(text) <= CHUNK_BYTES:
        return [text]
    starts = range(0, len(text) - CHUNK_LEAST + 1, CHUNK_BYTES)
    return [text[a : a + CHUNK_BYTES if len(text) - a - CHUNK_BYTES >= CHUNK_LEAST else len(text)] for a in starts]


def judge(text: bytes, compress, limits: tuple[Limits, Limits] = FIXED) -> tuple[float, int, int, bool]:
    """(ratio, chunks, chunks outside their limits, whether the text passes)."""
    if not text:
        return 1.0, 0, 0, False
    whole = len(compress(text)) / len(text)
    passes = fits(limits[0], text, whole)
    chunks = pieces(text)
    if len(chunks) == 1:
        return whole, 1, 0, passes
    bad = sum(not fits(limits[1], c, len(compress(c)) / len(c)) for c in chunks)
    return whole, len(chunks), bad, passes and bad <= CHUNK_SHARE * len(chunks)


def base(text: bytes) -> tuple:
    """The counts of one text, and whether it fails the base rules."""
    words = text.split()  # bytes.split() cuts at 09-0D and 20, as the rule says
    n = len(words)
    word_bytes = sum(map(len, words))
    # White space is ASCII: what is left of the code points when it is taken away is in words.
    word_chars = len(text.translate(None, _CONTINUATION)) - (len(text) - word_bytes)
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeats = repeat_words(words)
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeats, n < 50 or 100 * repeats > 50 * n


def measure(text: bytes | None, compress, limits: tuple[Limits, Limits] = FIXED) -> tuple:
    """The values of RESULT for one text."""
    text = text or b""
    counts = base(text)
    ratio, chunks, bad, passes = judge(text, compress, limits)
    return *counts, passes and not counts[-1], ratio, chunks, bad


class _Judge:
    """Work for append_columns; wanted: names of RESULT to the names of the added columns."""

    def __init__(self, limits: tuple[Limits, Limits], wanted: dict[str, str]):
        self.limits, self.wanted = limits, wanted

    def __call__(self):
        import zstandard

        compress = zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress

        def work(texts):
            got = [measure(t, compress, self.limits) for t in texts]
            return {self.wanted[name]: [g[i] for g in got] for i, name in enumerate(RESULT.names) if name in self.wanted}

        return work


def _examples():
    """Sizes and compressed sizes, first those of the text and then those of its chunks; none if it fails the base rules."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress

    def work(texts):
        out = []
        for text in texts:
            own = []
            if text and not base(text)[-1]:
                chunks = pieces(text)
                own = [{"size": len(x), "packed": len(compress(x))} for x in (text, *(chunks if len(chunks) > 1 else []))]
            out.append(own)
        return {"examples": out}

    return work


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int | None = None) -> tuple[Limits, Limits]:
    """Limits for documents and for chunks, from all documents with label 1; ``sample``: from so many, the least by the hash of their id."""
    good = labels.where(column(labels, label_col) == 1).select(column(labels, id_col).alias("key")).where("key IS NOT NULL").distinct()
    if sample is not None:
        good = good.orderBy(F.xxhash64("key"), "key").limit(sample)
    rows = df.select(column(df, id_col).alias("id"), column(df, text_col).alias("body"))
    example = T.StructType([T.StructField("size", T.LongType()), T.StructField("packed", T.LongType())])
    # Measured before the join, which then moves sizes and not texts, however many labels there are.
    found = append_columns(rows, "body", T.StructType([T.StructField("examples", T.ArrayType(example))]), _examples).select("id", "examples").where("size(examples) > 0")
    found = found.join(good, found["id"] == good["key"], "left_semi").groupBy("id").agg(F.min("examples").alias("e"))  # one example for each id
    each = found.select(F.posexplode("e").alias("at", "x")).select(F.when(F.col("at") == 0, 0).otherwise(1).alias("kind"), "x.size", "x.packed")
    return fitted(each.groupBy("kind", "size", "packed").agg(F.count("*").alias("n")))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: tuple[Limits, Limits] = FIXED) -> DataFrame:
    """Statistics and verdict for every row: ``id_col`` and the fields of RESULT."""
    rows = df.select(column(df, id_col).alias("id"), column(df, text_col).alias("body"))
    judged = append_columns(rows, "body", RESULT, _Judge(limits, {n: n for n in RESULT.names}))
    return judged.select(judged["id"].alias(id_col), *RESULT.names)


def keep_good(df: DataFrame, text_col: str = "text", limits: tuple[Limits, Limits] = FIXED) -> DataFrame:
    """The rows of ``df`` that the rules keep, with all their columns."""
    mark = fresh(df.columns, "keep")
    added = T.StructType([T.StructField(mark, T.BooleanType())])
    marked = append_columns(df, text_col, added, _Judge(limits, {"kept": mark}))
    return marked.where(column(marked, mark)).select(*[column(marked, c) for c in df.columns])
