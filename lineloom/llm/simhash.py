"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints link when they differ in at most ``THRESHOLD`` = 2 bits.  Anchors are
the codewords of a covering code over 46 of the 64 bits: two blocks of 23 bits, each
with the binary Golay code, which is perfect with covering radius 3.  So every block
has exactly one codeword within 3 bits.

* Home of a fingerprint: the codeword within 3 bits, in both blocks.
* Guests of an anchor: fingerprints within the covering radius plus the threshold of
  it, where the threshold is shared between the blocks: the distances beyond 3, of
  both blocks together, are at most 2.

If s and t differ in i bits of the first block and j of the second, i + j <= 2, then
t is within 3 + i and 3 + j of the home of s.  So t is a guest there, and comparing
each home with the guests of its anchor, on all 64 bits, finds every link once.  A
fingerprint is a guest of 61 anchors on average, of 2^24 in all.

Only distinct fingerprints take part, so copies cost nothing, and a group of copies
of any size is one row.  Links and components stay distributed.

``near_duplicates`` links by these 2 bits alone.  ``keep_one`` links texts by the
Jaccard similarity of their sets of five-word shingles, 0.8 or more, checked exactly.
Texts so similar may differ in 10 of 64 bits, so its candidates come from 21 tables of
anchors: 27 bits each, of a fingerprint of 192 bits in three orders, 23 of them in one
Golay block with threshold 1 and 4 of them equal.  A pair of similarity 0.8 is a guest
of its partner's home in some table with a probability of about 0.95, one of 0.85 with
0.99.  Homes of one anchor are first linked to its least text.  Then guests are
compared with homes of other components only, and that twice: a semi-join tells which
texts have a candidate at all; these get a sketch of 2,048 minwise bits, and only pairs
whose sketches agree as those of similar texts do are candidates.  So neither a group of
near copies nor one of texts that are a little less similar gives all its pairs.

Defined results
* null, empty or wordless text: fingerprint 0, linked like any other;
* fewer words than the shingle: the whole sequence is one shingle;
* repeated rows: each gets its row; a null id is never the smallest unless a
  component has no other, then its component id is null;
* text of any length is used whole, in blocks of ``BLOCK`` shingles;
* by similarity, wordless texts are equal, and fewer than five words are one shingle;
  of a component the row of the least id stays, null ids last, of these the least hash;
  repeated rows are one.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, column, discard, fresh, stash
from .components import components

SHINGLE = 3
SEED = 42
THRESHOLD = 2
BLOCK = 1 << 15

#: Near duplicates by similarity of sets of shingles.
SIMILARITY = 0.8
SIMILAR_SHINGLE = 5
#: Bits of the long fingerprint, the steps by which its three orders go through them, and bits of a table.
LANES, STEPS, EXACT = 3, (1, 71, 115), 4
SIMILAR_THRESHOLD = 1
#: Candidates differ in so many of 128 bits at most; texts of similarity 0.8 do in 15, others in 64, or 50 if they share a table.
SIMILAR_BITS = 28
#: Fingerprints whose anchors are made at a time.
DEALT = 256
#: Longs of minwise bits in a sketch, and standard deviations by which those of similar texts may be worse than their mean.
SKETCH, WORSE = 32, 2.25

#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the Golay code.
GENERATOR = 0b110001110101
WIDTH, RADIUS = 23, 3


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # of ASCII letters and white space only


def shingles(words: list[bytes], width: int):
    """All shingles in order, repeats included, and how many."""
    if len(words) <= width:
        return iter([b" ".join(words)] if words else []), int(bool(words))
    return map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)), len(words) - width + 1


def _lane(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Other 64 bits of each shingle, by the splitmix64 rule; lane 0 is the hash itself."""
    if not lane:
        return hashes
    with np.errstate(over="ignore"):
        z = hashes + np.uint64(lane) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprints(text: bytes | None, width: int = SHINGLE, lanes: int = 1) -> list[int]:
    """Fingerprints of 64 bits each, as signed integers; the first is that of the contract."""
    from xxhash import xxh64_intdigest

    found, n = shingles(words_of(text), width)
    if not n:
        return [0] * lanes
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in found), dtype="<u8", count=n)
    out = []
    for lane in range(lanes):
        ones = np.zeros(64, dtype=np.int64)
        for start in range(0, n, BLOCK):
            part = np.ascontiguousarray(_lane(hashes[start : start + BLOCK], lane)).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0]))
    return out


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The 64 bits as a signed integer."""
    return fingerprints(text, width)[0]


class _Fingerprint:
    """Work for append_columns: one column for each lane."""

    def __init__(self, names: list[str], width: int):
        self.names, self.width = names, width

    def __call__(self):
        def work(texts):
            found = [fingerprints(t, self.width, len(self.names)) for t in texts]
            return {name: [f[k] for f in found] for k, name in enumerate(self.names)}

        return work


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The distinct hashes of the shingles, as signed integers."""
    from xxhash import xxh64_intdigest

    found, n = shingles(words_of(text), width)
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in found), dtype="<u8", count=n)
    return np.unique(hashes.view("<i8"))


@functools.cache
def _minwise() -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of the sketch's hash functions, by the splitmix64 rule."""
    index = np.arange(64 * SKETCH, dtype=np.uint64)
    return _lane(index, 1) | np.uint64(1), _lane(index, 2)


def sketch(hashes: np.ndarray) -> list[int]:
    """A bit of the least of the hashes under each function: two sets agree in a bit with probability (1 + similarity) / 2."""
    factors, shifts = _minwise()
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for start in range(0, len(hashes), 128):
            part = hashes[start : start + 128].view(np.uint64)
            least = np.minimum(least, (part[:, None] * factors + shifts).min(axis=0))
    bits = ((least >> np.uint64(31)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view("<i8").tolist()


class _Sets:
    """Work for append_columns: the set of shingles and its sketch."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self):
        def work(texts):
            sets = [shingle_set(t, self.width) for t in texts]
            sketches = [sketch(s) for s in sets]
            return {"shingles": sets} | {f"k{i}": [k[i] for k in sketches] for i in range(SKETCH)}

        return work


HALF = 12


@functools.cache
def _halves() -> tuple[np.ndarray, np.ndarray]:
    """The remainders by the generator of the words of the lower 12 bits, and of the upper 11."""
    table, power, out = np.zeros(1, dtype=np.int64), 1, []
    for bit in range(WIDTH):
        if bit == HALF:
            out.append(table)
            table = np.zeros(1, dtype=np.int64)
        table = np.concatenate([table, table ^ power])
        power <<= 1
        if power >> 11:
            power ^= GENERATOR
    return out[0], table


def _syndromes(words: np.ndarray) -> np.ndarray:
    """The remainders of 23-bit words by the generator."""
    low, high = _halves()
    return low[words & ((1 << HALF) - 1)] ^ high[words >> HALF]


@functools.cache
def _errors() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By excess over the radius 0, 1, 2: for each syndrome (start, count) into words that have it."""
    of_weight = lambda n: [sum(1 << b for b in bits) for bits in itertools.combinations(range(WIDTH), n)]
    out = []
    for excess in range(THRESHOLD + 1):
        weights = range(RADIUS + 1) if not excess else [RADIUS + excess]
        chosen = np.array([w for n in weights for w in of_weight(n)], dtype=np.int64)
        key = _syndromes(chosen)
        order = np.argsort(key, kind="stable")
        count = np.bincount(key, minlength=1 << 11)
        out.append((np.cumsum(count) - count, count, chosen[order]))
    return out


def anchors(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor), for anchors of at most ``most`` excess."""
    mask = np.uint64((1 << WIDTH) - 1)
    bits = prints.view(np.uint64)
    one = (bits & mask).astype(np.int64)
    two = ((bits >> np.uint64(WIDTH)) & mask).astype(np.int64)
    s1, s2 = _syndromes(one), _syndromes(two)
    index, found = [], []
    for i in range(most + 1):
        for j in range(most + 1 - i):
            (a, na, wa), (b, nb, wb) = _errors()[i], _errors()[j]
            n = na[s1] * nb[s2]
            at = np.repeat(np.arange(len(prints)), n)
            k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            width = nb[s2][at]
            w1 = wa[a[s1[at]] + k // np.maximum(width, 1)]
            w2 = wb[b[s2[at]] + k % np.maximum(width, 1)]
            index.append(at)
            found.append((one[at] ^ w1) | ((two[at] ^ w2) << WIDTH))
    return np.concatenate(index), np.concatenate(found)


def _deal(most, batches):
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for start in range(0, len(whole), DEALT):
            prints = whole[start : start + DEALT]
            at, anchor = anchors(prints, most)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(prints[at])], names=["anchor", "print"])


def links(prints: DataFrame) -> DataFrame:
    """(a, b): each pair of distinct fingerprints that link, once, from distinct rows (print)."""
    schema = "anchor long, print long"
    homes = prints.select("print").mapInArrow(functools.partial(_deal, 0), schema)
    guests = prints.select("print").mapInArrow(functools.partial(_deal, THRESHOLD), schema)
    homes = homes.select("anchor", F.col("print").alias("a"))
    guests = guests.select("anchor", F.col("print").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD
    # A join whose hot anchors Spark can split; it spills, and holds no group in memory.
    return homes.hint("merge").join(guests, (homes["anchor"] == guests["anchor"]) & (F.col("a") < F.col("b")) & near).select("a", "b")


def classes(rows: DataFrame) -> DataFrame:
    """(print, component) for every distinct fingerprint of rows (id, print); the component is its least id."""
    nodes = stash(rows.groupBy("print").agg(F.min("id").alias("first")), "prints")
    linked = components(links(nodes)).withColumnRenamed("node", "print")
    named = nodes.join(linked, "print")
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(least, "root").select("print", "root", "component")
    named = nodes.join(named, "print", "left")
    # Written, so that Spark can split the fingerprint of a large group of copies where rows are joined with this.
    done = stash(named.select("print", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component")).alias("component")), "classes")
    discard(nodes, linked)
    return done


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """For every row ``id_col``, ``fingerprint`` (hexadecimal) and ``component_id``."""
    rows = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("body"))
    added = T.StructType([T.StructField("print", T.LongType())])
    rows = stash(append_columns(rows, "body", added, _Fingerprint(["print"], width)).select("id", "print"), "simhash")
    named = rows.join(classes(rows), "print")
    return named.select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


# --- by similarity -------------------------------------------------------------------


@functools.cache
def _tables() -> list[np.ndarray]:
    """The places of each table's bits in the long fingerprint."""
    size, width = 64 * LANES, WIDTH + EXACT
    return [np.arange(k * width, (k + 1) * width) * step % size for step in STEPS for k in range(size // width)]


def table_anchors(prints: np.ndarray, most: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key of table, equal bits and anchor); prints: one row of lanes for each fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little").astype(np.int64)
    powers = np.int64(1) << np.arange(WIDTH + EXACT, dtype=np.int64)
    index, keys = [], []
    for table, places in enumerate(_tables()):
        whole = bits[:, places] @ powers
        word, equal = whole & ((1 << WIDTH) - 1), whole >> WIDTH
        syndrome = _syndromes(word)
        for excess in range(least, most + 1):
            start, count, errors = _errors()[excess]
            n = count[syndrome]
            at = np.repeat(np.arange(len(prints)), n)
            k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            index.append(at)
            keys.append((((table << EXACT) | equal[at]) << WIDTH) | (word[at] ^ errors[start[syndrome[at]] + k]))
    return np.concatenate(index), np.concatenate(keys)


def _deal_tables(most, least, more, batches):
    for batch in batches:
        names = batch.schema.names
        whole = np.stack([batch.column(names.index(f"p{k}")).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(LANES)], axis=1)
        for start in range(0, len(whole), DEALT):
            at, keys = table_anchors(whole[start : start + DEALT], most, least)
            rows = pa.array(at + start)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(names.index(n)).take(rows) for n in ("node", "p0", "p1", "root", *more))], names=["key", "node", "p0", "p1", "root", *more])


def _dealt(nodes: DataFrame, most: int, more: list[str] | None = None, least: int = 0) -> DataFrame:
    """(key, node, p0, p1, root, and columns ``more`` of longs) from nodes (node, p0, p1, .., root)."""
    names = ["key", "node", "p0", "p1", "root", *(more or [])]
    return nodes.mapInArrow(functools.partial(_deal_tables, most, least, more or []), ", ".join(f"{n} long" for n in names))


def _differing(*pairs: tuple[str, str]) -> Column:
    return functools.reduce(Column.__add__, [F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in pairs])


def _near(*pairs: tuple[str, str]) -> Column:
    return _differing(*pairs) <= SIMILAR_BITS


def _name(id_):
    """An id that equals itself even if it is null; whether it is has a column of its own."""
    return F.coalesce(id_.cast("string"), F.lit("")).alias("name")


def shingle_sets(nodes: DataFrame, sources: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(node, s, k0, ..): sets of shingles and sketches of nodes (node); sources: (node, none, id) of one row for each node; rows: (none, id, th, body)."""
    needed = stash(sources.join(nodes, "node").select(F.col("node").alias("th"), "none", _name(F.col("id"))), "endpoints")
    texts = rows.withColumn("name", _name(F.col("id"))).join(needed, ["none", "name", "th"], "left_semi").select("th", "body")
    names = [f"k{i}" for i in range(SKETCH)]
    added = T.StructType([T.StructField("shingles", T.ArrayType(T.LongType()))] + [T.StructField(k, T.LongType()) for k in names])
    # Of repeated rows one is enough; they meet before the shuffle.
    sets = append_columns(texts, "body", added, _Sets(width)).groupBy(F.col("th").alias("node")).agg(F.first("shingles").alias("s"), *[F.first(k).alias(k) for k in names])
    sets = stash(sets, "shingles")
    discard(needed)
    return sets


def similar(edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The edges (a, b) whose sets are so similar."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("s").alias(f"s{name}"))
    both = edges.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return stash(both.where((union == 0) | (common / union >= least)).select("a", "b"), "similar")


def similarity_classes(rows: DataFrame, width: int = SIMILAR_SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """(th, root) for every distinct text of rows (none, id, th, body); th is the hash of the text, none says that the id is null."""
    added = T.StructType([T.StructField(f"p{k}", T.LongType()) for k in range(LANES)])
    printed = append_columns(rows, "body", added, _Fingerprint(added.names, SHINGLE)).drop("body")
    lanes = [F.first(name).alias(name) for name in added.names]
    nodes = stash(printed.groupBy(F.col("th").alias("node")).agg(F.min(F.struct("none", "id")).alias("f"), *lanes).select("node", "f.*", *added.names), "nodes")
    plain = nodes.select("node", *added.names, F.col("node").alias("root"))
    homes = _dealt(plain, 0)
    stars = homes.groupBy("key").agg(F.min("node").alias("b"), F.min_by("p0", "node").alias("q0"), F.min_by("p1", "node").alias("q1"), F.count("*").alias("n")).where("n > 1")
    # Written, so that Spark can split a hot anchor in the join.
    stars = stash(stars.select("key", "b", "q0", "q1"), "stars")
    first = homes.join(stars, "key").where((F.col("node") != F.col("b")) & _near(("p0", "q0"), ("p1", "q1")))
    first = stash(first.select(F.col("node").alias("a"), "b").distinct(), "candidates")
    ends = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    sets = shingle_sets(ends, nodes, rows, width)
    found = similar(first, sets, least)
    discard(stars, first, sets)
    rooted = plain.drop("root").join(components(found, written=True), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stash(rooted, "rooted")
    one = _dealt(rooted, 0).toDF("key", "a", "p0", "p1", "ra")
    two = _dealt(rooted, SIMILAR_THRESHOLD).toDF("key", "b", "q0", "q1", "rb")
    apart = (one["key"] == two["key"]) & (F.col("ra") != F.col("rb")) & _near(("p0", "q0"), ("p1", "q1"))
    # Each text once, however many candidates it has.
    play = one.hint("merge").join(two, apart, "left_semi").select(F.col("a").alias("node")).union(two.hint("merge").join(one, apart, "left_semi").select("b"))
    play = stash(play.distinct(), "play")
    sets = shingle_sets(play, nodes, rows, width)
    sketches = [f"k{i}" for i in range(SKETCH)]
    drawn = rooted.join(sets.drop("s"), "node")
    one = _dealt(drawn, 0, sketches).toDF("key", "a", "p0", "p1", "ra", *sketches)
    others = ["key", "b", "q0", "q1", "rb", *[f"l{i}" for i in range(SKETCH)]]
    same, two = one.toDF(*others), _dealt(drawn, SIMILAR_THRESHOLD, sketches, least=1).toDF(*others)
    bits, share = 64 * SKETCH, (1 - least) / 2
    most = bits * share + WORSE * math.sqrt(bits * share * (1 - share))
    apart = (F.col("ra") != F.col("rb")) & (_differing(*[(f"k{i}", f"l{i}") for i in range(SKETCH)]) <= most)
    # Texts of one home meet once, not from either side.
    pairs = one.hint("merge").join(same, (one["key"] == same["key"]) & (F.col("a") < F.col("b")) & apart).select("a", "b")
    pairs = pairs.union(one.hint("merge").join(two, (one["key"] == two["key"]) & apart).select("a", "b"))
    second = stash(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "candidates")
    more = similar(second, sets, least)
    # The components so far are stars, which take fewer rounds than their links.
    stars = rooted.where("node <> root").select("node", "root").toDF("a", "b")
    roots = components(stars.union(more), written=True)
    done = nodes.join(roots, "node", "left").select(F.col("node").alias("th"), "none", "id", F.coalesce("root", "node").alias("root"))
    done = stash(done, "classes")
    discard(nodes, found, rooted, play, sets, second, more)
    return done


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SIMILAR_SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """One row of each component of similar texts, that of the smallest id, with all columns of ``docs``."""
    id_, text = column(docs, id_col), column(docs, text_col)
    rows = docs.select(id_.isNull().alias("none"), id_.alias("id"), F.xxhash64(text).alias("th"), text.alias("body"))
    found = similarity_classes(rows, width, least)
    first = found.groupBy("root").agg(F.min(F.struct("none", "id", "th")).alias("f")).select("f.*")
    marks = [fresh(docs.columns, m) for m in ("none", "name", "hash")]
    first = stash(first.select("none", _name(F.col("id")), "th").toDF(*marks), "kept")
    keyed = docs.select("*", id_.isNull().alias(marks[0]), _name(id_).alias(marks[1]), F.xxhash64(text).alias(marks[2]))
    # The same keys for both, so the texts are moved once.
    kept = keyed.join(first, marks, "left_semi").dropDuplicates(marks)
    return kept.select(*[column(kept, c) for c in docs.columns])
