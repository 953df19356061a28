"""Best-fit packing of token sequences by the configuration linear program.

Documents are tokenised, cut into pieces of at most ``capacity`` tokens, and counted
by length.  The histogram has at most ``capacity`` rows whatever the corpus, and it
alone comes to the driver.  There:

1. The configuration program - as few bins as possible that together hold the
   histogram, each bin a multiset of lengths within the capacity - is solved by
   multiplicative weights (``program``).  In round t of T every length is to be covered
   to t/T of its count.  A length is worth its tokens times exp(-rate * lead), where the
   lead is how far its cover is ahead of that schedule; a knapsack table prices all
   configurations at once, and those that are worth most for each length that is behind
   are taken, in fractions of bins.  As T grows, leads shrink, and the cover comes to
   the optimum.  The worths divided by the dearest configuration are a solution of the
   dual program, so each round gives a bound that no packing can beat.
2. The fractions are rounded by their running sum, never above what is left.
3. What is left is packed by best fit: longest first, each bin completed by the fullest
   knapsack of what remains.

Best fit of everything, and again with lengths dearer that its bins hold badly, are
plans too; the one with the fewest sequences is taken, so none is worse than best fit.

The plan says which places of which sequences hold pieces number i to j of a length.
Pieces are numbered by length in two levels, (length, bucket) and offsets of buckets,
so no task holds all pieces of one length, and each finds its place by a search in
the plan, which is broadcast; its size is bounded by ``rounds`` and ``capacity``.

Defined results
* null or empty text: one piece that holds only the end id 0;
* repeated rows and null ids: each row gives its own pieces;
* empty table: no rows;
* text of any length: whole; its ids are held once, in one task.
"""

from __future__ import annotations

import functools
import math
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _binary, column, release, slices, stash
from .tokens import vocabulary, word_bpe

CAPACITY = 2048
END = 0
#: Rounds of the program, and how much a lead of a whole count lowers the worth of a length.
ROUNDS = 200
RATE = 0.2
#: Rounds of best fit with lengths dearer that are packed badly, and by how much.
AGAIN = 4
DEARER = 0.2
#: The worth of a piece falls short of its tokens by this much: of equally full bins that of fewer pieces is better.
PIECE = 2.0
#: Misses after which the table that completes bins is made anew.
STALE = 16
#: Pieces of one length that are numbered together: so many, or the square root of their number.
BUCKET = 250


# --- the plan, on the driver ---------------------------------------------------------


def knapsack(lengths: np.ndarray, prices: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(best value, index of the last length taken or -1) for each room from 0; lengths ascend.

    -2 as the last length: as good as with one place less.
    """
    best, last = np.zeros(room + 1), np.full(room + 1, -1, dtype=np.int64)
    dense = np.full(room + 1, -np.inf)
    fits = lengths <= room
    dense[lengths[fits]] = prices[fits]
    index = np.full(room + 1, -1, dtype=np.int64)
    index[lengths[fits]] = np.flatnonzero(fits)
    for c in range(1, room + 1):
        values = best[c - 1 :: -1][:c] + dense[1 : c + 1]
        j = int(values.argmax())
        if values[j] > best[c - 1]:
            best[c], last[c] = values[j], index[j + 1]
        else:
            best[c], last[c] = best[c - 1], -1 if last[c - 1] == -1 else -2
    return best, last


def taken(lengths: np.ndarray, last: np.ndarray, room: int) -> dict[int, int]:
    """The lengths, by index, that the table takes for this room."""
    out: dict[int, int] = {}
    while room > 0 and last[room] != -1:
        if last[room] == -2:  # as good as with one place less
            room -= 1
            continue
        j = int(last[room])
        out[j] = out.get(j, 0) + 1
        room -= int(lengths[j])
    return out


def complete(lengths, left, last, open_, config, room) -> tuple[int, int]:
    """Fill the bin ``config`` from the table, then by the longest that fit; (room left, misses)."""
    misses = 0
    for k, n in sorted(taken(lengths[open_], last, room).items(), reverse=True):
        j = int(open_[k])
        misses += n > left[j] - config.get(j, 0)
        if (n := min(n, int(left[j]) - config.get(j, 0))) > 0:
            config[j] = config.get(j, 0) + n
            room -= n * int(lengths[j])
    while misses:
        few = np.flatnonzero(left[: np.searchsorted(lengths, room, side="right")])
        few = [j for j in few[::-1] if left[j] > config.get(int(j), 0)][:1]
        if not few:
            break
        j = int(few[0])
        config[j] = config.get(j, 0) + 1
        room -= int(lengths[j])
    return room, misses


def filled(lengths: np.ndarray, left: np.ndarray, prices: np.ndarray, capacity: int) -> list[tuple[tuple, int, int]]:
    """Whole bins for all that is ``left``, longest first: (configuration, bins, room left in each)."""
    left, out, stale = left.copy(), [], STALE
    while left.any():
        if stale >= STALE:  # the table still holds lengths that have run out
            open_ = np.flatnonzero(left)
            _, last = knapsack(lengths[open_], prices[open_], capacity - int(lengths[open_[0]]))
            stale = 0
        top = int(np.flatnonzero(left)[-1])
        config = {top: 1}
        room, misses = complete(lengths, left, last, open_, config, capacity - int(lengths[top]))
        stale += misses
        number = min(int(left[j]) // n for j, n in config.items())
        for j, n in config.items():
            left[j] -= number * n
        out.append((tuple(sorted(config.items(), reverse=True)), number, room))
    return out


def worth(lengths: np.ndarray) -> np.ndarray:
    """The tokens of each length, a little less for each piece."""
    return lengths - PIECE * np.minimum(1, lengths / (PIECE + 1))


class Fractions(NamedTuple):
    """Columns (top length, completion, bins); all bins; the best bound of the dual."""

    columns: list[tuple[int, dict[int, int], float]]
    value: float
    bound: float


def program(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> Fractions:
    """A fractional solution of the configuration program by multiplicative weights; lengths go by their index."""
    base, cover = worth(lengths), np.zeros(len(lengths))
    columns: list[tuple[int, dict[int, int], float]] = []
    value, bound = 0.0, float((lengths * counts).sum() / capacity)
    for t in range(1, rounds + 1):
        prices = base * np.exp(-rate * (cover / counts - (t - 1) / rounds))
        best, last = knapsack(lengths, prices, capacity)
        bound = max(bound, float((counts * prices).sum() / best[capacity]))
        known: dict[int, dict[int, int]] = {}
        for i in range(len(lengths) - 1, -1, -1):
            behind = counts[i] * t / rounds - cover[i]
            if behind <= 1e-9:
                continue
            room = capacity - int(lengths[i])
            if room not in known:
                known[room] = taken(lengths, last, room)
            bins = behind / (1 + known[room].get(i, 0))
            cover[i] += bins
            for j, n in known[room].items():
                cover[j] += bins * n
            columns.append((i, known[room], bins))
            value += bins
    return Fractions(columns, value, bound)


Bins = list[tuple[tuple, int]]


def rounded(lengths: np.ndarray, counts: np.ndarray, capacity: int, columns: list[tuple[int, dict[int, int], float]]) -> Bins:
    """Whole bins (configuration, number) that hold every piece exactly once, by the running sum of the columns."""
    left, bins, total = counts.astype(np.int64), [], 0.0
    for i, completion, x in columns:
        number = math.floor(total + x + 0.5) - math.floor(total + 0.5)
        total += x
        if number:
            config = completion | {i: completion.get(i, 0) + 1}
            number = min(number, *(int(left[j]) // n for j, n in config.items()))
            if number:
                for j, n in config.items():
                    left[j] -= number * n
                bins.append((tuple(sorted(config.items(), reverse=True)), number))
    return bins + [(config, number) for config, number, _ in filled(lengths, left, worth(lengths), capacity)]


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int, least: int, again: int = AGAIN) -> Bins:
    """The best of some rounds of best fit, the first one with plain prices; no more rounds if one needs ``least`` bins."""
    prices, best = worth(lengths).astype(float), None
    for _ in range(1 + again):
        found, loss = filled(lengths, counts, prices, capacity), np.zeros(len(lengths))
        for config, number, room in found:
            for j, n in config:
                loss[j] += number * n * room / capacity
        prices = prices * np.exp(DEARER * loss / counts)
        bins = [(config, number) for config, number, _ in found]
        if best is None or size(bins) < size(best):
            best = bins
        if size(best) <= least:
            break
    return best


def size(bins: Bins) -> int:
    return sum(number for _, number in bins)


class Plan(NamedTuple):
    """Rows sorted by length and first piece: where those pieces of the length go; sequences, and how few there can be at least."""

    table: dict[str, np.ndarray]
    sequences: int
    bound: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, rate: float = RATE, again: int = AGAIN) -> Plan:
    """The plan of the fewest sequences for so many pieces of each length; ``rounds`` 0 leaves the program out."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    rows: list[tuple] = []
    bins: Bins = []
    least = 0
    if len(lengths):
        found = program(lengths, counts, capacity, rounds, rate)
        least = math.ceil(found.bound - 1e-6)
        bins = best_fit(lengths, counts, capacity, least, again)
        if rounds and size(bins) > least:
            bins = min(bins, rounded(lengths, counts, capacity, found.columns), key=size)
        used, sequence = np.zeros(len(lengths), dtype=np.int64), 0
        for config, number in bins:
            offset = 0
            for j, n in config:
                rows.append((int(lengths[j]), int(used[j]), n, sequence, offset))
                used[j] += n * number
                offset += n * int(lengths[j])
            sequence += number
    names = ("length", "first", "each", "sequence", "offset")
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, len(names))
    return Plan(dict(zip(names, table.T, strict=True)), size(bins), least)


# --- the pieces, on the executors ----------------------------------------------------


def _pieces(path, capacity, batches):
    tokenizer = word_bpe(path)
    end = END.to_bytes(4, "little")
    for batch in batches:
        for part in slices(batch, 1):
            row, piece, begin, length, crc = [], [], [], [], []
            for i, text in enumerate(_binary(part.column(1))):
                ids = tokenizer.ids(text or b"") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    begin.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (begin, length, crc))],
                names=["id", "piece", "start", "length", "crc"],
            )
    release()


def _place(shared, batches):
    table = shared.value
    key = table["length"] << 40
    order = key + table["first"]
    for batch in batches:
        names = batch.schema.names
        length, number = (batch.column(names.index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "number"))
        at = np.searchsorted(order, (length << 40) + number, side="right") - 1
        past = number - table["first"][at]
        sequence = table["sequence"][at] + past // table["each"][at]
        offset = table["offset"][at] + past % table["each"][at] * length
        kept = [batch.column(names.index(n)) for n in ("id", "piece", "start", "length", "crc")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "crc", "sequence", "offset"])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """For every piece: ``id_col``, piece, start, length, ids_crc32, sequence_id and offset."""
    spark = docs.sparkSession
    rows = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    path = tokenizer or vocabulary("word_bpe_49k.json")
    schema = f"id {kind}, piece int, start long, length long, crc long"
    pieces = rows.mapInArrow(functools.partial(_pieces, path, capacity), schema)
    # A number for each row, so that equal ones can be told apart; it is written, so it stays.
    pieces = stash(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # one row for each length
    shared = spark.sparkContext.broadcast(plan(histogram, capacity, rounds).table)
    # Frequent lengths are numbered in as many buckets as they need.
    buckets = spark.createDataFrame([(n, 1 + c // max(BUCKET, math.isqrt(c))) for n, c in histogram.items()], "length long, buckets long")
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("row"), "buckets"))
    sizes = dealt.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("row")
    numbered = dealt.withColumn("n", F.row_number().over(own)).join(offsets, ["length", "bucket"])
    numbered = numbered.select("id", "piece", "start", "length", "crc", (F.col("before") + F.col("n") - 1).alias("number"))
    placed = numbered.mapInArrow(functools.partial(_place, shared), f"{schema}, sequence long, offset long")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset"
    )
