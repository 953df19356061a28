"""Sharding by a k-d tree over document metadata, in DataFrame operations only.

Points are groups of equal texts, with the metadata of their first document and the
bytes of all.  A node holds a number of leaves; it is cut along its widest dimension
at the weighted quantile that gives either side its share of the leaves (the median
when they are even), until every node is one leaf of the target bytes.

A number counts as itself; a text counts as its rank among the distinct values, so how
it is spelt does not matter, and the widest dimension is that of the most values.

The quantile is found by radix descent: a histogram of 4,096 buckets for all nodes of
a level at once, summed before it is shuffled, tells the bucket that holds the
quantile, and the next histogram looks into that bucket alone.  The key is the
dimension, in 24 bits, and then a hash of the text, so that ties are cut too.  Nodes
and cuts are tables; the driver learns of each step only whether a node is undecided.

A group of copies of more than ``GROUP`` of a leaf is dealt into parts of that size,
by the hash of the id; smaller ones stay whole.  Slots are numbered in two levels,
(shard, bucket) and offsets of buckets, so that no task holds a whole shard.

Defined results
* null text: size 1, the checksum of no bytes; null and empty texts are one group;
* null metadata is below all values; null ids are dealt like any other;
* repeated rows: each gets its own slot;
* empty table: no rows; more shards than points: some shards stay empty;
* texts of any length: only their size and hashes leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.frame import LineFrame
from .common import column, discard, stash

#: The largest group of copies that is not dealt out, as a share of a leaf.
GROUP = 0.02
#: A cut is good enough when it misses its goal by this share of a leaf.
CLOSE = 0.001
#: Rows of a shard that one task numbers, about.
BUCKET = 50_000
#: Tables of at most so many rows, of a few numbers each, are broadcast: some 20 MB.
BROADCAST_ROWS = 200_000
STEP, WIDE, DEEP = 12, 24, 60
TOP = 1 << WIDE


def _number(col: Column, kind: T.DataType) -> Column:
    """A dimension that is no text as a number; one that is none, or infinite, is as good as unknown."""
    if isinstance(kind, T.BooleanType):
        return col.cast("int").cast("double")
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return col.cast("timestamp").cast("double")
    number = col.cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def _small(table: DataFrame, rows: int) -> DataFrame:
    """The table, marked for broadcast if it has few rows; else Spark chooses the join."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _chosen(dims: int) -> Column:
    """The point's place in the dimension of its node's cut."""
    return F.element_at(F.array(*[F.col(f"q{d}") for d in range(dims)]), F.col("dim") + 1)


def cut_level(points: DataFrame, nodes: DataFrame, dims: int, leaf: float, leaves: int) -> DataFrame:
    """(node, dim, cq, cu) for all nodes (node, first, leaves) of a level: right of the cut are keys from (cq, cu) on.

    Nodes of one leaf, or without points, are cut beyond all keys.
    """
    spread = points.groupBy("node").agg(*[(F.max(f"q{d}") - F.min(f"q{d}")).alias(f"s{d}") for d in range(dims)], F.sum("w").alias("w"))
    widths = F.array(*[F.col(f"s{d}") for d in range(dims)])
    widest = (F.array_position(widths, F.array_max(widths)) - 1).cast("int")
    open_ = nodes.where("leaves > 1").join(spread, "node")
    zero = F.lit(0).cast("long")
    state = open_.select("node", widest.alias("dim"), (F.col("w") * F.floor(F.col("leaves") / 2) / F.col("leaves")).alias("goal"), zero.alias("cq"), zero.alias("cu"), F.lit(False).alias("done"))
    watch = Observation()
    state = stash(state.observe(watch, F.count("*").alias("undecided")), "shard-cuts")
    steps = (WIDE + DEEP) // STEP
    for step in range(steps):
        if not watch.get.get("undecided"):
            break
        low = step < WIDE // STEP
        rest = WIDE - STEP * (step + 1) if low else DEEP - STEP * (step - WIDE // STEP + 1)
        near = points.join(_small(state.where("not done"), leaves), "node").withColumn("q", _chosen(dims))
        key, base = ("q", "cq") if low else ("u", "cu")
        inside = F.shiftright(key, rest + STEP) == F.shiftright(base, rest + STEP)
        near = near.where(inside if low else (F.col("q") == F.col("cq")) & inside)
        bucket = F.shiftright(key, rest).bitwiseAND(F.lit((1 << STEP) - 1))
        sums = near.groupBy("node", "goal", bucket.alias("bucket")).agg(F.sum("w").alias("w"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("w").over(Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("before", before)  # at most 4,096 rows for each node
        found = sums.where("before <= goal").groupBy("node").agg(F.max(F.struct("bucket", "w", "before", "n")).alias("b")).select("node", "b.*")
        known = state.join(found, "node", "left")
        want = F.col("goal") - F.col("before")  # of the bucket's weight, to the left
        right = F.col("w") - want
        # One point can't be cut.
        ends = F.lit(step == steps - 1) | (F.col("n") == 1) | (F.least(want, right) <= CLOSE * leaf)
        start = F.shiftleft("bucket", rest)
        place = F.col(base) + start + F.when(ends & (want > right), F.lit(1 << rest)).otherwise(0)
        # A bucket's own weight decides; a decided node keeps what it has.
        live = ~F.col("done") & F.col("bucket").isNotNull()
        moved = [F.when(live & F.lit(c == base), place).otherwise(F.col(c)).cast("long").alias(c) for c in ("cq", "cu")]
        goal = F.when(live & ~ends, want).otherwise(F.col("goal")).alias("goal")
        watch = Observation()
        known = known.select("node", "dim", goal, *moved, (F.col("done") | F.col("bucket").isNull() | ends).alias("done"))
        old, state = state, stash(known.observe(watch, F.count_if(~F.col("done")).alias("undecided")), "shard-cuts")
        discard(old)
    cuts = nodes.select("node").join(state, "node", "left")
    none = F.lit(TOP).cast("long")
    cuts = stash(cuts.select("node", F.coalesce("dim", F.lit(0)).alias("dim"), F.coalesce("cq", none).alias("cq"), F.coalesce("cu", zero).alias("cu")), "shard-cuts")
    discard(state)
    return cuts


def _down(points: DataFrame, cuts: DataFrame, dims: int, leaves: int) -> DataFrame:
    """The points in the nodes below."""
    joined = points.join(_small(cuts, leaves), "node").withColumn("q", _chosen(dims))
    right = (F.col("q") > F.col("cq")) | ((F.col("q") == F.col("cq")) & (F.col("u") >= F.col("cu")))
    return joined.select((F.col("node") * 2 + right.cast("long")).alias("node"), *[c for c in points.columns if c != "node"])


def _children(nodes: DataFrame) -> DataFrame:
    """The nodes (node, first, leaves) of the next level; leaves go on, on the left.  ``first`` is the least of a node's shards."""
    half = F.floor(F.col("leaves") / 2)
    child = lambda bit, first, leaves: F.struct((F.col("node") * 2 + bit).alias("node"), first.cast("long").alias("first"), leaves.cast("long").alias("leaves"))
    two = F.array(child(0, F.col("first"), half), child(1, F.col("first") + half, F.col("leaves") - half))
    return nodes.select(F.inline(F.when(F.col("leaves") == 1, F.array(child(0, F.col("first"), F.col("leaves")))).otherwise(two)))


def kd_tree(points: DataFrame, leaves: int, dims: int, leaf: float) -> tuple[DataFrame, list[DataFrame]]:
    """(points with ``shard`` in place of ``node``, the cuts of each level), from points (node, u, w, q0, ..) all in node 1."""
    spark, levels, deepest = points.sparkSession, [], leaves
    nodes = stash(spark.range(1, 2).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("first"), F.lit(leaves).cast("long").alias("leaves")), "shard-nodes")
    while deepest > 1:
        levels.append(cut_level(points, nodes, dims, leaf, leaves))
        old = points, nodes
        points, nodes = stash(_down(points, levels[-1], dims, leaves), "shard-points"), stash(_children(nodes), "shard-nodes")
        discard(*old)
        deepest -= deepest // 2
    shards = points.join(_small(nodes.select("node", F.col("first").cast("int").alias("shard")), leaves), "node")
    return shards.drop("node"), levels


def ranks(values: DataFrame) -> DataFrame:
    """(value, rank): the distinct values that are not null, by ranges, with ranks from 1."""
    return LineFrame.of(values.where("value IS NOT NULL").distinct(), "value").numbered("rank").df.select("value", "rank")


def grouped(rows: DataFrame, kinds: list[T.DataType], leaf: float) -> DataFrame:
    """(h, w, parts, q0, ..) of each group of equal texts of rows (id, h, size, x0, ..); the metadata are those of its first row."""
    xs = [f"x{d}" for d in range(len(kinds))]
    groups = rows.groupBy("h").agg(F.sum("size").alias("w"), F.min(F.struct("id", *xs)).alias("f")).select("h", "w", *[f"f.{x}" for x in xs])
    groups = stash(groups, "shard-groups")
    ends = groups.agg(F.count("*").alias("n"), *[e for x in xs for e in (F.min(x).alias(f"a{x}"), F.max(x).alias(f"b{x}"))]).first()
    for x, kind in zip(xs, kinds, strict=True):
        low, high = ends[f"a{x}"], ends[f"b{x}"]
        if isinstance(kind, T.StringType):
            table = ranks(groups.select(F.col(x).alias("value")))
            low, high = 1, table.agg(F.max("rank")).first()[0]
            groups = groups.join(table.withColumnRenamed("value", x), x, "left").drop(x).withColumnRenamed("rank", x)
        if low is None or high is None or low == high:
            place = F.lit(TOP - 1)
        else:
            place = 1 + F.floor((F.col(x) - F.lit(low)) / F.lit(float(high - low)) * (TOP - 2))
        groups = groups.withColumn(x, F.when(F.col(x).isNull(), 0).otherwise(place).cast("long"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("w") / F.lit(GROUP * leaf))).cast("long")
    return stash(groups.select("h", "w", parts.alias("parts"), *[F.col(x).alias(f"q{d}") for d, x in enumerate(xs)]), "shard-groups")


def kd_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("source", "lang", "n_chars"), shards: int | None = 16, target_bytes: int | None = None
) -> DataFrame:
    """For every row ``id_col``, size, text_crc32, law, shard, slot and grown_shard.

    Either ``shards`` or ``target_bytes`` (of a leaf) is given.  ``dims`` are the metadata columns.
    """
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    kinds = [docs.schema[name].dataType for name in dims]
    place = lambda name, kind: column(docs, name) if isinstance(kind, T.StringType) else _number(column(docs, name), kind)
    rows = docs.select(
        column(docs, id_col).alias("id"),
        F.xxhash64(text).alias("h"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        *[place(name, kind).alias(f"x{d}") for d, (name, kind) in enumerate(zip(dims, kinds, strict=True))],
    )
    rows = stash(rows, "shard-rows")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    leaves = shards or max(1, round(total / target_bytes))
    leaf = max(1.0, total / leaves)
    groups = grouped(rows, kinds, leaf)
    qs = [f"q{d}" for d in range(len(dims))]
    # Keys below the dimension: of a group, or of a part of a large one.
    one, none = F.lit(1).cast("long").alias("node"), F.lit(0).cast("long").alias("part")
    key = F.shiftrightunsigned(F.xxhash64("h", "part"), 64 - DEEP).alias("u")
    small = groups.where("parts = 1").select("h", none, "w", *qs)
    # Groups above GROUP of a leaf are fewer than leaves / GROUP.
    heavy = _small(groups.where("parts > 1").select("h", "parts", *qs), int(leaves / GROUP))
    part = F.pmod(F.xxhash64("id", "h"), "parts").alias("part")
    large = rows.join(heavy, "h").select("h", part, "size", *qs).groupBy("h", "part", *qs).agg(F.sum("size").alias("w")).select("h", "part", "w", *qs)
    points = stash(small.union(large).select(one, "h", "part", key, "w", *qs), "shard-points")
    points, _ = kd_tree(points, leaves, len(dims), leaf)
    # Written, so that Spark can split a group of many rows in the join.
    points = stash(points.select("h", "part", "shard"), "shard-points")
    named = rows.join(heavy.select("h", "parts"), "h", "left").select("id", "h", "size", "crc", F.coalesce(part, F.lit(0)).alias("part"))
    buckets = 1 + count // (leaves * BUCKET)
    dealt = named.join(points, ["h", "part"]).select("id", "h", "size", "crc", "shard", F.pmod(F.xxhash64("id", "h"), F.lit(buckets)).alias("bucket"))
    dealt = stash(dealt, "shard-dealt")
    discard(rows, groups, points)
    sizes = dealt.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    numbered = dealt.withColumn("n", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "h")))
    return numbered.join(offsets, ["shard", "bucket"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("n") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
