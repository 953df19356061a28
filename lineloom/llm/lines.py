"""Line dedup by a suffix array over line ids, in DataFrame operations only.

Every line gets an id, in the order of two digests (64 bits for the order, MD5 to tell lines apart).  Lines that occur once in
the corpus cannot lie in a repeated run, so they cut the documents into segments;
only segments go on.  Distributed prefix doubling ranks the suffixes of all segments
by their first 1, 2, 4, ... lines: the next rank of a suffix is the pair of its rank
and that of the suffix 2^k lines on, named by the number of suffixes below it.  These
are the places in the suffix array, and suffixes of equal rank are one interval whose
longest common prefix is at least 2^k lines.

A run of w lines, 2^k <= w < 2^(k+1), is named by the ranks at depth k of its first
suffix and of the one that ends with it, so runs of equal name are one interval of
the array with a common prefix of w lines.  A repeated run is one of ``MIN_WORDS``
words or more; of each interval all but the first occurrence, by (id, position), are
later copies.

Only intervals of shortest runs are formed: runs that have words enough and would not
with a line less at their end, or at their begin.  Nothing is lost by that.  Let [a, z] be
a later copy of some run, with words enough, and x a line of it.  Let s be the last line
of [a, x] from which the shortest run ends within z; there is one, as the run from a does.
If that run reaches x, x is in it.  If not, s < x, and [s + 1, z] has too few words; so the
shortest run that ends at z begins at s or before, but not before a, and x is in that.
Either run is part of [a, z], so it is a later copy, too.  And each shortest run is a run.
So the same lines go, the maximal repeated runs are unions of the shortest, and doubling
stops at the longest of these.

Names are given in two levels (a class, a bucket of it), so that a class which holds
a third of all suffixes is not gathered in a task; the join of suffixes with names
can be split where a class is hot.

Defined results
* null text: no lines, stays null; empty text: one empty line, which stays;
* rows of equal id and text are one document: all get the same result;
* a null id is before all others;
* empty lines, and lines of few words, go only as parts of a longer repeated run;
* a run that repeats in its own document goes there too, overlaps included;
* texts of any length; the lines of one document are held in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, discard, fresh, stash

#: The least words of a repeated run.  Words of a line: its blanks, and one more.
MIN_WORDS = 50
#: The bits of the greatest number of buckets in which names are given.
MOST_BITS = 20

_DOC = ["id", "th"]
_SEGMENT = ["id", "th", "segment"]


def _below(order: list, partition: list[str], count: str = "n"):
    """The sum of ``count`` over the rows before, in ``partition``."""
    rows = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(rows), F.lit(0))


def half_bits(n: int) -> int:
    """Bits of the square root of n: so many buckets, and about as many rows in each."""
    return min(MOST_BITS, max(4, n.bit_length() // 2))


def line_ids(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, r0), and the table that it is read from: lines that occur more than once and the suffixes that begin with lesser lines, plus 1."""
    counted = lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    counted = counted_ = stash(counted, "line-ids")
    # Digests are even, so their leading bits are even buckets, in order.
    counted = counted.withColumn("bucket", F.shiftright("a", 64 - half_bits(counted.count())))
    buckets = counted.groupBy("bucket").agg(F.sum("n").alias("n"))
    buckets = buckets.select("bucket", F.lit(1).alias("one"), "n").withColumn("base", _below(["bucket"], ["one"])).select("bucket", "base")
    within = counted.withColumn("within", _below(["a", "b"], ["bucket"]))
    return within.join(buckets, "bucket").select("a", "b", (F.col("base") + F.col("within") + 1).alias("r0")), counted_


def double(suffixes: DataFrame, k: int, bits: int) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """``suffixes`` with rank r(k+1), by 2^(k+1) lines, from r(k), and the tables that it is read from; a bucket spans 2^bits ranks."""
    now, after = f"r{k}", f"r{k + 1}"
    ahead = F.lead(now, 1 << k).over(Window.partitionBy(*_SEGMENT).orderBy("pos"))
    paired = stash(suffixes.withColumn("second", F.coalesce(ahead, F.lit(0))), "suffixes")
    pairs = paired.groupBy(now, "second").agg(F.count("*").alias("n")).withColumn("bucket", F.shiftright("second", bits))
    pairs = stash(pairs, "pairs")
    buckets = pairs.groupBy(now, "bucket").agg(F.sum("n").alias("n"))
    buckets = buckets.withColumn("base", _below(["bucket"], [now])).select(now, "bucket", "base")
    named = pairs.withColumn("within", _below(["second"], [now, "bucket"])).join(buckets, [now, "bucket"])
    named = named.select(now, "second", (F.col(now) + F.col("base") + F.col("within")).alias(after))
    return paired.join(named, [now, "second"]).drop("second"), (paired, pairs)


def _nearest(rows: DataFrame, name: str, point, query, rising: bool) -> DataFrame:
    """``rows`` with ``name``: the position of the nearest row of its segment whose ``point`` is at or past ``query``."""
    both = rows.withColumn("value", point).withColumn("kind", F.lit(0)).union(rows.withColumn("value", query).withColumn("kind", F.lit(1)))
    way = (lambda c: F.col(c).asc()) if rising else (lambda c: F.col(c).desc())
    seen = Window.partitionBy(*_SEGMENT).orderBy(way("value"), "kind", way("pos")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(name, F.last(F.when(F.col("kind") == 0, F.col("pos")), ignorenulls=True).over(seen))
    return found.where("kind = 1").drop("value", "kind")


def suffix_array(rows: DataFrame, min_words: int) -> tuple[DataFrame, int]:
    """Suffixes of repeated lines with their ranks r0 .. rk, and k.

    ``reach`` is the last line of the shortest run of enough words that begins at a
    suffix, ``back`` the first line of the shortest that ends there.
    """
    line = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("lines") - 1).alias("pos"), F.col("lines").alias("line"))).alias("x")
    lines = rows.where("body is not null").select("id", "th", F.split("body", "\n").alias("lines")).select("id", "th", line).select("id", "th", "x.pos", "x.line")
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + F.when(F.col("line") == "", 0).otherwise(1)
    lines = lines.select("id", "th", "pos", F.xxhash64("line").alias("a"), F.unhex(F.md5("line")).alias("b"), words.cast("long").alias("words"))
    lines = stash(lines, "lines")
    ids, counted = line_ids(lines)
    found = lines.join(ids, ["a", "b"]).select("id", "th", "pos", "words", "r0")
    # By number: the windows below sort these partitions several times, so they are not to be joined to few.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.repartition(parts, *_DOC).dropDuplicates([*_DOC, "pos"])
    found = found.withColumn("segment", F.col("pos") - F.row_number().over(Window.partitionBy(*_DOC).orderBy("pos")))
    total = F.sum("words").over(Window.partitionBy(*_SEGMENT).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("upto", total)
    before = F.col("upto") - F.col("words")
    found = _nearest(found, "reach", F.col("upto"), before + min_words, rising=False)
    found = _nearest(found, "back", before, F.col("upto") - min_words, rising=True)
    suffixes = stash(found.drop("upto"), "suffixes")
    discard(lines, counted)
    size = F.max(F.greatest(F.col("reach") - F.col("pos") + 1, F.col("pos") - F.col("back") + 1))
    longest, count = suffixes.agg(size, F.count("*")).first()
    depth = 0
    used: tuple[DataFrame, ...] = (suffixes,)
    while 2 << depth <= (longest or 0):
        suffixes, tables = double(suffixes, depth, half_bits(count))
        discard(*used)
        used, depth = tables, depth + 1
    # The last rank is written, too, so that the tables of its level can go.
    if depth:
        suffixes = stash(suffixes, "suffixes")
        discard(*used)
    return suffixes, depth


def intervals(runs: DataFrame) -> DataFrame:
    """(w, x, y, n, origin): intervals of the suffix array whose longest common prefix is w lines at least, and which hold n > 1 runs.

    runs: (id, th, a, z, w, x, y), where x and y are the ranks by which runs of w lines are named.
    """
    return runs.groupBy("w", "x", "y").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "a")).alias("origin")).where("n > 1")


def shortest_runs(suffixes: DataFrame, depth: int) -> DataFrame:
    """(id, th, a, z, w, x, y): the shortest runs of enough words, by suffixes with ranks r0 .. r(depth)."""
    ranks = [f"r{k}" for k in range(depth + 1)]
    each = F.sort_array(F.collect_list(F.struct("pos", "reach", "back", *ranks)))
    segments = suffixes.groupBy(*_SEGMENT).agg(each.alias("s")).where("exists(s, x -> x.reach is not null)")
    segments = segments.withColumn("first", F.expr("s[0].pos"))
    # Ranks by depth and place in the segment.
    segments = segments.withColumn("r", F.array(*[F.expr(f"transform(s, x -> x.{r})") for r in ranks]))
    runs = "array_union(transform(filter(s, x -> x.reach is not null), x -> struct(x.pos as a, x.reach as z)), transform(filter(s, x -> x.back is not null), x -> struct(x.back as a, x.pos as z)))"
    runs = segments.withColumn("run", F.explode(F.expr(runs)))
    runs = runs.withColumn("w", F.expr("run.z - run.a + 1")).withColumn("k", F.expr("length(bin(w)) - 1"))
    begin, end = F.expr("r[k][run.a - first]"), F.expr("r[k][run.z - first + 1 - shiftleft(1, k)]")
    return runs.select("id", "th", F.col("run.a").alias("a"), F.col("run.z").alias("z"), "w", begin.alias("x"), end.alias("y"))


def later_copies(rows: DataFrame, min_words: int) -> DataFrame:
    """(id, th, gone): positions of the lines to delete, for texts of rows (id, th, body) that have some."""
    suffixes, depth = suffix_array(rows, min_words)
    runs = stash(shortest_runs(suffixes, depth), "runs")
    # Written, so that Spark can split the runs of a large interval in the join.
    found = stash(intervals(runs).select("w", "x", "y", "origin"), "intervals")
    copies = runs.join(found, ["w", "x", "y"]).where("not (struct(id, th, a) <=> origin)")
    places = F.array_distinct(F.flatten(F.collect_list(F.sequence("a", "z"))))
    gone = stash(copies.groupBy(*_DOC).agg(places.alias("gone")), "gone")
    discard(suffixes, runs, found)
    return gone


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = column(docs, text_col)
    return docs.select(column(docs, id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("body"))


def _kept(gone, body):
    """The lines of ``body`` that stay, as an array."""
    lines = F.split(body, "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.transform(places, lambda i: F.element_at(lines, i + 1))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """For every row ``id_col``, n_lines, n_removed and the text without later copies of repeated runs."""
    rows = _texts(docs, id_col, text_col)
    gone = later_copies(rows, min_words).withColumnRenamed("id", "gid").withColumnRenamed("th", "gth")
    # Never by broadcast: which documents have copies grows with the corpus.
    joined = rows.join(gone.hint("merge"), rows["id"].eqNullSafe(gone["gid"]) & (rows["th"] == gone["gth"]), "left")
    n_lines = F.when(F.col("body").isNull(), 0).otherwise(F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit(""))) + 1)
    return joined.select(
        F.col("id").alias(id_col),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(_kept(F.col("gone"), F.col("body")), "\n")).alias(text_col),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later copies of repeated runs; documents of which no line is left go."""
    gone = later_copies(_texts(docs, id_col, text_col), min_words)
    mark = fresh(docs.columns, "gone")
    gone = gone.select(F.col("id").alias("gid"), F.col("th").alias("gth"), F.col("gone").alias(mark))
    text = column(docs, text_col)
    joined = docs.join(gone.hint("merge"), column(docs, id_col).eqNullSafe(gone["gid"]) & (F.xxhash64(text) == gone["gth"]), "left")
    kept = _kept(gone[mark], text)
    joined = joined.where(gone[mark].isNull() | (F.size(kept) > 0))
    changed = F.when(gone[mark].isNull(), text).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[changed.alias(c) if c == text_col else column(docs, c) for c in docs.columns])
