"""Token counts: additive totals maintained by signed deltas.

A batch of changes says of each document that it was inserted, deleted, or that its
count, or a field it is counted under, was revised.  Changes carry the values they
take away and those they bring, so a batch becomes signed rows, and its sums by
source, language and tokenizer version are its delta; totals are sums of deltas.  No
state of single documents is kept.

A batch is committed once: its delta is written to a folder of its own, and then the
batch's marker, which names the folder, is put in place by a step that fails if the
marker is there (a rename that does not replace; on a local disk a hard link).  Readers
see marked batches alone.  A writer that was lost, or came second, leaves files that no
marker names; ``sweep`` deletes them.  A batch that comes again after its marker is left
alone, so markers stay for ever; they are read by Spark, not one by one.

``compact`` takes one list of the batches, and writes the sum of exactly these and their
names as a snapshot, which a marker makes valid in the same way.  Batches that are
committed meanwhile are not in the list, and count beside the snapshot.

Defined results
* null source, language or version: a key like any other; null counts are 0 tokens;
* changes of an unknown or null kind change nothing;
* repeated rows of a batch are changes of their own;
* a batch whose name is empty is a batch like others;
* empty batches are committed, with an empty delta; totals of 0 documents and 0
  tokens are not listed.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, column, stash
from .tokens import byte_bpe, vocabulary, word_bpe

KEYS = ("source", "lang", "version")
_BATCH = "batch string"
DELTA = T.StructType([T.StructField(k, T.StringType()) for k in KEYS] + [T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])


def _side(sign: int, prefix: str) -> Column:
    return F.struct(
        *[F.col(prefix + k).cast("string").alias(k) for k in KEYS],
        F.lit(sign).cast("long").alias("n_docs"),
        (sign * F.coalesce(F.col(prefix + "n_tokens"), F.lit(0))).cast("long").alias("n_tokens"),
    )


def signed(changes: DataFrame) -> DataFrame:
    """The delta of changes (op, source, lang, version, n_tokens, old_source, old_lang, old_version, old_n_tokens).

    insert brings the new values, delete takes the old ones away, revise does both.
    """
    plus, minus = _side(1, ""), _side(-1, "old_")
    nothing = F.slice(F.array(plus), 1, 0)
    rows = F.when(F.col("op") == "insert", F.array(plus)).when(F.col("op") == "delete", F.array(minus)).when(F.col("op") == "revise", F.array(plus, minus)).otherwise(nothing)
    return changes.select(F.inline(rows)).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class TokenRollup:
    """A store of deltas in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    @staticmethod
    def _name(batch: str) -> str:
        return batch.encode().hex() or "empty"

    def _mark(self, path: str, line: str) -> bool:
        """Create a marker as a whole; False if there was one."""
        draft, marker = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}"), self._path(path)
        out = self._fs.create(draft, False)
        out.write(bytearray(line.encode()))
        out.close()
        self._fs.mkdirs(marker.getParent())
        try:
            if self._fs.exists(marker):
                return False
            if self._fs.getUri().getScheme() == "file":
                # Renaming replaces here; a link does not.
                jvm = self.spark._jvm
                place = lambda p: jvm.java.nio.file.Paths.get(self._fs.makeQualified(p).toUri())
                jvm.java.nio.file.Files.createLink(place(marker), place(draft))
                return True
            return bool(self._fs.rename(draft, marker))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self._fs.delete(draft, False)

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _line(self, path: str) -> str:
        file = self._fs.open(self._path(path))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        file.close()
        return text

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/commits/{self._name(batch)}"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False, and nothing is done, if it is there already."""
        if self.committed(batch):
            return False
        name = self._name(batch)
        data = f"{self.root}/deltas/{name}-{uuid.uuid4().hex}"
        signed(changes).write.parquet(data)
        won = self._mark(f"{self.root}/commits/{name}", data)
        if not won:
            self._fs.delete(self._path(data), True)
        return won

    def _state(self) -> tuple[int, DataFrame, list[str], DataFrame]:
        """The number of the next snapshot; rows whose sums are the totals; the folders they are in; the names of their batches."""
        snapshots = self._names("snapshots")
        last = self._line(f"{self.root}/snapshots/{snapshots[-1]}") if snapshots else None
        names = self.spark.read.schema(_BATCH).parquet(f"{last}/names") if last else self.spark.createDataFrame([], _BATCH)
        folders = [f"{last}/totals"] if last else []
        if self._fs.exists(self._path(f"{self.root}/commits")):
            marks = self.spark.read.text(f"{self.root}/commits", wholetext=True).select(F.col("_metadata.file_name").alias("batch"), F.col("value").alias("data"))
            # Those that came after the snapshot; the driver gets these alone.
            later = marks.join(names, "batch", "left_anti").collect()
            folders += sorted(r["data"] for r in later)
            names = names.union(self.spark.createDataFrame([(r["batch"],) for r in later], _BATCH))
        rows = self.spark.read.schema(DELTA).parquet(*folders) if folders else self.spark.createDataFrame([], DELTA)
        return len(snapshots), rows, folders, names

    @staticmethod
    def _sums(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs and n_tokens over all committed batches."""
        return self._sums(self._state()[1])

    def compact(self) -> bool:
        """Fold all committed deltas into a snapshot; False if another one was made meanwhile."""
        number, rows, _, names = self._state()
        data = f"{self.root}/folded/{number:09d}-{uuid.uuid4().hex}"
        self._sums(rows).write.parquet(f"{data}/totals")
        names.write.parquet(f"{data}/names")
        won = self._mark(f"{self.root}/snapshots/{number:09d}", data)
        if not won:
            self._fs.delete(self._path(data), True)
        return won

    def sweep(self, least_age: float = 86_400) -> list[str]:
        """Delete folders of deltas and snapshots that the totals do not need and that are so many seconds old; their paths.

        The age is to be longer than any writer, or reader of totals, takes.
        """
        needed = {f.removesuffix("/totals") for f in self._state()[2]}
        now, gone = self.spark._jvm.java.lang.System.currentTimeMillis(), []
        for folder in ("deltas", "folded"):
            for name in self._names(folder):
                path = f"{self.root}/{folder}/{name}"
                if path not in needed and now - self._fs.getFileStatus(self._path(path)).getModificationTime() >= 1000 * least_age:
                    self._fs.delete(self._path(path), True)
                    gone.append(path)
        return gone


class _Count:
    """Tokens by two tokenizers; the second where ``again`` says so."""

    def __init__(self, words: str, pairs: str):
        self.words, self.pairs = words, pairs

    def __call__(self):
        one, two = word_bpe(self.words), byte_bpe(self.pairs)

        def work(texts, again):
            return {"first": [one.count(t or b"") for t in texts], "second": [two.count(t or b"") if a else None for t, a in zip(texts, again, strict=True)]}

        return work


def token_counts(docs: DataFrame, again: Column, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """(id, source, lang, again, first, second): tokens by word_bpe_49k, and by byte_bpe_50k where ``again``."""
    rows = docs.select(column(docs, id_col).alias("id"), column(docs, "source").alias("source"), column(docs, "lang").alias("lang"), F.coalesce(again, F.lit(True)).alias("again"), column(docs, text_col).alias("body"))
    added = T.StructType([T.StructField("first", T.LongType()), T.StructField("second", T.LongType())])
    work = _Count(vocabulary("word_bpe_49k.json", folder), vocabulary("byte_bpe_50k.tiktoken", folder))
    return stash(append_columns(rows, "body", added, work, also=("again",)).drop("body"), "counts")


def changes(rows: DataFrame, op: str, new: tuple[str, str] | None = None, old: tuple[str, str] | None = None) -> DataFrame:
    """Changes of one kind for rows (source, lang, ...); new and old: (version, column of the count)."""

    def side(prefix, given):
        none = given is None
        key = lambda k: (F.lit(None).cast("string") if none else F.col(k)).alias(prefix + k)
        count = F.lit(None).cast("long") if none else F.col(given[1])
        return [key("source"), key("lang"), F.lit(None if none else given[0]).cast("string").alias(prefix + "version"), count.alias(prefix + "n_tokens")]

    return rows.select(F.lit(op).alias("op"), *side("", new), *side("old_", old))
