"""WARC: resolution of revisit records by "not modified" answers.

A revisit of that kind holds no body: the server said that the page had not changed.
It is resolved by an as-of join to the latest full response of the same canonical
address that is earlier than it.  The validators must agree: an entity tag or a date
of last modification which the revisit names must be that of the response.  The
response's headers are then updated by those of the revisit that may be (RFC 9111,
section 3.2), and its body is taken.

The as-of join runs over distinct (address, time) points, dealt by address and day,
with the latest response before each day carried over the days of an address.  So no
task holds all captures of a hot address; joins back to the records can be split.

Defined results
* null address: never resolved (``no_address``); null time: nothing is earlier, and
  such a response is never found;
* responses at the same time: the one of the greatest id; a response of status other
  than 200, or without body, is not full;
* a revisit without validators, or of which none is comparable: ``no_validator``;
* repeated rows: each revisit gets its row; an id of several equal full responses is
  one response; an empty table gives no rows;
* header names are compared in lower case; null headers are none.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, column, stash

# Headers that an answer of 304 does not update.
KEPT_HEADERS = (
    "connection content-encoding content-length content-range content-type keep-alive proxy-authenticate proxy-authentication-info "
    "proxy-authorization proxy-connection te trailer transfer-encoding upgrade"
).split()
# Query parameters that only tell where a visitor came from.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|msclkid|yclid|mc_cid|mc_eid)(=|$)"


def canonical(url: Column) -> Column:
    """An address without scheme, user, default port, ``www``, fragment and tracking, in one spelling.

    Host in lower case; no empty or last slash of the path; parameters in order.
    """
    bare = F.regexp_replace(F.trim(url), "#[\\s\\S]*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)?$", ""), "^www[0-9]*\\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+", "/"), "/$", "")
    query = F.split(F.regexp_extract(rest, "^[^?]*\\?([\\s\\S]*)$", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def header(headers: Column, name: str) -> Column:
    """The first value of a header, or null."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def merged(stored: Column, fresh: Column) -> Column:
    """Stored headers updated by those of a 304 that may be; names in lower case, stored order first."""
    lower = lambda hs: F.transform(F.coalesce(hs, F.slice(stored, 1, 0)), lambda h: F.struct(F.lower(F.trim(h["name"])).alias("name"), h["value"].alias("value")))
    named = F.split(F.lower(F.coalesce(header(fresh, "connection"), F.lit(""))), "\\s*,\\s*")
    news = F.filter(lower(fresh), lambda h: ~h["name"].isin(*KEPT_HEADERS) & ~F.array_contains(named, h["name"]))
    return F.concat(F.filter(lower(stored), lambda h: ~F.exists(news, lambda n: n["name"] == h["name"])), news)


def _same_tag(a: Column, b: Column) -> Column:
    """Weak comparison of entity tags."""
    plain = lambda c: F.regexp_replace(F.trim(c), "^W/", "")
    return plain(a) == plain(b)


def resolve(records: DataFrame) -> DataFrame:
    """Revisits of records (record_id, kind, url, at, status, headers, body) with what they resolve to.

    Per revisit: record_id, address, resolution, response_id, response_at, headers (merged) and body.
    """
    rows = records.select(*[column(records, c).alias(c) for c in ("record_id", "kind", "url", "at", "status", "headers", "body")])
    rows = rows.withColumn("address", canonical(F.col("url")))
    full = rows.where("kind = 'response' AND status = 200 AND body IS NOT NULL AND address IS NOT NULL AND at IS NOT NULL")
    revisits = rows.where("kind = 'revisit'").select("record_id", "address", "at", F.col("headers").alias("news"))
    points = full.groupBy("address", "at").agg(F.max("record_id").alias("response_id"))
    asked = revisits.where("address IS NOT NULL AND at IS NOT NULL").select("address", "at").distinct()
    line = points.unionByName(asked, allowMissingColumns=True).groupBy("address", "at").agg(F.max("response_id").alias("response_id"), F.count("*").alias("n"))
    line = line.withColumn("day", F.to_date("at")).withColumn("point", F.when(F.col("response_id").isNotNull(), F.struct(F.col("at").alias("response_at"), "response_id")))
    line = stash(line.select("address", "at", "day", "point"), "captures")
    strictly = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    days = line.groupBy("address", "day").agg(F.max("point").alias("latest"))
    days = days.withColumn("carried", F.last("latest", ignorenulls=True).over(strictly(Window.partitionBy("address").orderBy("day")))).select("address", "day", "carried")
    within = F.last("point", ignorenulls=True).over(strictly(Window.partitionBy("address", "day").orderBy("at")))
    found = line.withColumn("within", within).join(days, ["address", "day"]).select("address", "at", F.coalesce("within", "carried").alias("found"))
    found = stash(found.where("found IS NOT NULL"), "asof")
    known = revisits.join(found, ["address", "at"], "left").select("record_id", "address", "news", "found.response_at", "found.response_id")
    # First the headers alone, which tell what is resolved; then the bodies of that.
    keys, needed = ["a", "t", "i"], found.select(F.col("address").alias("a"), F.col("found.response_at").alias("t"), F.col("found.response_id").alias("i")).distinct()
    full = full.select(F.col("address").alias("a"), F.col("at").alias("t"), F.col("record_id").alias("i"), F.col("headers").alias("stored"), "body")
    stored = full.select(*keys, "stored").join(stash(needed, "needed"), keys, "left_semi").dropDuplicates(keys)
    same = (F.col("address") == F.col("a")) & (F.col("response_at") == F.col("t")) & (F.col("response_id") == F.col("i"))
    known = known.join(stored, same, "left").drop(*keys)
    tags = (header(F.col("news"), "etag"), header(F.col("stored"), "etag"))
    dates = (header(F.col("news"), "last-modified"), header(F.col("stored"), "last-modified"))
    differs = (F.coalesce(~_same_tag(*tags), F.lit(False))) | F.coalesce(dates[0] != dates[1], F.lit(False))
    agrees = F.coalesce(_same_tag(*tags), F.lit(False)) | F.coalesce(dates[0] == dates[1], F.lit(False))
    resolution = (
        F.when(F.col("address").isNull(), "no_address")
        .when(F.col("response_id").isNull(), "no_earlier_response")
        .when(differs, "validator_mismatch")
        .when(~agrees, "no_validator")
        .otherwise("resolved")
    )
    known = known.withColumn("resolution", resolution)
    done = F.col("resolution") == "resolved"
    known = stash(known.select("record_id", "address", "resolution", "response_id", "response_at", F.when(done, merged(F.col("stored"), F.col("news"))).alias("headers")), "resolved")
    wanted = stash(known.where(done).select(F.col("address").alias("a"), F.col("response_at").alias("t"), F.col("response_id").alias("i")).distinct(), "needed")
    bodies = full.select(*keys, "body").join(wanted, keys, "left_semi").dropDuplicates(keys)
    return known.join(bodies, same & done, "left").select(
        "record_id",
        "address",
        "resolution",
        "response_id",
        "response_at",
        "headers",
        "body",
    )


def _lines(stream: io.BufferedIOBase) -> Iterator[tuple[str, str]]:
    """Header fields up to the empty line; a line that begins with white space goes on with the one before."""
    name = value = None
    while (line := stream.readline()).strip():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[0] in " \t" and name is not None:
            value += " " + text.strip()
            continue
        if name is not None:
            yield name, value
        name, _, value = (p.strip() for p in text.partition(":"))
    if name is not None:
        yield name, value


def _record(stream: io.BufferedIOBase) -> tuple[dict | None, int] | None:
    """The next record, or None in its place if it is neither a response nor a revisit, and how many bytes it lacks; None at the end."""
    while line := stream.readline():
        if line.startswith(b"WARC/"):
            break
    else:
        return None  # only empty lines were left
    fields = {n.lower(): v for n, v in _lines(stream)}
    size = int(fields.get("content-length", 0))
    block = stream.read(size)
    kind = fields.get("warc-type")
    if kind == "revisit" and "not-modified" not in fields.get("warc-profile", ""):
        kind = "revisit-other"
    if kind not in ("response", "revisit", "revisit-other"):
        return None, size - len(block)
    http = io.BytesIO(block)
    status = http.readline().split() if block.startswith(b"HTTP/") else []
    headers = [{"name": n, "value": v} for n, v in _lines(http)] if status else None
    code = status[1].decode() if len(status) > 1 and status[1].isdigit() else None
    found = {
        "record_id": fields.get("warc-record-id"),
        "kind": kind,
        "url": fields.get("warc-target-uri", "").strip("<>") or None,
        "at": fields.get("warc-date"),
        "status": None if code is None else int(code),
        "headers": headers,
        "body": http.read() if status and kind == "response" else None,
    }
    return found, size - len(block)


def records(data: bytes) -> Iterator[dict]:
    """The responses and revisits of a WARC file, plain or in gzip members; others are passed over."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while (found := _record(stream)) is not None:
        if found[0] is not None:
            yield found[0]


_RECORD = pa.schema(
    [("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("at", pa.string()), ("status", pa.int32())]
    + [("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("body", pa.binary())]
)
#: Between records; a body may hold it, which its length tells.
_BETWEEN = b"\r\n\r\nWARC/"


def _blocks(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Record batches of at most 256 records or some 8 MB of bodies."""
    block, size = [], 0
    for record in found:
        block.append(record)
        size += len(record["body"] or b"")
        if len(block) == 256 or size > SLICE_BYTES:
            yield pa.RecordBatch.from_pylist(block, schema=_RECORD)
            block, size = [], 0
    yield pa.RecordBatch.from_pylist(block, schema=_RECORD)


def _read_whole(batches):
    for batch in batches:
        for data in batch.column(0):
            yield from _blocks(records(data.as_py()))


def _joined(batches) -> Iterator[dict]:
    """Records from what lies between separators, in order: (bytes, file, whether its split is the file's last)."""
    open_, at, last = b"", None, True
    for batch in batches:
        for data, file, final in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if open_ and file != at:
                yield from records(open_)  # the file before ends inside a record
                open_ = b""
            start = data if data.startswith(b"WARC/") else b"WARC/" + data
            whole, at, last = open_ + b"\r\n\r\n" + start if open_ else start, file, final
            found = _record(io.BytesIO(whole))
            open_ = whole if found is not None and found[1] > 0 else b""
            if not open_ and found is not None and found[0] is not None:
                yield found[0]
    if open_:
        if not last:
            raise ValueError(f"a record of {at} goes on in the next split; raise spark.sql.files.maxPartitionBytes")
        yield from records(open_)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files for ``resolve``; bodies are bytes.

    Plain files are read in splits, by records.  A file whose name ends in z (.gz) is one
    gzip stream, which can't be split: a task holds the packed bytes, 2 GB at most, and
    a block of records.
    """
    schema = "record_id string, kind string, url string, at string, status int, headers array<struct<name:string,value:string>>, body binary"
    packed = spark.read.format("binaryFile").option("pathGlobFilter", "*z").load(path).select("content").mapInArrow(_read_whole, schema)
    last = F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")
    plain = spark.read.option("lineSep", _BETWEEN.decode()).option("pathGlobFilter", "*[^z]").text(path)
    plain = plain.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), last.alias("last"))
    found = plain.mapInArrow(lambda batches: _blocks(_joined(batches)), schema).union(packed)
    return found.withColumn("at", F.try_to_timestamp("at"))


def _headers(*pairs: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in pairs])


def captures(pages: DataFrame) -> DataFrame:
    """Records of a crawl that fetches every page once, one a second, and asks a day later whether it has changed.

    The second request spells the host in capitals and adds a fragment, and names the
    tag that its own first answer had; where another page of the same canonical
    address came between, the tags differ.
    """
    tag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    second = lambda n: F.timestamp_seconds(F.unix_timestamp(start) + n)
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    first, again = second(F.col("page_id")), second(F.col("page_id") + 86_400)
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"),
        F.lit("response").alias("kind"),
        F.col("url"),
        first.alias("at"),
        F.lit(200).alias("status"),
        _headers(("Content-Type", F.lit("text/html")), ("Content-Length", F.octet_length("html")), ("ETag", tag), ("Date", day(first)), ("Cache-Control", F.lit("max-age=60"))).alias("headers"),
        F.col("html").alias("body"),
    )
    spelt = F.concat(F.upper(F.regexp_extract("url", "^[^/]*//[^/]*", 0)), F.regexp_replace(F.regexp_replace("url", "^[^/]*//[^/]*", ""), "#.*$", ""), F.lit("#again"))
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        F.lit("revisit").alias("kind"),
        spelt.alias("url"),
        again.alias("at"),
        F.lit(304).alias("status"),
        _headers(("Connection", F.lit("keep-alive")), ("Content-Length", F.lit(0)), ("ETag", F.concat(F.lit("W/"), tag)), ("Date", day(again)), ("Cache-Control", F.lit("max-age=120")), ("X-Cache", F.lit("HIT"))).alias("headers"),
        F.lit(None).cast("string").alias("body"),
    )
    return response.unionByName(revisit)
