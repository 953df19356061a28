"""One query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, decontaminate, html, lines, packing, quality, rollup, sharding, simhash, warc
from .common import documents, scratch


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents come in, toxic ones go, and other languages than English get new counts.

    Two of the batches are sent again, which changes nothing.
    """
    counts = rollup.token_counts(documents(spark, sf_dir), F.col("lang") != "en")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("id")).distinct()
    old, new = ("word_bpe_49k", "first"), ("byte_bpe_50k", "second")
    load = rollup.changes(counts, "insert", new=old)
    removal = rollup.changes(counts.join(toxic, "id", "left_semi"), "delete", old=old)
    recount = rollup.changes(counts.join(toxic, "id", "left_anti").where("again"), "revise", new=new, old=old)
    store = rollup.TokenRollup(spark, scratch(spark, "rollup"))
    for name, batch in (("load", load), ("toxic", removal), ("load", load), ("recount", recount), ("recount", recount)):
        store.commit(name, batch)
    return store.totals()


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(documents(spark, sf_dir))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", "n_chars")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.substring_dedup(documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(documents(spark, sf_dir), benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands are fitted on the documents that ``labels`` says are good, 20,000 at most."""
    docs = documents(spark, sf_dir)
    return quality.quality(docs, limits=quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's second visit, resolved; headers as sorted lines."""
    found = warc.resolve(warc.captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.expr("array_join(array_sort(transform(headers, h -> concat(h.name, ': ', h.value))), '\n')")
    return found.select("record_id", "address", "resolution", "response_id", F.col("response_at").alias("response_at"), lines.alias("headers"), "body")


#: Every run of enough words, each by its digest; the first of equal ones stays.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), n AS (
  SELECT doc_id, text, l, list_transform(l, lambda x: CASE WHEN x = '' THEN 0 ELSE length(x) - length(replace(x, ' ', '')) + 1 END) AS w FROM d WHERE text IS NOT NULL
), b AS (
  SELECT *, unnest(range(len(l))) AS a FROM n
), r AS (
  SELECT *, unnest(range(a, len(l))) AS z FROM b
), k AS (
  SELECT doc_id, text, a, z, md5(array_to_string(l[a + 1 : z + 1], chr(10))) AS run FROM r WHERE list_sum(w[a + 1 : z + 1]) >= 50
), f AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, a) AS nth FROM k
), g AS (
  SELECT doc_id, list_distinct(flatten(list(range(a, z + 1)))) AS gone FROM f WHERE nth > 1 GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(l) END AS n_lines, coalesce(len(gone), 0) AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(len(l)), lambda i: NOT list_contains(gone, i)), lambda i: l[i + 1]), chr(10)) END AS text
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

#: What the article elements of these pages hold; their only inline element is b, their references are two.
OP3_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS body FROM pages
), b AS (
  SELECT page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS body FROM a
), c AS (
  SELECT page_id, url, replace(replace(replace(body, '&quot;', '"'), '&amp;', '&'), '&amp', '&') AS body FROM b
), t AS (
  SELECT page_id, url, trim(regexp_replace(body, '\s+', ' ', 'g')) AS text FROM c
)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""

#: Windows of documents joined with those of items, for each window length.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item, n, array_to_string(w[k + 1 : k + n], ' ') AS win
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(greatest(1, len(w) - 12))) AS k FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), h AS (
  SELECT doc_id, p, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win
), c AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS word FROM h) GROUP BY doc_id
), o AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN o ON d.doc_id = o.doc_id
"""

OP10_SQL = r"""
WITH p AS (
  SELECT page_id, html, regexp_replace(url, '#.*$', '') AS u,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id) AS t FROM pages
), q AS (
  SELECT *, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*:/*', '') AS r FROM p
), c AS (
  SELECT *,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(r, '^[^/?]*')), '^.*@', ''), ':(80|443)?$', ''), '^www[0-9]*\.', '') AS host,
    regexp_replace(regexp_replace(regexp_extract(r, '^[^/?]*([^?]*)', 1), '/+', '/', 'g'), '/$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(r, '^[^?]*\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid|msclkid|yclid|mc_cid|mc_eid)(=|$)'))), '&') AS query
  FROM q
), a AS (
  SELECT page_id, html, t, host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS address FROM c
), full_ AS (
  SELECT address, t, max(page_id) AS page_id FROM a WHERE html IS NOT NULL AND address IS NOT NULL GROUP BY address, t
), v AS (
  SELECT v.page_id, v.html, v.address, v.t + INTERVAL 1 DAY AS t, f.page_id AS found, f.t AS found_t
  FROM a v ASOF LEFT JOIN full_ f ON v.address = f.address AND v.t + INTERVAL 1 DAY > f.t
), w AS (
  SELECT v.*, s.html AS body, md5(v.html) AS mine, md5(s.html) AS theirs FROM v LEFT JOIN a s ON s.page_id = v.found
), x AS (
  SELECT *, CASE WHEN address IS NULL THEN 'no_address' WHEN found IS NULL THEN 'no_earlier_response'
                 WHEN mine <> theirs THEN 'validator_mismatch' WHEN mine IS NULL THEN 'no_validator' ELSE 'resolved' END AS resolution FROM w
)
SELECT page_id * 2 + 1 AS record_id, address, resolution, found * 2 AS response_id, found_t AS response_at,
  CASE WHEN resolution = 'resolved' THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || strlen(body) || chr(10) ||
    'content-type: text/html' || chr(10) || 'date: ' || strftime(t, '%Y-%m-%d %H:%M:%S') || chr(10) || 'etag: W/"' || theirs || '"' || chr(10) || 'x-cache: HIT' END AS headers,
  CASE WHEN resolution = 'resolved' THEN body END AS body
FROM x
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op3_html_extraction": OP3_SQL, "op7_benchmark_decontamination": OP7_SQL, "op10_warc_revisits": OP10_SQL}
