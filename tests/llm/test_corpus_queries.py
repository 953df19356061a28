"""The registered queries over the whole tables of the smallest scale, against plain versions of their contracts."""

import base64
import collections
import os
import zlib

import pytest
from pyspark.sql import functions as F
from test_corpus_operators import check_packing, plain_components, plain_fingerprint, plain_quality, plain_substring_dedup, plain_verdict

from lineloom.llm import packing, quality, queries, tokens

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    df = queries.queries()[name](spark, SF)
    rows = df.collect()
    return df.columns, rows


def test_token_counts(spark, texts):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    words = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    with open(tokens.vocabulary("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    pairs = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    expected = collections.defaultdict(lambda: [0, 0])
    for i, r in texts.items():
        if i not in toxic:
            english = r["lang"] == "en"
            n = len(words.encode(r["text"], add_special_tokens=False).ids) if english else len(pairs.encode_ordinary(r["text"]))
            own = expected[r["source"], r["lang"], "word_bpe_49k" if english else "byte_bpe_50k"]
            own[0] += 1
            own[1] += n
    columns, rows = run(spark, "op1_token_counts")
    assert columns == ["source", "lang", "version", "n_docs", "n_tokens"]
    assert {tuple(r[:3]): list(r[3:]) for r in rows} == expected and len(rows) == len(expected)


def test_near_duplicates(spark, texts):
    columns, rows = run(spark, "op4_simhash_near_dedup")
    prints = {i: plain_fingerprint(r["text"]) for i, r in texts.items()}
    parts = plain_components(prints)
    assert columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, rows)) == sorted((i, f"{p:016x}", parts[i]) for i, p in prints.items())


def test_substring_dedup(spark, texts):
    _, rows = run(spark, "op5_substring_dedup")
    expected = plain_substring_dedup({(0, i): (i, r["text"]) for i, r in texts.items()})
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], set(r["copies_of"])) for r in rows}
    assert got == {i: (len(texts[i]["text"].encode()), sum(b - a for a, b in spans), spans, first) for (_, i), (spans, first) in expected.items()}
    assert len(rows) == len(texts) and sum(r["n_removed"] > 0 for r in rows) > 3


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    words = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    expected, lengths = {}, collections.Counter()
    for i, r in texts.items():
        ids = [*words.encode(r["text"], add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            cut = ids[a : a + 2048]
            lengths[len(cut)] += 1
            expected[i, k] = (a, len(cut), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in cut)))
    columns, rows = run(spark, "op6_best_fit_packing")
    assert columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    n = check_packing(rows, expected, 2048)
    planned = packing.plan(dict(lengths))
    assert n == planned.sequences <= packing.plan(dict(lengths), rounds=0, again=0).sequences and n <= planned.bound + 1


def test_sharding(spark, texts):
    columns, rows = run(spark, "op8_sharding")
    assert columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    weight, slots, groups = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        data = texts[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        weight[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[data].add(r["shard"])
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and set(weight) <= set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(weight.values()) / 16, max(r["size"] for r in rows)
    assert max(weight.values()) <= mean + largest
    copies = collections.Counter(texts[i]["text"] for i in texts)
    assert all(len(s) == 1 for t, s in groups.items() if copies[t.decode()] * (len(t) + 1) <= 0.02 * mean)


def test_quality(spark, texts):
    columns, rows = run(spark, "op9_quality_rules")
    assert columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    limits = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    for r in rows:
        base = plain_quality(texts[r["doc_id"]]["text"])
        assert tuple(r[1:8]) == (*base, not base[-1] and plain_verdict(texts[r["doc_id"]]["text"], limits))
    assert len(rows) == len(texts)


def test_every_query_takes_empty_tables(spark, tmp_path):
    """Empty tables give no rows and the same columns."""
    for name in ("documents", "pages", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").where(F.lit(False)).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in queries.queries().items():
        df = query(spark, str(tmp_path))
        assert df.count() == 0, name
