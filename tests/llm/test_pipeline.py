"""Each stage against a plain version of its rule, on its own input."""

import collections

import corpus_pipeline
import pytest
from test_corpus_operators import plain_decontaminate, plain_line_dedup, plain_quality, plain_similar, plain_verdict

from lineloom.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now = {r["doc_id"]: r["text"] for r in docs.collect()}
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        rows = after.collect()
        if name == "quality_rules":
            limits = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            expected = {i: t for i, t in now.items() if not plain_quality(t)[-1] and plain_verdict(t, limits)}
        elif name == "line_dedup":
            plain = plain_line_dedup(sorted(now.items()), 50)
            expected = {i: t for i, (n, gone, t) in plain.items() if gone < n}
        elif name == "simhash_near_dedup":
            first = set(plain_similar(now).values())
            expected = {i: t for i, t in now.items() if i in first}
            assert len(expected) < len(now)
        elif name == "benchmark_decontamination":
            found = plain_decontaminate(now.items(), items)
            expected = {i: t for i, t in now.items() if not found[i][4]}
        else:
            assert {r["doc_id"] for r in rows} == set(now)
            room = collections.Counter()
            for r in rows:
                room[r["sequence_id"]] += r["length"]
            assert max(room.values()) <= 2048
            break
        assert after.columns == docs.columns
        assert {r["doc_id"]: r["text"] for r in rows} == expected, name
        assert len(rows) == len(expected)
        sizes.append(len(expected))
        docs, now = spark.createDataFrame(rows, docs.schema), expected
    assert len(sizes) == 4 and sizes[0] < 200


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, name, odd, empty, docs):
    """Nulls, repeated rows, no rows, and columns with the names that stages use inside."""
    stage = dict(corpus_pipeline.STAGES)[name]
    kept = {
        "quality_rules": 0,  # repeats, or too few words
        "line_dedup": 6,  # two rows are copies of a line of a row without id, and nothing of them is left
        "simhash_near_dedup": 3,  # two texts, and one of those without words
        "benchmark_decontamination": 8,
        "best_fit_packing": 8,
    }
    assert stage(spark, odd, SF).count() == kept[name]
    none = stage(spark, empty, SF)
    assert none.count() == 0
    clashing = docs.selectExpr("*", "1 AS th", "2 AS none", "3 AS name", "4 AS hash", "5 AS root", "6 AS node", "7 AS cover", "8 AS owners", "9 AS length", "10 AS `row`")
    after = stage(spark, clashing, SF)
    if name == "best_fit_packing":
        assert after.count() >= clashing.count()
    else:
        assert none.columns == empty.columns and after.columns == clashing.columns and 0 < after.count() <= clashing.count()
