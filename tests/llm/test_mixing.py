import math
from pathlib import Path

import pytest
from oracle import assert_same

from leafmill.llm import common, mixing, registry


def test_query_equals_sql(spark, sf):
    assert_same(registry.queries()["op6_mixing"](spark, sf), registry.oracle_sql()["op6_mixing"], sf)


def test_query_mixes_whole_documents(spark, sf, docs):
    """What is replicated and shuffled are whole rows; each copy equals its document."""
    scratch = Path(common.scratch_root(spark).removeprefix("file://"))
    before = set(scratch.glob("mixed-*"))
    got = registry.queries()["op6_mixing"](spark, sf).collect()
    (folder,) = set(scratch.glob("mixed-*")) - before
    mixed = spark.read.parquet(f"file://{folder}")
    want = {r["doc_id"]: r for r in docs.collect()}
    copies = mixed.select(*docs.columns, "_mix_copy").collect()
    assert all(r[:-1] == tuple(want[r["doc_id"]]) for r in copies)
    assert sorted((r["doc_id"], r["_mix_copy"]) for r in copies) == sorted((r["doc_id"], r["copy"]) for r in got)
    assert [r["shuffle_key"] for r in got] == sorted(r["shuffle_key"] for r in got)
    assert all(r["n_bytes"] == len(want[r["doc_id"]]["text"].encode()) for r in got)


def test_counts_follow_poisson(spark):
    df = spark.range(60_000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'a' else 'b' end as source")
    out = mixing.replicate(df, {"a": 0.9, "b": 0.1})
    rate = {r["_mix_source"]: r["_mix_rate"] for r in mixing.source_rates(df, {"a": 0.9, "b": 0.1}).collect()}
    assert rate["a"] == pytest.approx(2.7) and rate["b"] == pytest.approx(0.15)
    per = out.groupBy("doc_id", "source").count().groupBy("source", "count").count().toDF("source", "k", "n").collect()
    for s, docs in (("a", 20_000), ("b", 40_000)):
        got = {r["k"]: r["n"] for r in per if r["source"] == s}
        for k in (1, 2, 3):
            p = math.exp(-rate[s]) * rate[s] ** k / math.factorial(k)
            assert got.get(k, 0) == pytest.approx(docs * p, abs=5 * math.sqrt(docs * p) + 1)


def test_large_rates_and_unnamed_sources(spark):
    df = spark.range(1000).selectExpr("id as doc_id", "case when id < 10 then 'rare' else 'rest' end as source")
    n = mixing.replicate(df, {"rare": 1.0}, total_rows=20_000)
    assert n.where("source = 'rest'").count() == 0
    assert n.count() == pytest.approx(20_000, rel=0.05)


def test_odd_and_empty(odd, empty):
    out = mixing.mix(odd)
    assert set(odd.columns) <= set(out.columns)
    rows = out.collect()
    keys = [r["_mix_key"] for r in rows]
    assert keys == sorted(keys)
    assert {r["_mix_copies"] for r in rows if r["doc_id"] == 8} in (set(), *({k} for k in range(1, 9)))
    assert mixing.mix(empty).count() == 0


def test_many_sources_are_joined_by_a_shuffle(spark, docs, monkeypatch):
    """Beyond the bound on broadcast sources the same copies come out, null sources among them."""
    from pyspark.sql import functions as F

    df = docs.withColumn("source", F.when(F.col("doc_id") % 9 != 0, F.col("source")))
    rows = lambda: sorted((r["doc_id"], r["_mix_copy"], r["_mix_copies"], r["_mix_key"]) for r in mixing.replicate(df).collect())
    want = rows()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert rows() == want
