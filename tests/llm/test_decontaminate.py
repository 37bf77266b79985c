from pathlib import Path

import brute
import pyarrow as pa
import pyarrow.parquet as pq
from conftest import prose

from leafmill.llm import decontaminate, registry
from oracle import assert_same
from pyspark.sql import functions as F


def digest(found):
    return {
        r["doc_id"]: (r["n_words"], r["n_hit"], r["n"], r["sha"], r["n_hit"] > 0)
        for r in found.select("doc_id", "n_words", decontaminate.covered(F.col("spans")).alias("n_hit"), F.size("items").alias("n"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("sha")).collect()
    }


def test_query_equals_sql(spark, sf):
    assert_same(registry.queries()["op1_decontamination"](spark, sf), registry.oracle_sql()["op1_decontamination"], sf)


def test_both_ways_equal_brute_force(spark, odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").distinct().collect() if r["doc_id"] is not None]
    p = prose(1, 70).split()
    items = [(1, " ".join(p[5:25])), (2, " ".join(p[5:25])), (3, "TWO words"), (4, "ab"), (5, ""), (6, None), (7, "..."), (8, prose(4, 9)), (9, " ".join(p[60:70]) + " other"), (9, " ".join(p[60:70]) + " other"), (10, "ünïcode ñandú")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0)).withColumn("h", F.lit(0))
    want = brute.decontaminate(docs, items)
    for bound in (10_000, 0):
        got = digest(decontaminate.hits(odd, table, broadcast_windows=bound))
        assert got.pop(None)[1] > 0
        assert got == want, bound


def test_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    for bound in (10_000, 0):
        assert decontaminate.hits(empty, items, broadcast_windows=bound).count() == 0
        assert all(r["spans"] == [] and r["items"] == [] for r in decontaminate.hits(odd, items, broadcast_windows=bound).collect())


def test_items_without_an_id_are_sought(spark, sf, docs, tmp_path):
    """Equal to the SQL where long and short items have null ids."""
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(4).collect()]
    rows = [(None, texts[0]), (None, texts[1]), (None, " ".join(texts[2].split()[:4])), (7, texts[1]), (8, texts[3]), (None, None)]
    for f in Path(sf).glob("*.parquet"):
        if f.name != "benchmark.parquet":
            (tmp_path / f.name).symlink_to(f)
    pq.write_table(pa.table({"item_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}), tmp_path / "benchmark.parquet")
    assert_same(decontaminate.op1_decontamination(spark, str(tmp_path)), decontaminate.OP1_SQL, str(tmp_path))
    items = spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    told = [decontaminate.hits(docs, items, broadcast_windows=n).selectExpr("doc_id", "array_sort(spans) as s", "items").orderBy("doc_id").collect() for n in (0, 10**6)]
    assert told[0] == told[1] and any(r["items"] == [None] for r in told[0])
