import random

import brute
import pytest
from pyspark.sql import SparkSession

from leafmill.llm import common


def parts(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    return {r["node"]: r["component"] for r in common.connected_components(df).collect()}


def test_components_of_long_chains_large_ids_and_hubs(spark, monkeypatch):
    r = random.Random(3)
    order = list(range(5000))
    r.shuffle(order)
    chain = list(zip(order[:-1], order[1:], strict=True))
    top = 2**63 - 1
    edges = chain + [(top - i, top - i - 1) for i in range(40)] + [(10_000, 10_001 + i) for i in range(300)] + [(20_000 + i, 30_000) for i in range(300)] + [(-5, -9), (-9, -7)]
    want = brute.components(edges, {n for e in edges for n in e})
    assert parts(spark, edges) == want
    monkeypatch.setattr(common, "HUB_LEAST", 50)
    monkeypatch.setattr(common, "HUB_SHARE", 100)
    assert parts(spark, edges[5100:]) == brute.components(edges[5100:], {n for e in edges[5100:] for n in e})
    assert parts(spark, edges) == want
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


class Session:
    """What scratch_root() asks of a session."""

    def __init__(self, master):
        self.conf, self.sparkContext, self.master, self.applicationId = self, self, master, "app"

    def get(self, key, default):
        return default


def test_scratch_folder(spark: SparkSession):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_root(Session("spark://host:7077"))
    assert common.scratch_root(Session("local[2]")).startswith("file://")
    with common.scratch_scope(spark):
        df = common.materialise(spark.range(5), "five")
        assert df.count() == 5
        files = df.inputFiles()
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
