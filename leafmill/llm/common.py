"""Helpers shared by the training-data operators: reading tables, shared scratch tables, graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Own folders by application, for sessions without spark.checkpoint.dir.
_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset: a temporary folder on a local master, else an error,
    since executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        app = spark.sparkContext.applicationId
        root = _OWN.get(app) or _OWN.setdefault(app, f"file://{tempfile.mkdtemp(prefix='leafmill_')}")
    return root.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


#: Folders of open scopes, the innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that materialise() wrote within it: by then their results must be written or collected."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for folder in _SCOPES.pop():
            path, fs = _path(spark, folder)
            fs.delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: cuts lineage and survives lost executors.

    The table is deleted by drop_materialised(), at the end of the scratch_scope() it was written in, or when the application ends.
    """
    spark = df.sparkSession
    folder = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    path, fs = _path(spark, folder)
    fs.deleteOnExit(path)
    if _SCOPES:
        _SCOPES[-1].append(folder)
    return spark.read.schema(df.schema).parquet(folder)


def drop_materialised(df: DataFrame) -> None:
    """Delete a table of materialise() that no later plan reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path, fs = _path(spark, folder)
        fs.delete(path, True)


def small_enough(df: DataFrame, rows: int, text_bytes: int | None = None) -> bool:
    """Whether df has at most that many rows and, where given, bytes in its columns (arrays as their texts); reads no more than it needs to tell."""
    first = df.limit(rows + 1)
    if text_bytes is None:
        return first.count() <= rows
    size = first.select(F.octet_length(F.to_json(F.struct(*df.columns))).alias("b")).agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return size["n"] <= rows and size["b"] <= text_bytes


#: A node with more than one in HUB_SHARE of the edges is a hub, if it has over HUB_LEAST; there are 2 * HUB_SHARE of them at most.
HUB_SHARE, HUB_LEAST = 1000, 1000


def _tell(edges: DataFrame, key: str, told: DataFrame, edge_count: int, most: int) -> DataFrame:
    """edges with m of the node edges[key]; told: (node, m, n), n its edges, `most` the largest n.

    Rows of hubs don't meet in the task of their key: the hubs, at most 2 * HUB_SHARE rows, are broadcast to them.
    """
    limit = max(HUB_LEAST, edge_count // HUB_SHARE)
    told = told.withColumnRenamed("node", key)
    if most <= limit:
        return edges.join(told.select(key, "m"), key)
    hubs = F.broadcast(told.where(F.col("n") > limit).select(key, "m"))
    return edges.join(hubs, key).unionByName(edges.join(hubs, key, "left_anti").join(told.where(F.col("n") <= limit).select(key, "m"), key))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    edges: (a long, b long), a and b different; nulls are not allowed. Returns (node long, component long), the smallest
    node that can be reached, for every node that has an edge. Partial minima run before each shuffle, and a hub's edges
    are spread over all tasks. Steps go on until each component is a star around its least node: every node but that
    has one edge, which leads there. Each round is written to the shared folder.
    """
    empty = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        ends = now.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(now.select(F.col("b").alias("node"), F.col("a").alias("other")))
        near = materialise(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("m"), F.count("*").alias("n"), F.count_if(F.col("other") < F.col("node")).alias("low")), "near")
        state = near.agg(F.sum("low").alias("edges"), F.max("n").alias("most"), F.max("low").alias("most_low"), F.max((F.col("low") > 0) & (F.col("n") > 1)).alias("open")).first()
        if state["edges"] is None:
            return empty
        if not state["open"]:
            drop_materialised(near)
            break
        # large-star: every neighbour larger than a node is tied to the least of the node and its neighbours
        large = materialise(_tell(now, "b", near.select("node", "m", "n"), state["edges"], state["most"]).select("a", F.col("m").alias("b")).distinct(), "large")
        drop_materialised(now)
        # small-star: every smaller neighbour and the node itself are tied to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumnRenamed("a", "node")
        small = _tell(large, "a", low, state["edges"], state["edges"] if state["most_low"] > HUB_LEAST else 0).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = materialise(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        drop_materialised(near)
        drop_materialised(large)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
