"""The event log as a stream: attempts are appended as files, the latest row of each id is kept up to date.

On a stream there is no file order over files, so an order column decides (the finishing time, say). Each micro-batch is reduced
to one row for each id before it meets the table, and the table is rewritten to a new version folder; a pointer names the last
whole one, so a batch that is run again after a failure gives the same table. Several order columns are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.sources.tables import exists


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the last by order; partial aggregation before the shuffle."""
    names = df.columns
    rows = df.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_r"))
    return rows.select("_r.*")


def events_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def _versions(spark: SparkSession, table: str) -> list[int]:
    if not exists(spark, table):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for s in fs.listStatus(path):
        name = s.getPath().getName()
        if name.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{name}/_SUCCESS")):
            out.append(int(name[2:]))
    return sorted(out)


def read_latest(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The table as of the last whole batch."""
    versions = _versions(spark, table)
    return spark.read.schema(schema).parquet(f"{table}/v={versions[-1]}") if versions else spark.createDataFrame([], schema)


def upsert_latest(stream: DataFrame, table: str, checkpoint: str, key: str, order: list[str], keep_versions: int = 2) -> StreamingQuery:
    """Keeps `table` at the latest row of each key; runs over what is available now and stops."""
    schema = stream.schema

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = [v for v in _versions(spark, table) if v < epoch]
        new = latest(batch, key, order)
        if known:
            new = latest(new.unionByName(spark.read.schema(schema).parquet(f"{table}/v={known[-1]}")), key, order)
        new.write.mode("overwrite").parquet(f"{table}/v={epoch}")
        for v in known[: -keep_versions + 1 or None]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v={v}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_per_attempt(stream: DataFrame, key: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Attempts without repeats that arrive within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def status_counts(stream: DataFrame, time: str, status: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Attempts of each status in tumbling windows."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), status).count()
