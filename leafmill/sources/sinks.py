"""Writers and run accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.sources.tables import BUCKET, bucket_folders, exists, hadoop_path, holds_lines, once


def write_records(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines, the scalable form of one object a document."""
    df.write.mode("append" if append else "overwrite").json(path)


#: Buckets of a folder that replace_records() lays out anew; each is one file, or several of at most BUCKET_ROWS records.
BUCKETS, BUCKET_ROWS = 64, 200_000


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of a key, with the number of buckets in its name, so that a folder tells its own layout."""
    return F.format_string("%05d-of-%05d", F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)), F.lit(buckets))


def replace_records(df: DataFrame, path: str, key: str = "paper_id", ids: DataFrame | None = None, vanish: bool = False, buckets: int = BUCKETS) -> None:
    """Put df's records in place of those with the same key; all other records stay.

    The folder is JSON lines in buckets of a hash of the key. Only buckets of keys in `ids` (a superset of df's keys that is cheaper to
    tell than df; None: df's own, for which df is kept) are read, merged and overwritten, by Spark's dynamic partition overwrite. With
    `vanish`, a key in ids that df does not have loses its record, else it keeps it. Keys of df are unique.

    df is computed once. Nothing changes before all tasks have ended; a run that dies while the buckets are exchanged may leave a bucket
    out, never a record twice, and pending() finds what is missing. A folder of write_records() is laid out in buckets as a whole.
    """
    spark = df.sparkSession
    named = bucket_folders(spark, path)
    buckets = int(named[0].rsplit("-", 1)[1]) if named else buckets
    if ids is None:
        df = once(df)
        ids = df.select(key)
    ids = ids.select(key).distinct()
    fresh = df.withColumn(BUCKET, bucket_of(F.col(key), buckets)).withColumn("_old", F.lit(False))
    stale = not named and exists(spark, path) and holds_lines(spark, path)
    touched = [r[0] for r in ids.select(bucket_of(F.col(key), buckets)).distinct().collect()] if named else []  # at most as many as buckets
    merged, emptied = fresh, []
    if stale or set(touched) & set(named):
        if stale:
            old = spark.read.schema(df.schema).json(path).withColumn(BUCKET, bucket_of(F.col(key), buckets))
        else:
            old = spark.read.schema(fresh.drop("_old").schema).json(path).where(F.col(BUCKET).isin(touched))
        if vanish:
            old = old.join(ids, key, "left_anti")
            emptied = touched
        first = Window.partitionBy(BUCKET, key).orderBy("_old")
        both = fresh.unionByName(old.withColumn("_old", F.lit(True))).repartition(BUCKET)
        merged = both.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    merged = merged.drop("_old")
    if emptied:  # an overwrite leaves a bucket to which no record goes as it was
        merged = once(merged)
        left = {r[0] for r in merged.select(BUCKET).distinct().collect()}
        emptied = [b for b in emptied if b not in left and b in named]
    if stale:
        merged = once(merged)  # the files read are about to go
    writer = merged.repartition(BUCKET).write.partitionBy(BUCKET).option("maxRecordsPerFile", BUCKET_ROWS).mode("overwrite")
    writer.option("partitionOverwriteMode", "static" if stale else "dynamic").json(path)
    for b in emptied:
        folder, fs = hadoop_path(spark, f"{path.rstrip('/')}/{BUCKET}={b}")
        fs.delete(folder, True)


def export_documents(df: DataFrame, directory: str, key: str = "paper_id", indent: int = 2) -> None:
    """One pretty JSON file a document, written from the executors; directory must be a path that all of them share."""
    packed = df.select(F.col(key).cast("string").alias("k"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"))

    def write(rows):
        import json
        import os

        os.makedirs(directory, exist_ok=True)
        for r in rows:
            part = os.path.join(directory, f".{r['k']}.part")
            with open(part, "w", encoding="utf-8") as f:
                json.dump(json.loads(r["j"]), f, ensure_ascii=False, indent=indent)
            os.replace(part, os.path.join(directory, f"{r['k']}.json"))  # a task that is run again leaves whole files

    packed.foreachPartition(write)


def write_registry(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV in a fixed column order, overwritten as a whole."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def pending(todo: DataFrame, *outputs: DataFrame, key: str = "paper_id", force: bool = False) -> DataFrame:
    """Rows of todo that lack at least one of the outputs."""
    if force or not outputs:
        return todo
    done = outputs[0].select(key).distinct()
    for o in outputs[1:]:
        done = done.join(o.select(key).distinct(), key)
    return todo.join(done, key, "left_anti")


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


class RunFailed(RuntimeError):
    """Some documents failed; the others were written."""


def finish(df: DataFrame, status: str = "status") -> dict[str, int]:
    """Counts of each status; raises RunFailed if any document failed."""
    counts = {r[status]: r["n"] for r in status_counts(df, status).collect()}
    if counts.get("failed"):
        raise RunFailed(str(counts))
    return counts
