"""Readers: keyed CSV tables, event logs, JSON records, file listings, dictionaries, bibliographic files, prompt assets."""

from __future__ import annotations

import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.config import DICTIONARY_COLUMNS
from leafmill.functions.text import id_prefix, stem, strip
from leafmill.schemas import MANIFEST_DDL, PAGES, ddl


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer files than cores, dealt out over all cores; any other is left as it is.

    A file of one row group is one task, whatever the number of cores. What is dealt out is bounded by SPREAD_BYTES; large inputs have more
    files than cores and aren't shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(cores)


#: Own folders by application, for local masters without a checkpoint folder.
_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the session's checkpoint folder, which all executors share. Where that is unset a local master has a temporary folder, another one none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _OWN.get(app) or _OWN.setdefault(app, f"file://{tempfile.mkdtemp(prefix='leafmill_')}")
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path, fs = hadoop_path(spark, folder)
    fs.deleteOnExit(path)
    return folder


def once(df: DataFrame) -> DataFrame:
    """df computed once for several uses: in the session's checkpoint folder, or cached where it has none."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def with_position(df: DataFrame, name: str = "_pos") -> DataFrame:
    """A column that rises in file order within a partition and over the partitions of one read."""
    return df.withColumn(name, F.monotonically_increasing_id())


def last_wins(df: DataFrame, key: str, order: list[Column] | Column) -> DataFrame:
    """The last row of each key; keys are trimmed and blank ones dropped."""
    order = order if isinstance(order, list) else [order]
    keyed = df.withColumn(key, strip(F.coalesce(F.col(key).cast("string"), F.lit("")))).where(F.col(key) != "")
    w = Window.partitionBy(key).orderBy(*[o.desc() for o in order])
    return keyed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; cells may hold line breaks and doubled quotes."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)


def keyed_csv(spark: SparkSession, path: str, key: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key, the last duplicate wins. A missing file gives no rows (columns then names them)."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in dict.fromkeys((key, *columns))))
    return last_wins(with_position(read_csv(spark, path)), key, F.col("_pos")).drop("_pos")


def latest_events(spark: SparkSession, path: str, key: str = "covidence_id", schema: str = MANIFEST_DDL) -> DataFrame:
    """Last row for each id of a JSON-lines log in file order; blank lines and ids are skipped, a malformed line fails the read."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = with_position(spark.read.text(path).where(strip(F.col("value")) != ""))
    rows = lines.select("_pos", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("_pos", "r.*")
    return last_wins(rows, key, F.col("_pos")).drop("_pos")


def json_paths(spark: SparkSession, directory: str) -> DataFrame:
    """id, path of *.json files, sorted by id; contents are not read."""
    return list_files(spark, directory, "*.json").select(stem(F.col("path")).alias("id"), "path").orderBy("id")


#: The partition column of folders that sinks.replace_records() writes.
BUCKET = "bucket"


def bucket_folders(spark: SparkSession, directory: str) -> list[str]:
    """The names of a directory's buckets; none if it has another layout."""
    p, fs = hadoop_path(spark, f"{directory.rstrip('/')}/{BUCKET}=*-of-*")
    return [f.getPath().getName().split("=", 1)[1] for f in fs.globStatus(p) or []]


def holds_lines(spark: SparkSession, directory: str) -> bool:
    """Whether a directory was written by Spark: part files with one record a line, in buckets or not."""
    p, fs = hadoop_path(spark, f"{directory.rstrip('/')}/part-*.json*")
    return bool(fs.globStatus(p)) or bool(bucket_folders(spark, directory))


def json_records(spark: SparkSession, directory: str, schema: str, key: str = "paper_id") -> DataFrame:
    """Records with _stem and _path; a missing directory gives no rows.

    A directory of documents has one object a file, whose stem is the id; one written by sinks.write_records has one a line, and the
    record's key stands for the stem, as in one written by sinks.replace_records.
    """
    if not exists(spark, directory):
        return spark.createDataFrame([], schema + ", _stem string, _path string")
    lines = holds_lines(spark, directory)
    reader = spark.read.schema(schema)
    df = reader.json(directory) if lines else reader.option("multiLine", True).option("pathGlobFilter", "*.json").json(directory)
    df = df.withColumn("_path", F.col("_metadata.file_path"))
    if BUCKET not in ddl(schema).names:
        df = df.drop(BUCKET)
    return df.withColumn("_stem", F.col(key).cast("string") if lines else stem(F.col("_path")))


def list_files(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """path, length and modificationTime; contents are pruned."""
    if not exists(spark, directory):
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long")
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory).select("path", "modificationTime", "length")


def files_by_prefix(files: DataFrame) -> DataFrame:
    """id (before the first underscore, of any kind) and its sorted paths."""
    return files.groupBy(id_prefix(F.col("path")).alias("id")).agg(F.sort_array(F.collect_list("path")).alias("paths"))


def files_by_number(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files named `digits_anything.pdf` by id with their sorted paths, and the paths of the others."""
    named = files.withColumn("id", F.regexp_extract(F.substring_index("path", "/", -1), r"(?i)^(\d+)_.+\.pdf$", 1))
    return named.where("id <> ''").groupBy("id").agg(F.sort_array(F.collect_list("path")).alias("paths")), named.where("id = ''").select("path")


def content_hash(files: DataFrame) -> DataFrame:
    """files of binaryFile with their SHA-256."""
    return files.withColumn("source_sha256", F.sha2("content", 256))


def is_pdf(content: Column, content_type: Column | None = None) -> Column:
    """PDF magic bytes, or a content type that says so."""
    magic = F.substring(content, 1, 4) == F.lit(b"%PDF")
    return magic if content_type is None else magic | F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("pdf"))


def select_inputs(df: DataFrame, ids: list[str] = (), limit: int = 0, stem_col: str = "_stem", trim_ids: bool = True) -> DataFrame:
    """Sorted by file stem, kept if in ids (none: all), the first `limit` (0: all)."""
    wanted = [i.strip() for i in ids if i.strip()] if trim_ids else list(ids)
    out = df.where(F.col(stem_col).isin(wanted)) if wanted else df
    out = out.orderBy(stem_col)
    return out.limit(limit) if limit > 0 else out


def prefer_trimmed(records: DataFrame, trimmed: DataFrame, key: str = "_stem") -> DataFrame:
    """Each record, or its trimmed one as a whole if there is one; used_trimmed_text tells which."""
    names = [c for c in records.columns if c != key and c in trimmed.columns]
    t = trimmed.select(key, F.struct(*names).alias("_t"))
    joined = records.select(key, F.struct(*names).alias("_r")).join(t, key, "left")
    return joined.select(key, *[F.when(F.col("_t").isNotNull(), F.col(f"_t.{n}")).otherwise(F.col(f"_r.{n}")).alias(n) for n in names], F.col("_t").isNotNull().alias("used_trimmed_text"))


def prompt_text(path: str | None, default: str) -> str:
    """A prompt file's text; the default if the file is missing or blank."""
    text = Path(path).read_text(encoding="utf-8").strip() if path and Path(path).exists() else ""
    return text or default


def example_payload(path: str | None, default: list[dict]) -> list[dict]:
    """Few-shot examples of a JSON file; the default if it is missing."""
    if not path or not Path(path).exists():
        return default
    payload = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(payload, list):
        raise ValueError(f"{path}: a list of examples is expected")
    return payload


def clean_examples(df: DataFrame) -> DataFrame:
    """Of (text, extractions): trimmed, without blank classes or texts, and without examples that lose all extractions."""
    trimmed = F.transform("extractions", lambda e: F.struct(strip(F.coalesce(e["extraction_class"], F.lit(""))).alias("extraction_class"), strip(F.coalesce(e["extraction_text"], F.lit(""))).alias("extraction_text")))
    kept = F.filter(trimmed, lambda e: (e["extraction_class"] != "") & (e["extraction_text"] != ""))
    return df.select(strip(F.coalesce("text", F.lit(""))).alias("text"), kept.alias("extractions")).where((F.col("text") != "") & (F.size("extractions") > 0))


def split_accepted(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), strip), lambda x: x != "")


def field_specs(raw: DataFrame) -> DataFrame:
    """Field specifications of a dictionary: trimmed, blank types and fields dropped, ord in file order."""
    missing = sorted(set(DICTIONARY_COLUMNS) - set(raw.columns))
    if missing:
        raise ValueError(f"dictionary lacks columns: {', '.join(missing)}")
    ordered = raw if "ord" in raw.columns else raw.withColumn("ord", F.monotonically_increasing_id())
    cells = {c: strip(F.coalesce(F.col(c), F.lit(""))) for c in DICTIONARY_COLUMNS if c != "accepted"}
    return ordered.select("ord", *[v.alias(k) for k, v in cells.items()], split_accepted(F.col("accepted")).alias("accepted")).where("publication_type <> '' and field <> ''")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    specs = field_specs(read_csv(spark, path))
    if specs.isEmpty():
        raise ValueError(f"{path}: no usable field")
    return specs


def read_json_schema(path: str) -> dict:
    if not Path(path).exists():
        raise FileNotFoundError(path)
    return json.loads(Path(path).read_text(encoding="utf-8"))


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """Bibliographic records of a tagged file: rec, and a map from each tag to its values in order."""
    recs = with_position(spark.read.option("lineSep", "ER  -").text(path), "rec").where("value rlike '(?m)^[A-Z][A-Z0-9]  - '")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.rlike(r"^[A-Z][A-Z0-9]  - "))
    pairs = F.transform(lines, lambda x: F.struct(F.substring(x, 1, 2).alias("tag"), strip(F.substring(x, 7, 1 << 20)).alias("v")))
    tags = F.array_distinct(F.transform(pairs, lambda p: p["tag"]))
    return recs.select("rec", F.map_from_arrays(tags, F.transform(tags, lambda t: F.transform(F.filter(pairs, lambda p: p["tag"] == t), lambda p: p["v"]))).alias("tags"))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags become spaces."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), "<[^>]*>", " ")


def pages_from_text(df: DataFrame, id_col: str, text_col: str, page_break: str = "\n") -> DataFrame:
    """Text records whose pages are the pieces between page_break."""
    pieces = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), page_break), lambda t, i: F.struct(i.alias("page_index"), t.alias("text")))
    return df.select(F.col(id_col).cast("string").alias("paper_id"), pieces.cast(PAGES.split(" ", 1)[1]).alias("pages"))
