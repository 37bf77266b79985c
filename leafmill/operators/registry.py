"""Registries that join all artefacts by document id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.config import ARTIFACT_NAMES
from leafmill.functions.text import bool_text, falsy_text, join_values, normalize_text, relative_path, strip, utc_iso

# The registry's columns in order.
SOURCE_COLUMNS = [
    "covidence_id", "ref", "study", "title", "authors", "published_year", "journal", "doi", "tags", "pdf_filename", "pdf_path_relative", "pdf_path_absolute", "local_file_count",
    "download_status", "manifest_status", "download_method", "download_url", "manifest_error",
]


def union_by_id(sources: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """Full outer join of sources with unique keys: the key and, for each source, a struct of its other columns (null if absent).

    A tagged union and one aggregation: one shuffle, however many sources there are.
    """
    kinds = {n: F.struct(*[F.col(c) for c in df.columns if c != key]) if len(df.columns) > 1 else F.struct(F.lit(True).alias("present")) for n, df in sources.items()}
    parts = [df.select(F.col(key).cast("string").alias(key), kinds[n].alias(n)) for n, df in sources.items()]
    tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return tagged.groupBy(key).agg(*[F.first(n, ignorenulls=True).alias(n) for n in sources])


def id_order(c: Column) -> list[Column]:
    """Numeric ids first, by value, then the others."""
    t = strip(c)
    digits = t.rlike(r"^\d+$")
    return [(~digits).asc(), F.when(digits, t.try_cast("decimal(38,0)")).asc(), t.asc()]


def artifact_types(flags: dict[str, Column]) -> Column:
    """Names of what is present, in order."""
    return F.concat_ws("; ", *[F.when(flags[n], F.lit(n)) for n in ARTIFACT_NAMES if n in flags])


def download_status(files: Column, manifest: Column) -> Column:
    return F.when(files > 0, "downloaded").otherwise(F.coalesce(F.nullif(strip(F.coalesce(manifest, F.lit(""))), F.lit("")), F.lit("missing")))


def local_download_status(files: Column, manifest: Column) -> Column:
    return F.when(files == 1, "downloaded").when(files > 1, "multiple_local_files").otherwise(download_status(F.lit(0), manifest))


def artifact_registry(references: DataFrame, manifest: DataFrame, pdfs: DataFrame, text: DataFrame, trimmed: DataFrame, trim_rows: DataFrame, raw: DataFrame, summaries: DataFrame, quality_raw: DataFrame, quality_records: DataFrame, root: str = "") -> DataFrame:
    """The registry of all artefacts, one row for each id of any source, all strings.

    references: id and bibliographic columns; manifest: id, status, method, error, finished_at_utc; pdfs: id, paths; the record
    tables: id, path and the record's columns; trim_rows: id and the trim registry's columns. Missing columns count as blank.
    """
    sources = {"reference": references, "manifest": manifest, "pdf": pdfs, "text": text, "text_trimmed": trimmed, "trim_row": trim_rows, "langextract": raw, "summary": summaries, "quality_raw": quality_raw, "quality_record": quality_records}
    u = union_by_id(sources)
    has = {n: F.col(n).isNotNull() for n in sources}
    fields = {n: {f.name: f.dataType.simpleString() for f in df.schema.fields} for n, df in sources.items()}

    def cell(source: str, column: str) -> Column:
        if column not in fields[source]:
            return F.lit("")
        return falsy_text(F.col(source).getField(column), fields[source][column])

    def trim(column: str) -> Column:
        return F.coalesce(F.nullif(cell("text_trimmed", column), F.lit("")), cell("trim_row", column))

    bib = {
        "Ref": "ref", "Study": "study", "Title": "title", "Authors": "authors", "Published Year": "published_year", "Published Month": "published_month", "Journal": "journal",
        "Volume": "volume", "Issue": "issue", "Pages": "pages", "Accession Number": "accession_number", "DOI": "doi", "Notes": "notes", "Tags": "tags",
    }
    paths = F.coalesce(F.col("pdf.paths"), F.array().cast("array<string>"))
    where = lambda n: relative_path(cell(n, "path"), root) if root else cell(n, "path")
    flags = {"reference": has["reference"], "pdf": F.size(paths) > 0} | {n: has[n] for n in ARTIFACT_NAMES[2:]}
    missing = F.size(F.coalesce(F.col("quality_record").getField("missing_fields"), F.array().cast("array<string>"))).cast("string") if "missing_fields" in fields["quality_record"] else F.lit("0")
    out = u.select(
        F.col("id").alias("paper_id"), F.col("id").alias("covidence_id"), bool_text(has["reference"]).alias("reference_present"),
        F.when(has["reference"], "matched_reference").otherwise("orphan_artifact").alias("reference_match_status"),
        *[strip(cell("reference", c)).alias(o) for c, o in bib.items()],
        bool_text(F.size(paths) > 0).alias("pdf_present"), F.size(paths).cast("string").alias("pdf_file_count"),
        join_values(F.transform(paths, lambda p: F.substring_index(p, "/", -1))).alias("pdf_filenames"),
        join_values(F.transform(paths, lambda p: relative_path(p, root) if root else p)).alias("pdf_paths_relative"),
        download_status(F.size(paths), cell("manifest", "status")).alias("download_status"), strip(cell("manifest", "status")).alias("download_manifest_status"),
        strip(cell("manifest", "method")).alias("download_method"), strip(cell("manifest", "error")).alias("download_error"), strip(cell("manifest", "finished_at_utc")).alias("download_finished_at_utc"),
        bool_text(has["text"]).alias("text_json_present"), where("text").alias("text_json_path"),
        *[cell("text", c).alias(f"text_{c}") for c in ("source_filename", "source_sha256", "extracted_at_utc", "n_pages", "needs_ocr", "ocr_applied", "ocr_error")],
        cell("trim_row", "trim_status").alias("text_trim_status"), cell("trim_row", "trim_reason").alias("text_trim_reason"),
        bool_text(has["text_trimmed"]).alias("text_trimmed_present"), where("text_trimmed").alias("text_trimmed_path"),
        trim("trim_method").alias("text_trim_method"), trim("match_score").alias("text_trim_match_score"), trim("start_page_index").alias("text_trim_start_page"),
        trim("end_page_index").alias("text_trim_end_page"), trim("source_text_json_path").alias("text_trim_source_text_json_path"),
        bool_text(has["langextract"]).alias("langextract_raw_present"), where("langextract").alias("langextract_raw_path"),
        *[cell("langextract", c).alias(f"langextract_{c}") for c in ("model_id", "generated_at_utc", "total_extraction_count")],
        bool_text(has["summary"]).alias("summary_json_present"), where("summary").alias("summary_json_path"),
        *[cell("summary", c).alias(f"summary_{c}") for c in ("model_id", "generated_at_utc", "total_extraction_count")],
        bool_text(has["quality_raw"]).alias("quality_raw_present"), where("quality_raw").alias("quality_raw_path"),
        *[cell("quality_raw", c).alias(f"quality_{c}") for c in ("model_id", "generated_at_utc", "publication_type", "extraction_count")],
        bool_text(has["quality_record"]).alias("quality_record_present"), where("quality_record").alias("quality_record_path"),
        *[cell("quality_record", c).alias(f"quality_record_{c}") for c in ("model_id", "generated_at_utc", "publication_type")],
        missing.alias("quality_missing_field_count"), artifact_types(flags).alias("artifact_types_present"), utc_iso(F.current_timestamp()).alias("registry_updated_at_utc"),
    )
    return out.orderBy(*id_order(F.col("paper_id")))


def source_registry(references: DataFrame, files: DataFrame, unmatched: DataFrame, manifest: DataFrame, root: str = "", key: str = "Covidence", pos: str = "_pos") -> DataFrame:
    """References with their files and download status, then leftover files sorted by path.

    references keeps its file order in pos; files: (id, paths); unmatched: (path). Files go to the first row of an id only.
    """
    rel = (lambda p: relative_path(p, root)) if root else (lambda p: p)
    r = references.withColumn("_id", strip(F.coalesce(F.col(key), F.lit(""))))
    r = r.withColumn("_rn", F.row_number().over(Window.partitionBy("_id").orderBy(pos)))
    m = manifest.select(F.col("covidence_id").alias("_id"), *[strip(F.coalesce(F.col(c), F.lit(""))).alias(f"_m_{c}") for c in ("status", "method", "download_url", "error")])
    j = r.join(files.withColumnRenamed("id", "_id"), "_id", "left").join(m, "_id", "left")
    paths = F.when(F.col("_rn") == 1, F.coalesce("paths", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    told = lambda c: F.coalesce(F.col(f"_m_{c}"), F.lit(""))
    bib = {"Ref": "ref", "Study": "study", "Title": "title", "Authors": "authors", "Published Year": "published_year", "Journal": "journal", "DOI": "doi", "Tags": "tags"}
    cells = [strip(F.coalesce(F.col(c), F.lit(""))).alias(o) if c in references.columns else F.lit("").alias(o) for c, o in bib.items()]
    joined = j.withColumn("_paths", paths).select(
        F.lit(0).alias("_part"), F.col(pos).cast("long").alias("_at"), F.col("_id").alias("covidence_id"), *cells,
        F.array_join(F.transform("_paths", lambda p: F.substring_index(p, "/", -1)), " | ").alias("pdf_filename"), F.array_join(F.transform("_paths", rel), " | ").alias("pdf_path_relative"),
        F.array_join("_paths", " | ").alias("pdf_path_absolute"), F.size("_paths").cast("string").alias("local_file_count"), local_download_status(F.size("_paths"), told("status")).alias("download_status"),
        told("status").alias("manifest_status"), told("method").alias("download_method"), told("download_url").alias("download_url"), told("error").alias("manifest_error"),
    )
    left = files.join(r.select(F.col("_id").alias("id")).distinct(), "id", "left_anti").select(F.explode("paths").alias("path")).unionByName(unmatched.select("path"))
    blank = [F.lit("").alias(c) for c in bib.values()]
    rest = left.select(
        F.lit(1).alias("_part"), F.lit(0).cast("long").alias("_at"), F.regexp_extract(F.substring_index("path", "/", -1), r"(?i)^(\d+)_.+\.pdf$", 1).alias("covidence_id"), *blank,
        F.substring_index("path", "/", -1).alias("pdf_filename"), rel(F.col("path")).alias("pdf_path_relative"), F.col("path").alias("pdf_path_absolute"), F.lit("1").alias("local_file_count"),
        F.lit("unmatched_local_file").alias("download_status"), *[F.lit("").alias(c) for c in ("manifest_status", "download_method", "download_url", "manifest_error")],
    )
    return joined.unionByName(rest).orderBy("_part", "_at", "pdf_path_absolute").select(*SOURCE_COLUMNS)


def cascade_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Of (id, doi, title) on both sides: pairs by DOI, then, for what is left, by normalised title; match_method tells which."""
    a = left.select(F.col("id").alias("left_id"), F.lower(strip(F.coalesce("doi", F.lit("")))).alias("_doi"), normalize_text(F.col("title")).alias("_title"))
    b = right.select(F.col("id").alias("right_id"), F.lower(strip(F.coalesce("doi", F.lit("")))).alias("_doi"), normalize_text(F.col("title")).alias("_title"))
    by_doi = a.where("_doi <> ''").join(b.where("_doi <> ''"), "_doi").groupBy("left_id").agg(F.min("right_id").alias("right_id")).withColumn("match_method", F.lit("doi"))
    rest = a.join(by_doi, "left_id", "left_anti").where("_title <> ''")
    by_title = rest.join(b.where("_title <> ''"), "_title").groupBy("left_id").agg(F.min("right_id").alias("right_id")).withColumn("match_method", F.lit("title"))
    return by_doi.unionByName(by_title)
