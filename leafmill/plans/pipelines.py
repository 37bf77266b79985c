"""Entry points: each run reads tables and files, applies one plan, writes its outputs and returns the counts of each status."""

from __future__ import annotations

import argparse
import importlib
import tempfile
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leafmill import schemas
from leafmill.config import DEFAULT, Config
from leafmill.functions.text import page_marked_text, utc_iso
from leafmill.operators import assessment, extraction, proceedings, registry, screening, summaries, validation
from leafmill.sources import sinks, tables


def _references(spark: SparkSession, path: str, key: str = "Covidence") -> DataFrame:
    refs = tables.keyed_csv(spark, path, key, schemas.REFERENCE_COLUMNS)
    return refs.select(F.col(key).alias("paper_id"), *[F.coalesce(F.col(c), F.lit("")).alias(c) if c in refs.columns else F.lit("").alias(c) for c in schemas.REFERENCE_COLUMNS])


def run_text(spark: SparkSession, source: str, out: str, reader: extraction.PageReader, ocr: extraction.Ocr | None = None, pattern: str = "*.pdf") -> DataFrame:
    """Text records of a folder; of two files with one prefix the last in sort order holds.

    The reader sees each file once: records and counts of failures come from one pass. A file that fails leaves its earlier record, and
    records of files that are no longer there stay.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(source)
    listed = tables.last_wins(files.select(extraction.id_prefix(F.col("path")).alias("_id"), "path"), "_id", F.col("path"))
    told = Observation("files")
    records = extraction.text_records(files.join(listed.select("path"), "path", "left_semi"), reader, ocr)
    records = records.observe(told, F.count("*").alias("files"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    sinks.replace_records(records.where("error is null").drop("error"), out, ids=listed.select(F.col("_id").alias("paper_id")))
    if failed := told.get["failed"]:
        raise sinks.RunFailed(f"{failed} of {told.get['files']} files could not be read")
    return tables.json_records(spark, out, schemas.TEXT_RECORD_DDL)


def run_screen(records: DataFrame, references: DataFrame, out: str | None = None, config: Config = DEFAULT) -> DataFrame:
    rows = screening.screen(records, references, config)
    if out:
        sinks.write_registry(rows, out, screening.COLUMNS)
    return rows


def run_trim(records: DataFrame, references: DataFrame, out: str | None = None, registry_out: str | None = None, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Trimmed records and the trim registry. references: (paper_id, title, authors).

    Decisions are made once for both outputs. In out, records of these papers are replaced, and go if a paper is no longer trimmed.
    """
    lines = tables.once(proceedings.classify_early(proceedings.flatten_lines(records), config))
    told = tables.once(proceedings.signals(lines, records.select("paper_id", "source_filename", F.coalesce("n_pages", F.lit(0)).alias("n_pages")), config))
    # only volumes are segmented and scored
    numbered = proceedings.block_lines(lines.drop("is_author", "is_title").join(told.where("proceedings_detected").select("paper_id"), "paper_id", "left_semi"))
    best = proceedings.best_match(proceedings.blocks(numbered, config), references)
    decided = tables.once(proceedings.decide(told, best, config))
    trimmed = proceedings.trimmed_records(proceedings.trimmed_pages(numbered, decided, config), decided, records, references)
    rows = proceedings.decision_rows(decided, references)
    if out:
        sinks.replace_records(trimmed, out, ids=records.select("paper_id"), vanish=True)
    if registry_out:
        sinks.write_registry(rows, registry_out, proceedings.DECISION_COLUMNS)
    return trimmed, rows


def _by_mode(rows: DataFrame, records: DataFrame, model_id: str) -> DataFrame:
    """Rows (paper_id, mode, r) as one record a paper with its provenance; r is a struct with extraction_count."""
    told = rows.groupBy("paper_id").agg(
        F.sum("r.extraction_count").cast("int").alias("total_extraction_count"),
        F.struct(*[F.first(F.when(F.col("mode") == m, F.col("r")), ignorenulls=True).alias(m) for m in summaries.modes()]).alias("extraction_modes"),
    )
    return _provenance(told, records, model_id)


def _provenance(rows: DataFrame, records: DataFrame, model_id: str) -> DataFrame:
    of = records.select("paper_id", *[c for c in ("source_filename", "source_sha256", "used_trimmed_text") if c in records.columns])
    return rows.join(of, "paper_id").withColumn("model_id", F.lit(model_id)).withColumn("generated_at_utc", utc_iso(F.current_timestamp()))


def _skipped(records: DataFrame, done: DataFrame) -> DataFrame:
    return records.join(done.select("paper_id").distinct(), "paper_id", "left_semi").select("paper_id", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error"))


def run_extract(
    records: DataFrame, extractor: extraction.Extractor, prompts: dict[str, str], done: DataFrame | None = None, force: bool = False, dry_run: bool = False, individual_only: bool = False, group_only: bool = False,
    out: str | None = None, raw_out: str | None = None, model_id: str = "", chunking: extraction.Chunking = extraction.Chunking(),
) -> tuple[DataFrame, DataFrame]:
    """(summaries for each paper and mode, statuses). Finished papers are left out before the extractor runs.

    out and raw_out take one record a paper, in place of an earlier one; records of other papers stay. A dry run writes nothing.
    """
    done = None if done is None else tables.once(done.select("paper_id").distinct())  # stays as it is while out grows
    todo = records if done is None else sinks.pending(records, done, force=force)
    results, statuses, raw = None, None, None
    for mode, labels in summaries.modes(individual_only, group_only).items():
        got = tables.once(extraction.extract(todo, extractor, prompts.get(mode, ""), dry_run, chunking))  # each span meets the extractor once a pass
        sections = summaries.section_snippets(extraction.exploded(got), list(labels))
        counts = got.where("status = 'processed'").select("paper_id", F.size("extractions").alias("extraction_count"))
        told = summaries.render(sections, counts, labels).join(counts, "paper_id").withColumn("mode", F.lit(mode))
        results = told if results is None else results.unionByName(told)
        found = got.where("status = 'processed'").select("paper_id", F.lit(mode).alias("mode"), F.struct(F.size("extractions").alias("extraction_count"), "extractions").alias("r"))
        raw = found if raw is None else raw.unionByName(found)
        own = got.select("paper_id", "status", "error")
        statuses = own if statuses is None else statuses.unionByName(own)
    worst = F.when(F.max(F.col("status") == "failed"), "failed").otherwise(F.min("status"))
    merged = statuses.groupBy("paper_id").agg(worst.alias("status"), F.first("error", ignorenulls=True).alias("error"))
    merged = tables.once(merged)
    if done is not None and not force:
        merged = merged.unionByName(_skipped(records, done))
    if not dry_run:
        whole = merged.where("status = 'processed'").select("paper_id")  # a paper that fails in one mode leaves no record
        if raw_out:
            sinks.replace_records(_by_mode(raw.join(whole, "paper_id", "left_semi"), todo, model_id), raw_out, ids=whole)
        if out:
            told = results.select("paper_id", "mode", F.struct("section_summaries", "overall_summary", "extraction_count").alias("r"))
            sinks.replace_records(_by_mode(told.join(whole, "paper_id", "left_semi"), todo, model_id), out, ids=whole)
    return results, merged


def run_quality(
    records: DataFrame, specs: DataFrame, extractor: extraction.Extractor, schema: dict | None = None, override: str | None = None,
    done: DataFrame | None = None, out: str | None = None, raw_out: str | None = None, model_id: str = "", chunking: extraction.Chunking = extraction.Chunking(),
) -> DataFrame:
    """Quality records with status and error.

    A first pass finds each paper's type, unless one is given; a second asks for the fields of that type with its own prompt. A paper that
    fails in a pass or has no type, or a record with schema errors, fails: what it tells is its error. Papers in done are skipped.
    out and raw_out take one record a paper, in place of an earlier one; records of other papers stay.
    """
    ordered = specs.groupBy("publication_type").agg(F.min("ord").alias("o")).orderBy("o").collect()
    types = [r["publication_type"] for r in ordered]
    done = None if done is None else tables.once(done.select("paper_id").distinct())  # stays as it is while out grows
    todo = records if done is None else sinks.pending(records, done)
    texts = todo.select("paper_id", page_marked_text(F.col("pages")).alias("text"))
    detected = tables.once(extraction.extract(todo, extractor, assessment.type_prompt(types), override is not None, chunking))  # only blank texts fail where no type is sought
    failed = detected.select("paper_id", F.col("error").alias("_failed"))
    typed = assessment.detect_type(extraction.exploded(detected), texts, types, override).join(failed, "paper_id").withColumn("error", F.coalesce("_failed", "error")).drop("_failed")
    typed = tables.once(typed)
    asked = typed.where("error is null").join(assessment.quality_prompts(specs), "publication_type").select("paper_id", "prompt")
    got = tables.once(extraction.extract(todo.select("paper_id", "pages").join(asked, "paper_id"), extractor, F.col("prompt"), chunking=chunking))
    known = typed.where("error is null").join(got.where("error is null").select("paper_id", "extractions"), "paper_id")
    told = assessment.quality_records(assessment.structured_values(known.select("paper_id", "publication_type"), extraction.exploded(got), specs))
    if schema is not None:
        told = validation.nested_errors(told.withColumn("_json", F.to_json(F.map_concat("values", F.create_map(F.lit("publication_type"), F.col("publication_type"))))), "_json", schema).drop("_json")
        told = told.withColumn("error", validation.error_text(F.col("errors"))).drop("errors")
    else:
        told = told.withColumn("error", F.lit(None).cast("string"))
    for lost in (typed, got):
        told = told.unionByName(lost.where("error is not null").select("paper_id", "error"), allowMissingColumns=True)
    told = tables.once(told.withColumn("status", F.when(F.col("error").isNull(), "processed").otherwise("failed")))
    good = told.where("status = 'processed'").select("paper_id")  # a record with schema errors is not written, nor its raw form
    if done is not None:
        told = told.unionByName(_skipped(records, done), allowMissingColumns=True)
    if raw_out:
        fields = specs.groupBy("publication_type").agg(F.collect_set("field").alias("_fields"))
        raw = known.join(detected.select("paper_id", F.col("extractions").alias("publication_type_detections")), "paper_id").join(fields, "publication_type")
        unmatched = F.filter("extractions", lambda x: ~F.coalesce(F.array_contains(F.col("_fields"), x["extraction_class"]), F.lit(False)))
        raw = raw.select("paper_id", "publication_type", F.col("method").alias("publication_type_method"), "publication_type_detections", "extractions", unmatched.alias("unmatched_extractions"), F.size("extractions").alias("extraction_count"))
        sinks.replace_records(_provenance(raw.join(good, "paper_id", "left_semi"), todo, model_id), raw_out, ids=good)
    if out:
        sinks.replace_records(_provenance(told.where("status = 'processed'").drop("status", "error"), todo, model_id), out, ids=good)
    return told.withColumn("generated_at_utc", utc_iso(F.current_timestamp()))


def run_registry(spark: SparkSession, folders: dict[str, str], out: str | None = None, root: str = "", key: str = "Covidence") -> DataFrame:
    """The artefact registry from folders and files, the last step of every other run.

    folders: paths by name: references, manifest, files, text, text_trimmed, trim_rows, langextract, summary, quality_raw, quality_record.
    A missing one counts as empty.
    """
    records = {"text": schemas.TEXT_RECORD_DDL, "text_trimmed": schemas.TRIMMED_RECORD_DDL, "langextract": schemas.EXTRACTION_RAW_DDL, "summary": schemas.SUMMARY_DDL, "quality_raw": schemas.QUALITY_RAW_DDL, "quality_record": schemas.QUALITY_RECORD_DDL}
    nested = {"pages", "page_char_counts", "extraction_modes", "publication_type_detections", "extractions", "unmatched_extractions", "values", "evidence", "field_order", "ocr_trigger_reasons", "remaining_text_quality_flags"}

    def found(name: str) -> DataFrame:
        r = tables.json_records(spark, folders.get(name, "/nowhere"), records[name])
        return r.select(F.col("_stem").alias("id"), F.regexp_replace("_path", "^file:(//)?", "").alias("path"), *[c for c in r.columns if c not in nested | {"_stem", "_path", "paper_id"}])

    rows = registry.artifact_registry(
        references=tables.keyed_csv(spark, folders.get("references", "/nowhere"), key, schemas.REFERENCE_COLUMNS).withColumnRenamed(key, "id").drop("_pos"),
        manifest=tables.latest_events(spark, folders.get("manifest", "/nowhere")).withColumnRenamed("covidence_id", "id"),
        pdfs=tables.files_by_prefix(tables.list_files(spark, folders.get("files", "/nowhere"), "*.pdf")).select("id", F.transform("paths", lambda p: F.regexp_replace(p, "^file:(//)?", "")).alias("paths")),
        text=found("text"),
        trimmed=found("text_trimmed"),
        trim_rows=tables.keyed_csv(spark, folders.get("trim_rows", "/nowhere"), "paper_id", ("trim_status", "trim_reason")).withColumnRenamed("paper_id", "id"),
        raw=found("langextract"),
        summaries=found("summary"),
        quality_raw=found("quality_raw"),
        quality_records=found("quality_record"),
        root=root,
    )
    if out:
        sinks.write_registry(rows, out, rows.columns)
    return rows


def provider(name: str) -> Any:
    """What `module:attribute` names; a class is called without arguments."""
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return found() if isinstance(found, type) else found


#: Options that a command cannot do without.
NEEDED = {
    "text": ("files", "out"),
    "screen": ("records", "references", "out"),
    "trim": ("records", "references", "out"),
    "extract": ("records", "extractor", "out"),
    "quality": ("records", "dictionary", "extractor", "out"),
    "registry": ("artifact_registry",),
    "sources": ("references", "files", "out"),
}


def _pairs(items: list[str]) -> dict[str, str]:
    return dict(i.split("=", 1) for i in items)


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Run one step over a collection; the artefact registry is rebuilt after it where one is named.")
    p.add_argument("command", choices=list(NEEDED))
    p.add_argument("--records", help="folder of text records")
    p.add_argument("--trimmed", help="folder of trimmed records, which extract and quality prefer")
    p.add_argument("--references", help="reference CSV")
    p.add_argument("--files", help="folder of source files")
    p.add_argument("--pattern", default="*.pdf", help="names of source files to read")
    p.add_argument("--manifest", default="", help="download log")
    p.add_argument("--out", help="what the command writes")
    p.add_argument("--raw-out", help="folder for raw extractions")
    p.add_argument("--registry-out", help="trim registry")
    p.add_argument("--reader", default="leafmill.operators.extraction:PlainPages", help="page reader as module:attribute")
    p.add_argument("--ocr", help="OCR provider as module:attribute")
    p.add_argument("--extractor", help="extractor as module:attribute")
    p.add_argument("--model-id", default="", help="name of the extractor's model, for the records")
    p.add_argument("--max-char-buffer", type=int, default=1200, help="longest span the extractor is asked about")
    p.add_argument("--batch-length", type=int, default=8, help="spans asked at once")
    p.add_argument("--extraction-passes", type=int, default=2)
    p.add_argument("--max-workers", type=int, default=0, help="tasks that ask; 0: as many as shuffle partitions")
    p.add_argument("--prompt", action="append", default=[], metavar="MODE=FILE", help="prompt of an extraction mode")
    p.add_argument("--dictionary", help="quality dictionary CSV")
    p.add_argument("--schema", help="JSON schema of quality records; none: no validation")
    p.add_argument("--publication-type", help="type of all papers, instead of detection")
    p.add_argument("--include-individual", action="store_true")
    p.add_argument("--include-group", action="store_true")
    p.add_argument("--ids", nargs="*", default=[])
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--force", action="store_true", help="do finished papers too, in place of their earlier records")
    p.add_argument("--dry-run", action="store_true", help="check the inputs only")
    p.add_argument("--artifact-registry", help="where the artefact registry is written")
    p.add_argument("--artifact", action="append", default=[], metavar="NAME=PATH", help="a folder or file of the artefact registry")
    p.add_argument("--skip-registry-refresh", action="store_true")
    a = p.parse_args(argv)
    if missing := [n for n in NEEDED[a.command] if not getattr(a, n)]:
        p.error(f"{a.command} needs " + ", ".join(f"--{n.replace('_', '-')}" for n in missing))
    return a


def _inputs(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Chosen text records; with --trimmed, the trimmed record of a paper that has one."""
    records = tables.select_inputs(tables.json_records(spark, a.records, schemas.TEXT_RECORD_DDL), a.ids, a.limit)
    if not a.trimmed:
        return records
    return tables.prefer_trimmed(records, tables.json_records(spark, a.trimmed, schemas.TRIMMED_RECORD_DDL))


def _chunking(a: argparse.Namespace) -> extraction.Chunking:
    return extraction.Chunking(a.max_char_buffer, a.batch_length, a.extraction_passes, a.max_workers)


def _step(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "text":
        run_text(spark, a.files, a.out, provider(a.reader), provider(a.ocr) if a.ocr else None, a.pattern)
    elif a.command == "sources":
        matched, others = tables.files_by_number(tables.list_files(spark, a.files, "*.pdf"))
        rows = registry.source_registry(tables.with_position(tables.read_csv(spark, a.references)), matched, others, tables.latest_events(spark, a.manifest))
        sinks.write_registry(rows, a.out, registry.SOURCE_COLUMNS)
    elif a.command == "screen":
        run_screen(_inputs(spark, a), _references(spark, a.references), a.out)
    elif a.command == "trim":
        refs = _references(spark, a.references)
        run_trim(_inputs(spark, a), refs.select("paper_id", F.col("Title").alias("title"), F.col("Authors").alias("authors")), a.out, a.registry_out)
    elif a.command == "extract":
        done = None if a.force else tables.json_records(spark, a.out, schemas.SUMMARY_DDL).select("paper_id")
        if done is not None and a.raw_out:  # a paper is finished if both outputs have it
            done = done.join(tables.json_records(spark, a.raw_out, schemas.EXTRACTION_RAW_DDL).select("paper_id"), "paper_id")
        prompts = {m: tables.prompt_text(f, "") for m, f in _pairs(a.prompt).items()}
        one = a.include_individual != a.include_group
        _, statuses = run_extract(
            _inputs(spark, a), provider(a.extractor), prompts, done, a.force, a.dry_run, one and a.include_individual, one and a.include_group, a.out, a.raw_out, a.model_id, _chunking(a)
        )
        print("Run summary:", sinks.finish(statuses))
    elif a.command == "quality":
        specs = tables.read_dictionary(spark, a.dictionary)
        records = _inputs(spark, a)
        if a.dry_run:
            print("Run summary:", sinks.finish(extraction.extract(records, provider(a.extractor), "", dry_run=True)))
            return
        done = None if a.force else tables.json_records(spark, a.out, schemas.QUALITY_RECORD_DDL).select("paper_id")
        schema = tables.read_json_schema(a.schema) if a.schema else None
        print("Run summary:", sinks.finish(run_quality(records, specs, provider(a.extractor), schema, a.publication_type, done, a.out, a.raw_out, a.model_id, _chunking(a))))


def _checkpoints(spark: SparkSession) -> None:
    """Results that are used twice go to spark.checkpoint.dir; where it is unset a local master takes a temporary folder."""
    if spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafmill_"))


def main(argv: list[str] | None = None) -> None:
    """Runs a command, then rebuilds the artefact registry; papers that failed end it with status 1 after that."""
    a = _arguments(argv)
    spark = SparkSession.builder.appName("leafmill").getOrCreate()
    _checkpoints(spark)
    failed = None
    try:
        _step(spark, a)
    except sinks.RunFailed as e:
        failed = e
    if a.artifact_registry and not (a.skip_registry_refresh and a.command != "registry"):
        run_registry(spark, _pairs(a.artifact), a.artifact_registry)
    if failed is not None:
        print("Run summary:", failed)
        raise SystemExit(1)


if __name__ == "__main__":
    main()
