"""The operators over the driver's tables, one query each, with equivalent SQL where there is one.

The tables stand in for documents: VOLUME_PAGES consecutive documents make a volume, a document is a page of it, and each page
opens with an abstract code made from the document's id.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.config import DEFAULT, Config
from leafmill.functions import fuzzy, text, values
from leafmill.operators import acquisition, assessment, extraction, proceedings, quality, registry, screening, summaries, validation
from leafmill.sources import sinks, tables
from leafmill.streaming import manifest as manifest_stream

VOLUME_PAGES = 50


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return tables.spread(_t(spark, sf, "documents"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """A text record for each document, its lines as pages."""
    r = tables.pages_from_text(_docs(spark, sf), "doc_id", "text")
    return r.withColumn("page_char_counts", F.transform("pages", lambda p: F.length(p["text"]))).withColumn("n_pages", F.size("pages")).withColumn("source_filename", F.lit(""))


def _volume_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select(
        F.floor(F.col("doc_id") / VOLUME_PAGES).cast("string").alias("paper_id"),
        (F.col("doc_id") % VOLUME_PAGES).cast("int").alias("page_index"),
        F.concat(F.format_string("%03d. ", F.col("doc_id") % 1000), F.coalesce("text", F.lit(""))).alias("text"),
    )


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return proceedings.classify(proceedings.lines_of_pages(_volume_pages(spark, sf)))


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return proceedings.blocks(proceedings.block_lines(proceedings.starts(proceedings.lines_of_pages(_volume_pages(spark, sf)))))


def _volumes(spark: SparkSession, sf: str) -> DataFrame:
    return _volume_pages(spark, sf).groupBy("paper_id").agg(F.count("*").cast("int").alias("n_pages"), F.lit("").alias("source_filename"))


def _volume_references(spark: SparkSession, sf: str) -> DataFrame:
    """For each volume the first line of its last page, and that page's first two words as authors."""
    w = F.split(F.col("text"), "[ \n]+", 3)
    page = F.struct(F.substring_index("text", "\n", 1).alias("title"), F.concat(F.coalesce(F.get(w, F.lit(0)), F.lit("")), F.lit(", A; "), F.coalesce(F.get(w, F.lit(1)), F.lit("")), F.lit(", B")).alias("authors"))
    v = F.floor(F.col("doc_id") / VOLUME_PAGES).alias("v")
    ids = _t(spark, sf, "documents").groupBy(v).agg(F.max("doc_id").alias("doc_id"))
    last = _docs(spark, sf).join(ids.select("doc_id"), "doc_id", "left_semi").groupBy(v).agg(F.max_by(page, "doc_id").alias("p"))  # only last pages are looked into
    return last.select(F.col("v").cast("string").alias("paper_id"), "p.title", "p.authors")


def _extractions(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("paper_id"), F.col("turn").alias("pos"), F.col("role").alias("extraction_class"), F.col("text").alias("extraction_text"))


SECTION_LABELS = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
#: publication_type, field, section, criterion_text, entry_guidance, inferred_type, accepted
SPECS = [
    ("even", "user", "S", "Is the question clear?", "", "binary_ordinal", ""),
    ("even", "assistant", "S", "", "Name the answer", "string", "NA"),
    ("even", "grade", "R", "Rate it", "", "categorical", "poor; fair; good"),
    ("odd", "assistant", "S", "Count", "", "integer", ""),
    ("odd", "system", "S", "", "Copy the text", "integer_or_string_id", "NA; none"),
    ("odd", "owner", "R", "Who?", "", "string", ""),
]
TYPES = ["Observ Cohort & Cross sect", "Case Control", "Case Series & Reports", "Before-After (Pre-Post) N contr", "Controlled Intervention Studies"]


def _specs(spark: SparkSession) -> DataFrame:
    rows = [(i, *s) for i, s in enumerate(SPECS)]
    return tables.field_specs(spark.createDataFrame(rows, "ord int, publication_type string, field string, section string, criterion_text string, entry_guidance string, inferred_type string, accepted string"))


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "conversations").select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("paper_id"), F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd").alias("publication_type"))


def q_normalize_text(spark, sf):
    return _docs(spark, sf).select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


def q_token_sets(spark, sf):
    t = F.array_sort(text.token_set(F.col("text"), 3))
    return _docs(spark, sf).select("doc_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


def q_control_char_count(spark, sf):
    return _docs(spark, sf).select("doc_id", text.control_char_count(F.col("text")).cast("bigint").alias("n"))


def q_text_quality_flags(spark, sf):
    r = quality.ocr_decision(_records(spark, sf))
    return r.select("paper_id", F.array_join("ocr_trigger_reasons", ",").alias("flags"), "needs_ocr_before_ocr", "ocr_mode")


def q_latest_manifest(spark, sf):
    e = _t(spark, sf, "events").select("user_id", "event_type", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("finished_at"))
    return manifest_stream.latest(e, "user_id", ["finished_at", "event_id"])


def q_reference_last_wins(spark, sf):
    c = _t(spark, sf, "conversations").withColumn("conv_id", F.concat(F.lit(" "), F.col("conv_id").cast("string"), F.lit(" ")))
    return tables.last_wins(c, "conv_id", F.col("turn")).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


def _artifacts(spark, sf):
    docs, labels, pages, bench = _docs(spark, sf), _t(spark, sf, "labels"), _t(spark, sf, "pages"), _t(spark, sf, "benchmark")
    conv = _t(spark, sf, "conversations")
    s = lambda c: F.col(c).cast("string").alias("id")
    empty = lambda ddl: spark.createDataFrame([], ddl)
    events = _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("t"), "event_id")
    last = manifest_stream.latest(events, "id", ["t", "event_id"]).select("id", "status")
    return registry.artifact_registry(
        references=bench.select(s("item_id"), F.col("text").alias("Title")),
        manifest=last,
        pdfs=pages.select(s("page_id"), F.array(F.concat(F.lit("/data/pages/"), F.col("page_id"), F.lit("_a.pdf"))).alias("paths")),
        text=docs.select(s("doc_id"), F.concat(F.lit("/data/text/"), F.col("doc_id"), F.lit(".json")).alias("path"), F.size(F.split("text", "\n")).alias("n_pages"), (F.col("n_chars") < 50).alias("needs_ocr")),
        trimmed=empty("id string, path string"),
        trim_rows=empty("id string, trim_status string"),
        raw=conv.groupBy(s("conv_id")).agg(F.count("*").cast("int").alias("total_extraction_count")),
        summaries=empty("id string, path string"),
        quality_raw=labels.where("quality = 1").select(s("doc_id"), F.lit("m1").alias("model_id")),
        quality_records=labels.select(s("doc_id"), F.when(F.col("toxic") == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("missing_fields")),
        root="/data",
    )


def q_artifact_registry(spark, sf):
    return _artifacts(spark, sf).select(
        "paper_id", "reference_match_status", "title", "pdf_file_count", "pdf_filenames", "pdf_paths_relative", "download_status", "text_json_path", "text_n_pages", "text_needs_ocr",
        "langextract_total_extraction_count", "quality_model_id", "quality_missing_field_count", "artifact_types_present",
    )


def _source_inputs(spark, sf):
    refs = _t(spark, sf, "benchmark").select((F.col("item_id") - F.col("item_id") % 2).cast("string").alias("Covidence"), F.col("text").alias("Title"), F.col("item_id").alias("_pos"))
    pages = _t(spark, sf, "pages").select(F.when(F.col("page_id") % 7 == 3, F.concat(F.lit("/data/x"), F.col("page_id"), F.lit("_p.pdf"))).otherwise(F.concat(F.lit("/data/"), F.col("page_id") - F.col("page_id") % 3, F.lit("_p"), F.col("page_id"), F.lit(".pdf"))).alias("path"))
    matched, others = tables.files_by_number(pages)
    log = _t(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("covidence_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status")).select("covidence_id", "status", *[F.lit("").alias(c) for c in ("method", "download_url", "error")])
    return refs, matched, others, log


def q_source_registry(spark, sf):
    out = registry.source_registry(*_source_inputs(spark, sf), root="/data")
    return out.select("covidence_id", F.md5("title").alias("title_md5"), "pdf_filename", "pdf_path_relative", "local_file_count", "download_status", "manifest_status")


def q_screen_documents(spark, sf):
    refs = _t(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("Covidence"), F.col("text").alias("Title"), F.lit("Annual Meeting").alias("Journal"))
    return screening.screen(_records(spark, sf), refs).drop("screened_at_utc")


def q_flatten_lines(spark, sf):
    return proceedings.lines_of_pages(_volume_pages(spark, sf)).select("paper_id", "page_index", "line_index", F.md5("text").alias("text_md5"))


def q_line_classes(spark, sf):
    return _lines(spark, sf).select("paper_id", "page_index", "line_index", "is_start", "is_author", "is_institution", "is_footer", "is_title")


def q_proceedings_signals(spark, sf, config: Config = DEFAULT):
    return proceedings.signals(_lines(spark, sf), _volumes(spark, sf), config).drop("source_filename")


def q_abstract_blocks(spark, sf):
    b = _blocks(spark, sf)
    return b.select("paper_id", F.col("block_no").cast("bigint").alias("block_no"), "code", F.md5("title_text").alias("title_md5"), F.md5("preview_text").alias("preview_md5"), F.col("start_index").cast("bigint").alias("start_index"), F.col("end_index").cast("bigint").alias("end_index"), "start_page_index", "end_page_index")


def q_block_scores(spark, sf):
    """Token overlap and author scores, which need no sequence ratio."""
    b = _blocks(spark, sf).join(_volume_references(spark, sf).withColumnsRenamed({"title": "rt", "authors": "ra"}), "paper_id")
    overlap = fuzzy.token_overlap(text.normalize_text(F.col("rt")), text.normalize_text(F.col("title_text")))
    return b.select("paper_id", F.col("block_no").cast("bigint").alias("block_no"), F.round(overlap, 6).alias("overlap"), F.round(fuzzy.score_authors(fuzzy.surnames(F.col("ra")), F.col("preview_text")), 6).alias("author_score"))


def _decided(spark, sf, config: Config = DEFAULT):
    lines = tables.once(proceedings.classify_early(proceedings.lines_of_pages(_volume_pages(spark, sf)), config))
    told = tables.once(proceedings.signals(lines, _volumes(spark, sf), config))
    numbered = proceedings.block_lines(lines.drop("is_author", "is_title").join(told.where("proceedings_detected").select("paper_id"), "paper_id", "left_semi"))  # only volumes are segmented
    refs = _volume_references(spark, sf)
    best = proceedings.best_match(proceedings.blocks(numbered, config), refs)
    return proceedings.decide(told, best, config), numbered, refs


def q_trim_decisions(spark, sf):
    decided, _, refs = _decided(spark, sf)
    return proceedings.decision_rows(decided, refs).drop("trimmed_at_utc")


def q_trimmed_pages(spark, sf):
    decided, numbered, _ = _decided(spark, sf)
    return proceedings.trimmed_pages(numbered, decided)


def q_title_scores(spark, sf):
    """Each document's text against one of the benchmark's, dealt by rank, as title and block title."""
    b = _t(spark, sf, "benchmark")
    n = b.count()
    ranked = b.select((F.row_number().over(Window.orderBy("item_id", "text")) - 1).alias("k"), F.col("text").alias("ref"))
    d = _docs(spark, sf).select("doc_id", "text", F.pmod("doc_id", F.lit(max(1, n))).alias("k"))
    return d.join(ranked, "k", "left").select("doc_id", F.round(fuzzy.score_title(F.coalesce("ref", F.lit("")), F.col("text")), 6).alias("title_score"))


def q_section_snippets(spark, sf):
    s = summaries.section_snippets(_extractions(spark, sf), list(SECTION_LABELS))
    return s.select("paper_id", "extraction_class", F.size("snippets").cast("bigint").alias("n"), F.md5(F.array_join("snippets", "|")).alias("snippets_md5"))


def q_section_summaries(spark, sf):
    e = _extractions(spark, sf)
    r = summaries.render(summaries.section_snippets(e, list(SECTION_LABELS)), e, SECTION_LABELS)
    return r.select("paper_id", F.md5("overall_summary").alias("overall_md5"), F.md5(F.col("section_summaries")["user"]).alias("user_md5"), F.col("section_summaries")["tool"].alias("tool_summary"))


def q_page_marked_text(spark, sf):
    return _records(spark, sf).select("paper_id", F.md5(text.page_marked_text(F.col("pages"))).alias("text_md5"))


def q_publication_type(spark, sf):
    return _docs(spark, sf).select("doc_id", values.resolve_type(F.col("text"), TYPES).alias("publication_type"))


def _raw_values(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.concat("event_type", F.lit(" :: "), "props")).when(F.col("event_id") % 4 == 1, F.concat("event_type", F.lit(" - 1 || "), "props")).when(F.col("event_id") % 4 == 2, F.concat(F.lit(" "), "event_type")).otherwise(F.col("props")).alias("raw"))


def q_parse_value(spark, sf):
    return _raw_values(spark, sf).select("event_id", values.parse_value(F.col("raw")).alias("value"))


INFERRED = ("binary_ordinal", "categorical", "integer", "integer_or_string_id", "string", "other")


def q_normalise_value(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 5 == 1, F.col("o_orderkey").cast("string")).when(F.col("o_orderkey") % 5 == 2, "not reported").when(F.col("o_orderkey") % 5 == 3, "").otherwise("High 0 risk").alias("raw"))
    accepted = F.array(F.lit("low"), F.lit("high"), F.lit("NA"))
    x = o.withColumn("inferred", F.explode(F.array(*[F.lit(i) for i in INFERRED])))
    v = values.normalise_value(F.col("raw"), F.col("inferred"), accepted)
    return x.select("o_orderkey", "inferred", v.alias("v")).select("o_orderkey", "inferred", F.col("v.s").alias("value_text"), F.col("v.i").alias("value_int"))


def q_default_values(spark, sf):
    n = _t(spark, sf, "nation").withColumn("inferred", F.explode(F.array(*[F.lit(i) for i in INFERRED])))
    accepted = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("x"), F.lit(" na "))).otherwise(F.array(F.lit("x")))
    return n.select("n_nationkey", "inferred", values.default_value(F.col("inferred"), accepted)["s"].alias("value"))


def _values(spark, sf):
    return assessment.structured_values(_papers(spark, sf), _extractions(spark, sf), _specs(spark))


def q_structured_record(spark, sf):
    return _values(spark, sf).select("paper_id", "field", F.md5(values.value_text(F.col("value"))).alias("value_md5"), F.col("value.i").isNotNull().alias("is_int"), F.size("evidence").cast("bigint").alias("n_evidence"), "missing")


def q_quality_records(spark, sf):
    return assessment.quality_records(_values(spark, sf)).select("paper_id", "publication_type", F.array_join("field_order", ",").alias("field_order"), F.array_join("missing_fields", ",").alias("missing_fields"), F.md5(F.array_join(F.transform("field_order", lambda f: F.col("values")[f]), "|")).alias("values_md5"))


def q_unmatched_extractions(spark, sf):
    return assessment.unmatched(_papers(spark, sf), _extractions(spark, sf), _specs(spark)).select("paper_id", "pos", "extraction_class")


def _part_specs(spark, sf):
    """A dictionary with a field for each part, by brand; sizes of 50 have a blank type, which the reader drops, and cells have blanks around them."""
    size, pad = F.col("p_size"), F.lit("  ")
    kinds = F.array(*[F.lit(i) for i in INFERRED])
    accepted = F.when(size % 4 == 0, "NA; none").when(size % 4 == 1, "poor;fair ; good;").when(size % 4 == 2, "").otherwise(" ; x; ")
    return tables.field_specs(_t(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.when(size != 50, F.concat(pad, "p_brand", pad)).otherwise(pad).alias("publication_type"), F.concat("p_name", F.lit(" "), "p_partkey", pad).alias("field"), F.col("p_type").alias("section"),
        F.when(size % 3 != 0, F.concat(F.lit("Is it "), "p_name", F.lit("?"))).alias("criterion_text"), F.concat(F.lit("Size "), size).alias("entry_guidance"), F.get(kinds, size % len(INFERRED)).alias("inferred_type"), accepted.alias("accepted"),
    ))


def q_field_dictionary(spark, sf):
    return _part_specs(spark, sf).withColumn("accepted", F.array_join("accepted", "|"))


def q_quality_prompt(spark, sf):
    return assessment.quality_prompts(_part_specs(spark, sf))


ORDER_SCHEMA = {
    "type": "object",
    "required": ["o_orderstatus"],
    "additionalProperties": False,
    "properties": {
        "o_orderkey": {"type": "integer"},
        "o_orderstatus": {"type": "string", "enum": ["F", "O"]},
        "o_totalprice": {"type": "number", "minimum": 1000, "maximum": 300000},
        "o_orderpriority": {"type": "string", "pattern": "^[1-3]-"},
        "o_custkey": {"anyOf": [{"type": "integer", "minimum": 0, "maximum": 100}, {"type": "integer", "minimum": 1000}]},
    },
}


def q_schema_errors(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("long").alias("o_totalprice"), "o_orderpriority", "o_custkey")
    e = validation.compile_schema(ORDER_SCHEMA, o.schema)
    return o.select("o_orderkey", F.size(e).cast("bigint").alias("n_errors"), validation.error_text(e).alias("error"))


ITEMS_SCHEMA = {
    "type": "object",
    "properties": {"items": {"type": "array", "items": {"type": "object", "required": ["n"], "properties": {"flag": {"enum": ["N", "R"]}, "quantity": {"type": "integer", "maximum": 45}}}}},
}


def q_nested_schema_errors(spark, sf):
    """Each order with its items as one JSON text."""
    item = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_returnflag").alias("flag"))
    items = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    texts = _t(spark, sf, "orders").select("o_orderkey").join(items, "o_orderkey", "left").select("o_orderkey", F.to_json(F.struct("o_orderkey", "items")).alias("j"))
    e = validation.nested_errors(texts, "j", ITEMS_SCHEMA)
    return e.select("o_orderkey", F.size("errors").cast("bigint").alias("n_errors"), F.md5(F.array_join("errors", "; ")).alias("errors_md5"))


def q_preferred_records(spark, sf):
    """Documents' records, and the first line alone of those with a good label, as if they had been trimmed."""
    r = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("_stem"), "text", F.col("n_chars").cast("int").alias("n_pages"))
    good = _t(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("_stem"))
    trimmed = r.join(good, "_stem").select("_stem", F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("text"), F.lit(None).cast("int").alias("n_pages"))
    return tables.prefer_trimmed(r, trimmed).select(F.col("_stem").alias("paper_id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "n_pages", "used_trimmed_text")


def q_ris_records(spark, sf):
    """A tagged bibliographic file of all documents, written and read again."""
    out = tables.scratch(spark, "ris")
    tag = lambda t, c: F.concat(F.lit(f"{t}  - "), c)
    record = F.concat_ws("\n", F.lit("TY  - JOUR"), tag("ID", F.col("doc_id").cast("string")), tag("TI", F.md5(F.coalesce("text", F.lit("")))), tag("AU", F.coalesce("lang", F.lit(""))), tag("AU", F.coalesce("source", F.lit(""))), F.lit("ER  - "))
    _docs(spark, sf).select(record.alias("value")).write.text(out)
    tags = tables.read_ris(spark, out).select("tags")
    return tags.select(F.col("tags")["ID"][0].alias("id"), F.col("tags")["TI"][0].alias("title"), F.array_join(F.col("tags")["AU"], "; ").alias("authors"))


def q_event_log(spark, sf):
    """Attempts appended in two runs, failed ones first; the latest of each id by time."""
    out = tables.scratch(spark, "log")
    e = _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("status"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("finished_at"), "event_id")
    for part in (F.col("status") == "error", F.col("status") != "error"):
        sinks.append_events(e.where(part), out)
    return manifest_stream.latest(spark.read.schema(e.schema).json(out), "id", ["finished_at", "event_id"])


def q_registry_csv(spark, sf):
    """All documents through the registry's CSV form: texts with quotes, commas, line breaks and blanks."""
    out = tables.scratch(spark, "registry")
    d = _docs(spark, sf).select(F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").cast("string").alias("paper_id"), F.coalesce("text", F.lit("")).alias("text"))
    sinks.write_registry(d, out, ["paper_id", "text", "source"])
    back = tables.keyed_csv(spark, out, "paper_id")
    return back.select("paper_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.coalesce("source", F.lit("")).alias("source"))


def q_detected_types(spark, sf):
    """Each document's type: from what its conversation's assistant turns name, else from its whole text, else an error."""
    named = F.get(F.array(*[F.lit(t) for t in [*TYPES, "something else", ""]]), ((F.col("conv_id") * 3 + F.col("turn")) % 7).cast("int"))
    found = _t(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("paper_id"), F.col("turn").alias("pos"), F.when(F.col("role") == "assistant", "publication_type").otherwise("note").alias("extraction_class"), named.alias("extraction_text"))
    texts = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("paper_id"), F.coalesce("text", F.lit("")).alias("text"))
    return assessment.detect_type(found, texts, TYPES).select("paper_id", "publication_type", "method", F.col("error").isNotNull().alias("failed"))


def q_content_hash(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def q_run_status(spark, sf):
    docs = _docs(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("paper_id"), "text")
    done = _t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("paper_id"))
    return sinks.status_counts(assessment.input_status(docs, done))


def q_pending_documents(spark, sf):
    docs = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("paper_id"))
    lab = _t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("paper_id"), "quality", "toxic")
    return sinks.pending(docs, lab.where("quality = 1"), lab.where("toxic = 0"))


#: Words that end a sentence: a find that no span cuts.
WORD_RULE = extraction.RuleExtractor((("ending", r"(?<!\S)[A-Z][a-z]+\.(?!\S)"),))


def q_chunked_extraction(spark, sf):
    """Words that end a sentence, found span by span, with their offsets in the page-marked text."""
    r = extraction.extract(_records(spark, sf), WORD_RULE, "")
    chars = F.aggregate("extractions", F.lit(0).cast("bigint"), lambda a, e: a + e["char_end"] - e["char_start"])
    return r.select("paper_id", "status", F.size("extractions").cast("bigint").alias("n"), chars.alias("n_chars"), F.md5(F.array_join(F.transform("extractions", lambda e: e["extraction_text"]), " ")).alias("found_md5"))


def q_replaced_records(spark, sf):
    """A folder of all documents' records, after a second run over the labelled ones: good ones are replaced, the others vanish."""
    out = tables.scratch(spark, "records")
    docs = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("paper_id"), "text", F.lit(None).cast("int").alias("toxic"))
    sinks.replace_records(docs, out, ids=docs, buckets=16)
    labels = _t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("paper_id"), "quality", F.col("toxic").cast("int").alias("toxic"))
    again = docs.drop("toxic").join(labels.where("quality = 1").drop("quality"), "paper_id")
    sinks.replace_records(again, out, ids=labels, vanish=True)
    found = tables.json_records(spark, out, "paper_id string, text string, toxic int")
    return found.select("paper_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "toxic")


def q_cascade_match(spark, sf):
    p = _t(spark, sf, "part")
    a = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("d"), "p_partkey")).otherwise("").alias("doi"), F.concat("p_name", F.lit(" "), "p_partkey").alias("title"))
    known = F.col("p_partkey") % 3 != 0
    b = p.select((F.col("p_partkey") + 1000000).alias("id"), F.when(known & (F.col("p_partkey") % 4 == 0), F.concat(F.lit(" D"), "p_partkey")).otherwise("").alias("doi"), F.when(known, F.concat(F.upper("p_name"), F.lit(", "), "p_partkey")).otherwise("").alias("title"))
    return registry.cascade_match(a, b)


def q_input_selection(spark, sf):
    d = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("_stem"), "n_chars")
    return tables.select_inputs(d, limit=25)


def q_filename_sanitize(spark, sf):
    return _t(spark, sf, "pages").select("page_id", acquisition.sanitize_filename(F.col("url")).alias("filename"))


def q_page_links(spark, sf):
    return acquisition.links(_t(spark, sf, "pages"), "page_id", "url", "html")


def q_reference_cards(spark, sf):
    c = _docs(spark, sf).select("doc_id", F.concat(F.lit("# "), F.col("doc_id") % 700 + 10, F.lit("\n2024\n"), F.col("text")).alias("card"))
    return acquisition.cards(c, "doc_id", "card").select("covidence_id", F.md5("label").alias("label_md5"))


def q_few_shot_examples(spark, sf):
    e = assessment.few_shot_examples(_part_specs(spark, sf))
    return e.select("publication_type", F.col("extractions")[0]["extraction_class"].alias("first_field"), F.col("extractions")[1]["extraction_class"].alias("second_field"))


def q_html_text(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.md5(tables.html_text(F.col("html"))).alias("text_md5"))


def q_id_order(spark, sf):
    e = _t(spark, sf, "events").select(F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("u"), "user_id")).otherwise(F.col("user_id").cast("string")).alias("id")).distinct()
    return e.orderBy(*registry.id_order(F.col("id")))


def entry_query(spark, sf):
    """Signals of each volume, with thresholds that suit small tables."""
    small = replace(DEFAULT, thresholds=replace(DEFAULT.thresholds, large_pages=10))
    return q_proceedings_signals(spark, sf, small)


def queries():
    return {k[2:]: v for k, v in globals().items() if k.startswith("q_")}


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"


def _markers(x: str, values_: tuple[str, ...], how: str) -> str:
    return "(" + how.join(f"contains({x}, '{m}')" + ("::int" if how == " + " else "") for m in values_) + ")"


_VOLUME = f"""v as (select (doc_id // {VOLUME_PAGES})::varchar as paper_id, (doc_id % {VOLUME_PAGES})::int as page_index, printf('%03d. ', doc_id % 1000) || coalesce(text, '') as text from documents)"""
_LINES = _VOLUME + r""", l0 as (select paper_id, page_index, i::int as line_index, trim(regexp_replace(l[i + 1], '\s+', ' ', 'g')) as text
  from (select paper_id, page_index, string_split(text, chr(10)) as l, unnest(range(len(string_split(text, chr(10))))) as i from v)), l as (select * from l0 where text <> '')"""
_START = r"^((?:[A-Z]{1,3}-)?(?:[A-Z]{1,2})?\d{2,3})\.\s+(.+)$"
_CLASSES = (
    _LINES
    + f""", n as (select *, {_norm('text')} as nt, len(text) - len(replace(text, ',', '')) as commas from l),
c0 as (select *, regexp_matches(text, '{_START}') as is_start,
  regexp_matches(text, '(?i)(^|[^\\pL\\pN_])(MD|DO|PHD|MSC|MS|BS|BA|MBA|MBBS|MPH|RN|FRCPC|FAAN|FRCP|DPhil)($|[^\\pL\\pN_])')
  or regexp_matches(text, '(?i)(^|[^\\pL\\pN_])(M\\.D\\.|D\\.O\\.|PH\\.D\\.|M\\.S\\.|B\\.S\\.|B\\.A\\.)[\\pL\\pN_]') or commas >= 3 or (contains(text, ';') and commas >= 1) as is_author,
  {_markers('nt', DEFAULT.institution_markers, ' or ')} as is_institution, {_markers('nt', DEFAULT.footer_markers, ' or ')} as is_footer,
  string_split(text, ' ') as w from n),
c as (select *, not (is_start or is_author or is_institution or is_footer) and len(w) between 4 and 24
  and len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]'))) >= greatest(3, len(w) - 2) as is_title from c0)"""
)
_BLOCKS = (
    _CLASSES
    + f""", b0 as (select *, sum(is_start::int) over w1 as block_no, row_number() over w1 - 1 as idx from c window w1 as (partition by paper_id order by page_index, line_index)),
b1 as (select *, row_number() over (partition by paper_id, block_no order by idx) as rn from b0 where block_no > 0),
b2 as (select *, max((rn > 1 and (is_start or is_author or is_institution or is_footer))::int) over (partition by paper_id, block_no order by idx) as stopped,
  case when rn = 1 then trim(regexp_extract(text, '{_START}', 2)) else text end as own from b1),
blocks as (select paper_id, block_no::bigint as block_no, max(case when rn = 1 then regexp_extract(text, '{_START}', 1) end) as code,
  coalesce(string_agg(own, ' ' order by rn) filter (rn <= 5 and stopped = 0 and own <> ''), '') as title_text,
  coalesce(string_agg(text, ' ' order by rn) filter (rn <= 12 and not is_footer), '') as preview_text,
  min(idx)::bigint as start_index, (max(idx) + 1)::bigint as end_index, min_by(page_index, idx) as start_page_index, max_by(page_index, idx) as end_page_index
  from b2 group by all)"""
)
_PART_SPECS = """specs as (select p_partkey as ord, p_brand as publication_type, p_name || ' ' || p_partkey as field, p_type as section, case when p_size % 3 <> 0 then 'Is it ' || p_name || '?' else '' end as criterion,
  'Size ' || p_size as guidance, ['binary_ordinal', 'categorical', 'integer', 'integer_or_string_id', 'string', 'other'][p_size % 6 + 1] as inferred,
  case p_size % 4 when 0 then ['NA', 'none'] when 1 then ['poor', 'fair', 'good'] when 2 then [] else ['x'] end as accepted from part where p_size <> 50)"""
_EXTRACTIONS = """e0 as (select conv_id::varchar as paper_id, turn as pos, role as cls, trim(text) as txt from conversations),
e as (select paper_id, cls, txt, min(pos) as pos from e0 where txt <> '' group by all),
s as (select paper_id, cls, list(txt order by pos) as snippets from e group by all)"""
_SPECS = (
    "specs as (select * from (values "
    + ", ".join(f"({i}, '{t}', '{f}', '{c}', '{g}', '{k}', {[x.strip() for x in a.split(';') if x.strip()] or '[]::varchar[]'})" for i, (t, f, _, c, g, k, a) in enumerate(SPECS))
    + ") as t(ord, publication_type, field, criterion, guidance, inferred, accepted))"
)


def _parse(x: str) -> str:
    r = f"trim({x})"
    cases = " ".join(f"when contains({r}, '{s}') then trim(string_split({r}, '{s}')[1])" for s in ("::", "||", " - ", " -- "))
    return f"case {cases} else {r} end"


def _hint(x: str) -> str:
    return _markers(f"lower({x})", ("na", "not available", "not applicable", "not reported", "unknown", "unclear"), " or ")


def _na(a: str) -> str:
    return f"len(list_filter({a}, lambda x: upper(trim(x)) = 'NA')) > 0"


def _value_text(raw: str, kind: str, acc: str) -> str:
    """SQL of the coerced value where it is text; null where it is an integer."""
    return rf"""case {kind}
  when 'binary_ordinal' then case when regexp_matches({raw}, '\b1\b') then '1' when regexp_matches({raw}, '\b0\b') then '0' when {_hint(raw)} or {raw} = '' then 'NA' else {raw} end
  when 'categorical' then coalesce(list_filter({acc}, lambda x: lower(x) = lower({raw}))[1], list_filter({acc}, lambda x: x <> '' and contains(lower({raw}), lower(x)))[1],
    case when {_hint(raw)} then coalesce(list_filter({acc}, lambda x: upper(x) = 'NA')[1], 'NA') end, {raw})
  when 'integer' then case when {_hint(raw)} then 'NA' when regexp_matches({raw}, '-?\d+') then null else {raw} end
  when 'integer_or_string_id' then case when regexp_full_match({raw}, '-?\d+') then null else {raw} end
  when 'string' then case when {raw} = '' and {_na(acc)} then 'NA' else {raw} end
  else {raw} end"""


def _value_int(raw: str, kind: str) -> str:
    return rf"""case when {kind} = 'integer' and not {_hint(raw)} and regexp_matches({raw}, '-?\d+') then regexp_extract({raw}, '-?\d+')::bigint
  when {kind} = 'integer_or_string_id' and regexp_full_match({raw}, '-?\d+') then {raw}::bigint end"""


def _default(kind: str, acc: str) -> str:
    return f"case when {kind} in ('binary_ordinal', 'integer') or {_na(acc)} then 'NA' else '' end"


_VALUES = f"""{_EXTRACTIONS}, {_SPECS},
p as (select distinct conv_id::varchar as paper_id, case when conv_id % 2 = 0 then 'even' else 'odd' end as publication_type from conversations),
j as (select p.paper_id, p.publication_type, specs.field, specs.ord, specs.inferred, specs.accepted, s.snippets, {_parse('s.snippets[1]')} as raw
  from p join specs using (publication_type) left join s on s.paper_id = p.paper_id and s.cls = specs.field),
vals as (select *, case when snippets is null then {_default('inferred', 'accepted')} else {_value_text('raw', 'inferred', 'accepted')} end as vt,
  case when snippets is not null then {_value_int('raw', 'inferred')} end as vi from j)"""
_ANCHOR = r"""'(?is)<a\b[^>]*?href\s*=\s*["'']?([^"''\s>]*)[^>]*>(.*?)</a>'"""
_RAW_EVENT = "case event_id % 4 when 0 then event_type || ' :: ' || props when 1 then event_type || ' - 1 || ' || props when 2 then ' ' || event_type else props end"
_PAGES_SQL = "d as (select doc_id::varchar as paper_id, string_split(coalesce(text, ''), chr(10)) as l from documents)"


def oracle_sql():
    low = "len(list_filter(l, lambda x: len(x) < 50)) / len(l) > 0.5"
    ctl = r"len(regexp_extract_all(array_to_string(l, chr(10)), '[\x00-\x08\x0B\x0C\x0E-\x1F]'))"
    total = "list_sum(list_transform(l, lambda x: len(x)))"
    dirty = f"({ctl} >= 10 or ({ctl} > 0 and {total} > 0 and {ctl} / {total} > 0.002))"
    types = [t.lower() for t in TYPES]
    cand = "lower(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'))"
    sql_type = "case " + " ".join([f"when {cand} = '' then null"] + [f"when {cand} = '{t}' then '{T}'" for t, T in zip(types, TYPES, strict=True)] + [f"when contains({cand}, '{t}') or contains('{t}', {cand}) then '{T}'" for t, T in zip(types, TYPES, strict=True)])
    sql_type += " " + " ".join(f"when contains({cand}, '{k}') then '{t}'" for k, t in values.PUBLICATION_ALIASES) + " end"
    return {
        "normalize_text": f"select doc_id, {_norm('text')} as norm from documents",
        "token_sets": f"select doc_id, len(t)::int as n_tokens, array_to_string(t, ' ') as tokens from (select doc_id, list_sort(list_distinct(list_filter(string_split({_norm('text')}, ' '), lambda x: len(x) >= 3))) as t from documents)",
        "control_char_count": r"select doc_id, len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]'))::bigint as n from documents",
        "text_quality_flags": f"""with {_PAGES_SQL}, f as (select paper_id, {low} as lo, {dirty} as di from d)
            select paper_id, concat_ws(',', case when lo then 'low_text' end, case when di then 'control_chars' end) as flags, lo or di as needs_ocr_before_ocr,
              case when di then 'force-ocr' when lo then 'skip-text' else '' end as ocr_mode from f""",
        "latest_manifest": "select user_id, event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as finished_at from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1",
        "reference_last_wins": "select conv_id::varchar as conv_id, turn, role, md5(text) as text_md5 from (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations) where rn = 1",
        "artifact_registry": r"""
with ref as (select item_id::varchar as id, text as title from benchmark),
man as (select user_id::varchar as id, max_by(event_type, (ts, event_id)) as status from events group by user_id),
pdf as (select page_id::varchar as id from pages), txt as (select doc_id::varchar as id, len(string_split(text, chr(10))) as n, n_chars < 50 as ocr from documents),
raw as (select conv_id::varchar as id, count(*) as n from conversations group by conv_id),
qr as (select doc_id::varchar as id from labels where quality = 1), qd as (select doc_id::varchar as id, case when toxic = 1 then 2 else 0 end as n from labels),
ids as (select id from ref union select id from man union select id from pdf union select id from txt union select id from raw union select id from qr union select id from qd)
select i.id as paper_id, case when ref.id is null then 'orphan_artifact' else 'matched_reference' end as reference_match_status, coalesce(regexp_replace(ref.title, '^\s+|\s+$', '', 'g'), '') as title,
  case when pdf.id is null then '0' else '1' end as pdf_file_count, coalesce(pdf.id || '_a.pdf', '') as pdf_filenames, coalesce('pages/' || pdf.id || '_a.pdf', '') as pdf_paths_relative,
  case when pdf.id is not null then 'downloaded' else coalesce(nullif(trim(man.status), ''), 'missing') end as download_status,
  coalesce('text/' || txt.id || '.json', '') as text_json_path, coalesce(txt.n::varchar, '') as text_n_pages, case when txt.ocr then 'True' else '' end as text_needs_ocr,
  coalesce(raw.n::varchar, '') as langextract_total_extraction_count, case when qr.id is null then '' else 'm1' end as quality_model_id, coalesce(qd.n, 0)::varchar as quality_missing_field_count,
  concat_ws('; ', case when ref.id is not null then 'reference' end, case when pdf.id is not null then 'pdf' end, case when txt.id is not null then 'text' end,
    case when raw.id is not null then 'langextract' end, case when qr.id is not null then 'quality_raw' end, case when qd.id is not null then 'quality_record' end) as artifact_types_present
from ids i left join ref using (id) left join man using (id) left join pdf using (id) left join txt using (id) left join raw using (id) left join qr using (id) left join qd using (id)""",
        "source_registry": r"""
with r as (select (item_id - item_id % 2)::varchar as cid, text, item_id, row_number() over (partition by item_id - item_id % 2 order by item_id) as rn from benchmark),
f as (select case when page_id % 7 = 3 then '/data/x' || page_id || '_p.pdf' else '/data/' || (page_id - page_id % 3) || '_p' || page_id || '.pdf' end as path, case when page_id % 7 = 3 then '' else (page_id - page_id % 3)::varchar end as fid from pages),
g as (select fid, list(path order by path) as paths from f where fid <> '' group by fid),
m as (select user_id::varchar as mid, max_by(event_type, (ts, event_id)) as status from events group by user_id),
a as (select cid, text, case when rn = 1 then coalesce(paths, []) else [] end as paths, coalesce(m.status, '') as ms from r left join g on fid = cid left join m on mid = cid)
select cid as covidence_id, md5(trim(text)) as title_md5, array_to_string(list_transform(paths, lambda x: substr(x, 7)), ' | ') as pdf_filename, array_to_string(list_transform(paths, lambda x: substr(x, 7)), ' | ') as pdf_path_relative,
  len(paths)::varchar as local_file_count, case when len(paths) = 1 then 'downloaded' when len(paths) > 1 then 'multiple_local_files' when ms <> '' then ms else 'missing' end as download_status, ms as manifest_status from a
union all
select fid, md5(''), substr(path, 7), substr(path, 7), '1', 'unmatched_local_file', '' from f where fid = '' or fid not in (select cid from r)""",
        "screen_documents": rf"""
with d as (select doc_id::varchar as paper_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as l from documents),
x as (select d.*, list_transform(l, lambda p: {_norm('p')}) as np, coalesce(regexp_replace(b.text, '^\s+|\s+$', '', 'g'), '') as title, b.item_id is not null as has, len(l) as n from d left join benchmark b on b.item_id::varchar = d.paper_id),
y as (select *, {_norm('title')} as nt, array_to_string(np, ' ') as full_text, array_to_string(np[1:5], ' ') as first5, array_to_string(np[1:2], ' ') as first2,
  len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) as ctl from x),
z as (select *, case when nt = '' then -1 else coalesce(list_position(list_transform(np, lambda p: contains(p, nt)), true), 0) - 1 end as page, list_filter(string_split(nt, ' '), lambda w: len(w) >= 5)[1:8] as lw,
  {_markers("(' ' || case when has then 'annual meeting' else '' end || ' ' || first5)", DEFAULT.screen_markers, ' + ')} as prog from y)
select paper_id, paper_id as covidence_id, title, '' as source_filename, n::varchar as n_pages, list_sum(list_transform(l, lambda p: len(p)))::bigint::varchar as total_chars,
  case when page >= 0 then 'true' else 'false' end as title_exact_match, case when page >= 0 then page::varchar else '' end as title_first_page,
  case when len(lw) > 0 then len(list_filter(lw, lambda w: contains(full_text, w))) || '/' || len(lw) else '' end as title_word_hits, prog::varchar as program_marker_count, '0' as abstract_code_marker_count,
  case when {_markers('first2', DEFAULT.chrome_markers, ' or ')} then 'true' else 'false' end as website_chrome_detected, ctl::varchar as suspicious_control_char_count,
  case when n >= 40 and page >= 5 and prog > 0 then 'manual_trim_recommended' when ctl >= 5 then 'review_text_quality' else 'ok' end as screen_status,
  case when n >= 40 and page >= 5 and prog > 0 then 'trim_to_target_pages' when ctl >= 5 then 'inspect_text_extraction' else '' end as manual_action,
  case when n >= 40 and page >= 5 and prog > 0 then 'Large multi-abstract/program PDF; target title appears on page ' || page || ' with 0 abstract-code markers.'
    when ctl >= 5 then 'Text contains ' || ctl || ' suspicious control characters; review text quality.' else '' end as screen_reason from z""",
        "flatten_lines": f"with {_LINES} select paper_id, page_index, line_index, md5(text) as text_md5 from l",
        "line_classes": f"with {_CLASSES} select paper_id, page_index, line_index, is_start, is_author, is_institution, is_footer, is_title from c",
        "proceedings_signals": f"""with {_CLASSES},
k as (select paper_id, count(*) filter (is_start and page_index < 40) as a, count(*) filter (is_title and page_index < 40) as t, count(*) filter (is_author and page_index < 40) as u,
  {_norm("coalesce(string_agg(text, ' ' order by page_index, line_index) filter (page_index < 5), '')")} as first from c group by paper_id),
g as (select paper_id, count(*)::int as n_pages from v group by paper_id),
h as (select g.paper_id, g.n_pages, coalesce(a, 0) as a, coalesce(t, 0) as t, coalesce(u, 0) as u, {_markers("coalesce(first, '')", DEFAULT.trim_markers, ' + ')} as m from g left join k using (paper_id))
select paper_id, n_pages, a as abstract_block_count, t as title_like_line_count, u as author_like_line_count, m as program_marker_count,
  n_pages >= 40 and (a >= 8 or (t >= 20 and u >= 10) or m > 0) as proceedings_detected from h""",
        "abstract_blocks": f"with {_BLOCKS} select paper_id, block_no, code, md5(title_text) as title_md5, md5(preview_text) as preview_md5, start_index, end_index, start_page_index, end_page_index from blocks",
        "block_scores": rf"""with {_BLOCKS},
rf0 as (select doc_id // {VOLUME_PAGES} as vol, string_split(max_by(text, doc_id), chr(10))[1] as title, string_split_regex(max_by(text, doc_id), '[ \n]+') as w from documents group by 1),
rf as (select vol::varchar as paper_id, {_norm('title')} as ref, list_distinct(list_filter([{_norm("coalesce(w[1], '')")}, {_norm("coalesce(w[2], '')")}], lambda x: x <> '')) as names from rf0),
m as (select b.paper_id, b.block_no, ref, names, {_norm('title_text')} as own, {_norm('preview_text')} as prev from blocks b join rf using (paper_id)),
o as (select *, list_distinct(list_filter(string_split(ref, ' '), lambda x: len(x) >= 4)) as rt, list_distinct(list_filter(string_split(own, ' '), lambda x: len(x) >= 4)) as ot, list_filter(string_split(prev, ' '), lambda x: len(x) >= 3) as pt from m)
select paper_id, block_no, round(case when contains(own, ref) or contains(ref, own) then greatest(len(list_intersect(rt, ot)) / greatest(1, len(rt)), 0.95) else len(list_intersect(rt, ot)) / greatest(1, len(rt)) end, 6) as overlap,
  round(case when len(names) > 0 then len(list_filter(names, lambda s: contains(prev, s) or (len(list_filter(string_split(s, ' '), lambda t: len(t) >= 3)) > 0 and list_has_all(pt, list_filter(string_split(s, ' '), lambda t: len(t) >= 3))))) / len(names) else 0.0 end, 6) as author_score from o""",
        "section_snippets": f"with {_EXTRACTIONS} select paper_id, cls as extraction_class, len(snippets)::bigint as n, md5(array_to_string(snippets, '|')) as snippets_md5 from s where cls in ('system', 'user', 'assistant', 'tool')",
        "section_summaries": f"""with {_EXTRACTIONS}, p as (select distinct paper_id from e0), r as (select paper_id, cls, array_to_string(snippets[1:3], ' ') as t from s),
q as (select p.paper_id, """ + ", ".join(f"coalesce((select t from r where r.paper_id = p.paper_id and cls = '{k}'), 'Not stated.') as {k}_s" for k in SECTION_LABELS) + """ from p)
select paper_id, md5(""" + " || ' ' || ".join(f"'{v}: ' || {k}_s" for k, v in SECTION_LABELS.items()) + """) as overall_md5, md5(user_s) as user_md5, tool_s as tool_summary from q""",
        "page_marked_text": rf"with {_PAGES_SQL}, x as (select paper_id, l, unnest(range(len(l))) as i from d), y as (select paper_id, i, trim(regexp_replace(l[i + 1], '^\s+|\s+$', '', 'g')) as t from x) select paper_id, md5(coalesce(string_agg('[Page ' || (i + 1) || ']' || chr(10) || t, chr(10) || chr(10) order by i) filter (t <> ''), '')) as text_md5 from y group by paper_id",
        "publication_type": f"select doc_id, {sql_type} as publication_type from documents",
        "parse_value": f"select event_id, {_parse('raw')} as value from (select event_id, {_RAW_EVENT} as raw from events)",
        "normalise_value": f"""with o as (select o_orderkey, trim(case o_orderkey % 5 when 0 then o_orderpriority when 1 then o_orderkey::varchar when 2 then 'not reported' when 3 then '' else 'High 0 risk' end) as raw from orders),
x as (select o_orderkey, raw, unnest({list(INFERRED)}) as inferred, ['low', 'high', 'NA'] as acc from o) select o_orderkey, inferred, {_value_text('raw', 'inferred', 'acc')} as value_text, {_value_int('raw', 'inferred')} as value_int from x""",
        "default_values": f"with x as (select n_nationkey, unnest({list(INFERRED)}) as inferred, case when n_nationkey % 2 = 0 then ['x', ' na '] else ['x'] end as acc from nation) select n_nationkey, inferred, {_default('inferred', 'acc')} as value from x",
        "structured_record": f"with {_VALUES} select paper_id, field, md5(coalesce(vi::varchar, vt)) as value_md5, vi is not null as is_int, least(3, coalesce(len(snippets), 0))::bigint as n_evidence, snippets is null as missing from vals",
        "quality_records": f"with {_VALUES} select paper_id, publication_type, string_agg(field, ',' order by ord) as field_order, coalesce(string_agg(field, ',' order by ord) filter (snippets is null), '') as missing_fields, md5(string_agg(coalesce(vi::varchar, vt), '|' order by ord)) as values_md5 from vals group by all",
        "unmatched_extractions": f"with {_SPECS} select conv_id::varchar as paper_id, turn as pos, role as extraction_class from conversations c where not exists (select 1 from specs where publication_type = case when conv_id % 2 = 0 then 'even' else 'odd' end and field = c.role)",
        "quality_prompt": f"""with {_PART_SPECS}, b as (select publication_type, string_agg('- ' || field || ' | type: ' || inferred || ' | accepted: ' || case when len(accepted) > 0 then array_to_string(accepted, ', ') else 'as reported' end || ' | criterion: ' || case when criterion <> '' then criterion else guidance end, chr(10) order by ord) as f from specs group by publication_type)
            select publication_type, replace(replace('{assessment.QUALITY_PROMPT.replace("'", "''")}', '{{publication_type}}', publication_type), '{{field_block}}', f) as prompt from b""",
        "schema_errors": r"""with o as (select o_orderkey, o_orderstatus, trunc(o_totalprice)::bigint as p, o_orderpriority as pr, o_custkey as c from orders),
e as (select o_orderkey, list_filter([case when o_orderstatus not in ('F', 'O') then '$.o_orderstatus: value ''' || o_orderstatus || ''' not in enum [''F'', ''O'']' end,
  case when p < 1000 then '$.o_totalprice: value ' || p || ' < minimum 1000' end, case when p > 300000 then '$.o_totalprice: value ' || p || ' > maximum 300000' end,
  case when not regexp_matches(pr, '^[1-3]-') then '$.o_orderpriority: value ''' || pr || ''' does not match pattern ^[1-3]-' end,
  case when c > 100 and c < 1000 then '$.o_custkey: value ' || c || ' does not match anyOf options' end], lambda x: x is not null) as e from o)
select o_orderkey, len(e)::bigint as n_errors, case when len(e) > 0 then 'Schema validation failed: ' || array_to_string(e, '; ') end as error from e""",
        "content_hash": "select doc_id, sha256(text) as sha256 from documents",
        "run_status": "select status, count(*) as n from (select case when l.doc_id is not null then 'skipped' when trim(coalesce(d.text, '')) = '' then 'failed' else 'run' end as status from documents d left join (select distinct doc_id from labels) l using (doc_id)) group by status",
        "field_dictionary": f"with {_PART_SPECS} select ord, publication_type, field, section, criterion as criterion_text, guidance as entry_guidance, inferred as inferred_type, array_to_string(accepted, '|') as accepted from specs",
        "nested_schema_errors": """with i as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_returnflag) - 1 as i, l_quantity::bigint as q, l_returnflag as f from lineitem),
e as (select l_orderkey, i, 1 as k, '$.items[' || i || '].quantity: value ' || q || ' > maximum 45' as m from i where q > 45
  union all select l_orderkey, i, 2, '$.items[' || i || '].flag: value ''' || f || ''' not in enum [''N'', ''R'']' from i where f not in ('N', 'R'))
select o_orderkey, count(m) as n_errors, md5(coalesce(string_agg(m, '; ' order by i, k), '')) as errors_md5 from orders left join e on l_orderkey = o_orderkey group by o_orderkey""",
        "preferred_records": """select d.doc_id::varchar as paper_id, md5(case when l.doc_id is not null then string_split(coalesce(text, ''), chr(10))[1] else coalesce(text, '') end) as text_md5, case when l.doc_id is null then n_chars::int end as n_pages, l.doc_id is not null as used_trimmed_text
  from documents d left join (select doc_id from labels where quality = 1) l using (doc_id)""",
        "ris_records": "select doc_id::varchar as id, md5(coalesce(text, '')) as title, coalesce(lang, '') || '; ' || coalesce(source, '') as authors from documents",
        "event_log": "select user_id::varchar as id, arg_max(event_type, (ts, event_id)) as status, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as finished_at, arg_max(event_id, (ts, event_id)) as event_id from events group by user_id",
        "registry_csv": "select doc_id::varchar as paper_id, md5(coalesce(text, '')) as text_md5, coalesce(source, '') as source from documents",
        "detected_types": f"""with n as (select conv_id, turn, {[*TYPES, "something else", ""]}[(conv_id * 3 + turn) % 7 + 1] as text from conversations where role = 'assistant'),
h as (select conv_id, arg_min(t, turn) as t from (select conv_id, turn, {sql_type} as t from n) where t is not null group by conv_id),
d as (select doc_id, {sql_type} as own from (select doc_id, coalesce(text, '') as text from documents))
select doc_id::varchar as paper_id, coalesce(h.t, own) as publication_type, 'auto_detected' as method, coalesce(h.t, own) is null as failed from d left join h on h.conv_id = d.doc_id""",
        "chunked_extraction": r"""select paper_id, case when blank then 'failed' else 'processed' end as status, len(e)::bigint as n, coalesce(list_sum(list_transform(e, lambda x: length(x))), 0)::bigint as n_chars, md5(array_to_string(e, ' ')) as found_md5
  from (select doc_id::varchar as paper_id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' as blank,
    list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: regexp_full_match(x, '[A-Z][a-z]+[.]')) as e from documents)""",
        "replaced_records": """select d.doc_id::varchar as paper_id, md5(coalesce(d.text, '')) as text_md5, l.toxic::int as toxic from documents d left join labels l using (doc_id) where l.quality is distinct from 0""",
        "pending_documents": "select doc_id::varchar as paper_id from documents where doc_id not in (select a.doc_id from labels a where quality = 1 intersect select doc_id from labels where toxic = 0)",
        "cascade_match": rf"""with a as (select p_partkey as id, case when p_partkey % 2 = 0 then 'd' || p_partkey else '' end as doi, {_norm("p_name || ' ' || p_partkey")} as t from part),
b as (select p_partkey + 1000000 as id, case when p_partkey % 4 = 0 and p_partkey % 3 <> 0 then 'd' || p_partkey else '' end as doi, case when p_partkey % 3 <> 0 then {_norm("p_name || ' ' || p_partkey")} else '' end as t from part),
d as (select a.id as left_id, min(b.id) as right_id from a join b on a.doi = b.doi and a.doi <> '' group by a.id),
e as (select a.id as left_id, min(b.id) as right_id from a join b on a.t = b.t and a.t <> '' where a.id not in (select left_id from d) group by a.id)
select *, 'doi' as match_method from d union all select *, 'title' from e""",
        "input_selection": "select doc_id::varchar as _stem, n_chars from documents order by doc_id::varchar limit 25",
        "filename_sanitize": r"""select page_id, case when lower(f) like '%.pdf' then f else f || '.pdf' end as filename from (select page_id, regexp_replace(trim(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g')), '\.+$', '') as f from pages)""",
        "html_text": r"""select page_id, md5(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')) as text_md5 from pages""",
        "page_links": rf"""
with f as (select page_id as id, url as page, regexp_extract_all(html, {_ANCHOR}, 1) as h, regexp_extract_all(html, {_ANCHOR}, 2) as t from pages),
a as (select id, page, i::int as pos, h[i + 1] as href, regexp_replace(regexp_replace(t[i + 1], '<[^>]*>', '', 'g'), '^[\s\pZ]+|[\s\pZ]+$', '', 'g') as text from (select *, unnest(range(len(h))) as i from f)),
u as (select *, regexp_extract(page, '^([a-zA-Z][\w+.-]*://[^/?#]*)', 1) as host, regexp_extract(regexp_replace(page, '[?#].*$', ''), '^([a-zA-Z][\w+.-]*://.*/)', 1) as folder from a),
x as (select id, pos, text, href, case when href = '' then page when regexp_matches(href, '^[a-zA-Z][\w+.-]*:') then href when starts_with(href, '//') then regexp_extract(page, '^([a-zA-Z][\w+.-]*:)', 1) || href
  when starts_with(href, '/') then host || href when folder = '' then host || '/' || href else folder || href end as url from u),
n as (select *, case when regexp_matches(text, '(?i)\.pdf\b') then text else url_decode(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][\w+.-]*://[^/]*', ''), '/')[-1]) end as raw from x),
k as (select *, regexp_replace(trim(regexp_replace(raw, '[<>:"/\\|?*]', '_', 'g')), '\.+$', '') as clean from n)
select id, pos, text, href, url, case when lower(clean) like '%.pdf' then clean else clean || '.pdf' end as filename, regexp_matches(text, '(?i)\.pdf\b') or regexp_matches(href, '(?i)(\.pdf\b|application%2fpdf)') as is_pdf from k""",
        "reference_cards": r"""with c as (select doc_id, (doc_id % 700 + 10)::varchar as cid, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '' and not regexp_matches(x, '(?i)^#\s*\d+|^view full text$|\.pdf$|^\d{4}$')) as l from documents)
select cid as covidence_id, md5(min_by(coalesce(substr(l[1], 1, 240), ''), doc_id)) as label_md5 from c group by cid""",
        "few_shot_examples": f"""with {_PART_SPECS}, f as (select publication_type, min_by(field, ord) filter (inferred = 'binary_ordinal') as b, min_by(field, ord) filter (inferred = 'categorical') as c, min_by(field, ord) filter (inferred = 'string') as s from specs group by publication_type)
            select publication_type, b as first_field, c as second_field from f where b is not null and c is not null union all select publication_type, b, s from f where b is not null and s is not null""",
        "id_order": "select distinct case when user_id % 3 = 0 then 'u' || user_id else user_id::varchar end as id from events",
    }
