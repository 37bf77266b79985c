"""Screening of text records for multi-document volumes and bad text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.config import ABSTRACT_CODE, DEFAULT, SCREEN_TEXT_REASON, SCREEN_VOLUME_REASON, Config
from leafmill.functions.text import any_marker, bool_text, control_char_count, count_markers, falsy_text, normalize_text, strip, utc_iso
from leafmill.operators.quality import full_text

# The registry's columns in order.
COLUMNS = [
    "paper_id", "covidence_id", "title", "source_filename", "n_pages", "total_chars", "title_exact_match", "title_first_page", "title_word_hits", "program_marker_count",
    "abstract_code_marker_count", "website_chrome_detected", "suspicious_control_char_count", "screen_status", "manual_action", "screen_reason", "screened_at_utc",
]


def normalized_pages(pages: Column) -> Column:
    return F.transform(pages, lambda p: normalize_text(p["text"]))


def title_first_page(title: Column, pages: Column) -> Column:
    """Position of the first normalised page that holds the normalised title, -1 if none or the title is blank."""
    at = F.array_position(F.transform(pages, lambda p: F.contains(p, title)), F.lit(True)) - 1
    return F.when(title == "", F.lit(-1)).otherwise(at).cast("int")


def title_word_hits(title: Column, text: Column, most: int = 8) -> Column:
    """`hits/words` of the title's first words of 5 letters or more; blank without such words."""
    long = F.slice(F.filter(F.split(title, " "), lambda w: F.length(w) >= 5), 1, most)
    hits = F.size(F.filter(long, lambda w: F.contains(text, w)))
    return F.when(F.size(long) > 0, F.concat_ws("/", hits.cast("string"), F.size(long).cast("string"))).otherwise(F.lit(""))


def abstract_codes(pages: Column, raw_pages: Column, config: Config = DEFAULT) -> Column:
    """Distinct abstract codes of the first pages. With compat they are sought in normalised pages, where none can match."""
    where = pages if config.compat else F.transform(raw_pages, lambda p: F.coalesce(p["text"], F.lit("")))
    return F.size(F.array_distinct(F.regexp_extract_all(F.array_join(F.slice(where, 1, config.thresholds.signal_pages), "\n"), F.lit(ABSTRACT_CODE), F.lit(0))))


def markers(values: tuple[str, ...], config: Config) -> list[str]:
    """Markers as they are with compat, else normalised like the text they are sought in."""
    import re

    return list(values) if config.compat else [" ".join(re.findall("[a-z0-9]+", v.lower())) for v in values]


def screen_status(n_pages: Column, title_page: Column, program: Column, codes: Column, control: Column, config: Config = DEFAULT) -> Column:
    """struct<status, action, reason>"""
    t = config.thresholds
    volume = (n_pages >= t.large_pages) & (title_page >= t.title_page) & ((program > 0) | (codes >= t.abstract_codes))
    told = lambda s, a, r: F.struct(F.lit(s).alias("status"), F.lit(a).alias("action"), r.alias("reason"))
    return (
        F.when(volume, told("manual_trim_recommended", "trim_to_target_pages", F.format_string(SCREEN_VOLUME_REASON, title_page, codes)))
        .when(control >= t.review_control_chars, told("review_text_quality", "inspect_text_extraction", F.format_string(SCREEN_TEXT_REASON, control)))
        .otherwise(told("ok", "", F.lit("")))
    )


def screen(records: DataFrame, references: DataFrame, config: Config = DEFAULT, key: str = "Covidence") -> DataFrame:
    """The screening registry: records left-joined with their reference (Title, Journal and key, all strings)."""
    t = config.thresholds
    refs = references.select(F.col(key).alias("_key"), F.col("Title").alias("_title"), F.col("Journal").alias("_journal"))
    r = records.join(refs, F.col("paper_id") == F.col("_key"), "left")
    empty = F.array().cast("array<struct<page_index:int,text:string>>")
    r = r.withColumn("_pages", F.coalesce("pages", empty)).withColumn("_np", normalized_pages(F.col("_pages")))
    r = r.withColumn("_t", strip(F.coalesce("_title", F.lit("")))).withColumn("_nt", normalize_text(F.col("_t")))
    first = F.array_join(F.slice("_np", 1, t.marker_pages), " ")
    where = F.concat_ws(" ", normalize_text(F.col("source_filename")), normalize_text(F.col("_journal")), first)
    r = (
        r.withColumn("_page", title_first_page(F.col("_nt"), F.col("_np")))
        .withColumn("_hits", title_word_hits(F.col("_nt"), F.array_join("_np", " "), t.title_words))
        .withColumn("_control", control_char_count(full_text(F.col("_pages"))))
        .withColumn("_program", count_markers(where, markers(config.screen_markers, config)))
        .withColumn("_codes", abstract_codes(F.col("_np"), F.col("_pages"), config))
        .withColumn("_chrome", any_marker(F.array_join(F.slice("_np", 1, t.chrome_pages), " "), markers(config.chrome_markers, config)))
    )
    r = r.withColumn("_s", screen_status(F.coalesce("n_pages", F.lit(0)), F.col("_page"), F.col("_program"), F.col("_codes"), F.col("_control"), config))
    return r.select(
        "paper_id",
        strip(F.coalesce(F.nullif("_key", F.lit("")), "paper_id")).alias("covidence_id"),
        F.col("_t").alias("title"),
        F.coalesce("source_filename", F.lit("")).alias("source_filename"),
        falsy_text(F.col("n_pages"), "int").alias("n_pages"),
        F.aggregate(F.coalesce("page_char_counts", F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, x: a + x).cast("string").alias("total_chars"),
        bool_text(F.col("_page") >= 0).alias("title_exact_match"),
        F.when(F.col("_page") >= 0, F.col("_page").cast("string")).otherwise("").alias("title_first_page"),
        F.col("_hits").alias("title_word_hits"),
        F.col("_program").cast("string").alias("program_marker_count"),
        F.col("_codes").cast("string").alias("abstract_code_marker_count"),
        bool_text(F.col("_chrome")).alias("website_chrome_detected"),
        F.col("_control").cast("string").alias("suspicious_control_char_count"),
        F.col("_s.status").alias("screen_status"),
        F.col("_s.action").alias("manual_action"),
        F.col("_s.reason").alias("screen_reason"),
        utc_iso(F.current_timestamp()).alias("screened_at_utc"),
    )
