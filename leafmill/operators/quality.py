"""Text quality of page-wise records and the decision to run OCR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.config import DEFAULT, Thresholds
from leafmill.functions.text import control_char_count


def low_text(counts: Column, t: Thresholds = DEFAULT.thresholds) -> Column:
    """Whether more than the given share of pages has few characters; false without pages."""
    few = F.size(F.filter(counts, lambda x: x < t.small_page_chars))
    return F.coalesce((F.size(counts) > 0) & (few / F.size(counts) > t.small_page_share), F.lit(False))


def full_text(pages: Column) -> Column:
    return F.array_join(F.transform(pages, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")


def quality_flags(pages: Column, counts: Column, t: Thresholds = DEFAULT.thresholds) -> Column:
    """`low_text`, `control_chars`, in this order, where they apply."""
    control = control_char_count(full_text(pages))
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    dirty = (control >= t.control_chars) | ((control > 0) & (total > 0) & (control / total > t.control_share))
    return F.array_compact(F.array(F.when(low_text(counts, t), F.lit("low_text")), F.when(dirty, F.lit("control_chars"))))


def ocr_decision(records: DataFrame, t: Thresholds = DEFAULT.thresholds) -> DataFrame:
    """Adds ocr_trigger_reasons, needs_ocr_before_ocr and ocr_mode to records with pages and page_char_counts."""
    flagged = records.withColumn("ocr_trigger_reasons", quality_flags(F.col("pages"), F.col("page_char_counts"), t))
    needed = F.size("ocr_trigger_reasons") > 0
    mode = F.when(needed, F.when(F.array_contains("ocr_trigger_reasons", "control_chars"), "force-ocr").otherwise("skip-text")).otherwise("")
    return flagged.withColumn("needs_ocr_before_ocr", needed).withColumn("ocr_mode", mode)


def finish_record(records: DataFrame, t: Thresholds = DEFAULT.thresholds) -> DataFrame:
    """Flags of the pages as they are after OCR, and n_pages."""
    return (
        records.withColumn("remaining_text_quality_flags", quality_flags(F.col("pages"), F.col("page_char_counts"), t))
        .withColumn("needs_ocr", F.size("remaining_text_quality_flags") > 0)
        .withColumn("suspicious_control_chars", control_char_count(full_text(F.col("pages"))))
        .withColumn("n_pages", F.size("pages"))
    )
