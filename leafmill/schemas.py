"""Schemas of the records, for explicit reads."""

from __future__ import annotations

from pyspark.sql import types as T


def ddl(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


# Names and types of the records' fields.
PAGES = "pages array<struct<page_index int, text string>>"
TEXT_RECORD_DDL = (
    "paper_id string, source_filename string, source_sha256 string, extractor string, extracted_at_utc string, n_pages int, needs_ocr_before_ocr boolean,"
    " ocr_trigger_reasons array<string>, page_char_counts array<int>, suspicious_control_chars int, needs_ocr boolean, remaining_text_quality_flags array<string>,"
    f" ocr_applied boolean, ocr_mode string, ocr_error string, {PAGES}"
)
TRIMMED_RECORD_DDL = (
    "paper_id string, source_filename string, source_sha256 string, source_text_json_path string, trim_status string, trim_method string, proceedings_detected boolean,"
    " title string, authors string, matched_block_code string, matched_block_title string, match_score double, title_score double, author_score double,"
    f" start_page_index int, end_page_index int, original_n_pages int, n_pages int, page_char_counts array<int>, trimmed_at_utc string, {PAGES}"
)
EXTRACTION = "struct<extraction_class: string, extraction_text: string, alignment_status: string, char_start: int, char_end: int>"
_PROVENANCE = "paper_id string, source_filename string, source_sha256 string, source_text_json_path string, used_trimmed_text boolean, model_id string, generated_at_utc string"
_RAW_MODE = f"struct<extraction_count int, extractions array<{EXTRACTION}>>"
_SUMMARY_MODE = "struct<section_summaries map<string,string>, overall_summary string, extraction_count int>"
EXTRACTION_RAW_DDL = f"{_PROVENANCE}, total_extraction_count int, extraction_modes struct<individual: {_RAW_MODE}, `group`: {_RAW_MODE}>"
SUMMARY_DDL = f"{_PROVENANCE}, total_extraction_count int, extraction_modes struct<individual: {_SUMMARY_MODE}, `group`: {_SUMMARY_MODE}>"
QUALITY_RAW_DDL = (
    f"{_PROVENANCE}, publication_type string, publication_type_method string, publication_type_detections array<{EXTRACTION}>, extractions array<{EXTRACTION}>,"
    f" unmatched_extractions array<{EXTRACTION}>, extraction_count int"
)
QUALITY_RECORD_DDL = (
    f"{_PROVENANCE}, publication_type string, field_order array<string>, values map<string,string>, evidence map<string,array<string>>, missing_fields array<string>"
)
MANIFEST_DDL = (
    "covidence_id string, label string, status string, saved_path string, source_filename string, download_url string, method string, error string,"
    " started_at_utc string, finished_at_utc string"
)
REFERENCE_COLUMNS = (
    "Covidence", "Ref", "Study", "Title", "Authors", "Published Year", "Published Month", "Journal", "Volume", "Issue", "Pages", "Accession Number", "DOI", "Notes", "Tags",
)
