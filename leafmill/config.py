"""Vocabularies, thresholds and labels. All of them are defaults that the operators take as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

# Word lists, labels and patterns that results depend on.
ABSTRACT_START = r"^((?:[A-Z]{1,3}-)?(?:[A-Z]{1,2})?\d{2,3})\.\s+(.+)$"
ABSTRACT_CODE = r"\b(?:[A-Z]-)?[A-Z]?\d{2,3}\."
AUTHOR_CREDENTIAL = r"\b(MD|M\.D\.|DO|D\.O\.|PHD|PH\.D\.|MSC|M\.S\.|MS|BS|B\.S\.|BA|B\.A\.|MBA|MBBS|MPH|RN|FRCPC|FAAN|FRCP|DPhil)\b"
TRIM_PROGRAM_MARKERS = ("annual meeting", "program and abstracts", "program abstracts", "poster sessions", "poster presentations")
SCREEN_PROGRAM_MARKERS = ("annual meeting", "program", "poster sessions", "poster presentations")
WEBSITE_CHROME_MARKERS = ("home | login", "users online", "table of contents", "article access statistics", "search pubmed")
INSTITUTION_MARKERS = (
    "university", "hospital", "medical center", "school of medicine", "clinic", "department", "institute", "center", "centre",
    "usa", "canada", "united kingdom", "australia", "japan", "italy", "france", "germany", "korea",
)
FOOTER_MARKERS = ("annals of neurology", "downloaded from https://", "terms and conditions", "program and abstracts")
NA_HINTS = ("na", "not available", "not applicable", "not reported", "unknown", "unclear")
VALUE_SEPARATORS = ("::", "||", " - ", " -- ")
INDIVIDUAL_SECTIONS = {
    "individual_presentation": "Individual presentation",
    "individual_diagnostics": "Individual diagnostics",
    "individual_treatment": "Individual treatment",
    "individual_outcome": "Individual outcome",
    "individual_limitations": "Individual limitations",
}
GROUP_SECTIONS = {
    "group_design": "Group design",
    "group_characteristics": "Group characteristics",
    "group_findings": "Group findings",
    "group_treatment_outcomes": "Group treatment/outcomes",
    "group_limitations": "Group limitations",
}
PUBLICATION_ALIASES = (
    ("case-control", "Case Control"),
    ("case control", "Case Control"),
    ("case series", "Case Series & Reports"),
    ("case report", "Case Series & Reports"),
    ("pre-post", "Before-After (Pre-Post) N contr"),
    ("before-after", "Before-After (Pre-Post) N contr"),
    ("randomized", "Controlled Intervention Studies"),
    ("randomised", "Controlled Intervention Studies"),
    ("rct", "Controlled Intervention Studies"),
    ("cross-sectional", "Observ Cohort & Cross sect"),
    ("cross sectional", "Observ Cohort & Cross sect"),
    ("cohort", "Observ Cohort & Cross sect"),
    ("observational", "Observ Cohort & Cross sect"),
)
ARTIFACT_NAMES = ("reference", "pdf", "text", "text_trimmed", "langextract", "summary", "quality_raw", "quality_record")
DICTIONARY_COLUMNS = ("publication_type", "field", "section", "criterion_text", "entry_guidance", "inferred_type", "accepted")
TRIM_METHOD = "fuzzy_title_author_block_match"
NOT_STATED = "Not stated."
# Texts of the registries.
TRIM_REASONS = {
    "no_volume": "Document does not look like a large proceedings/program PDF.",
    "no_block": "No abstract block could be segmented from the proceedings text.",
    "low_match": "Proceedings detected, but the best abstract block match is below the auto-trim confidence threshold.",
    "matched": "Proceedings detected and the target abstract block matched with sufficient confidence.",
}
SCREEN_VOLUME_REASON = "Large multi-abstract/program PDF; target title appears on page %d with %d abstract-code markers."
SCREEN_TEXT_REASON = "Text contains %d suspicious control characters; review text quality."


@dataclass(frozen=True)
class Thresholds:
    """Numbers the decisions depend on; small inputs may lower the page counts."""

    small_page_chars: int = 50
    small_page_share: float = 0.5
    control_chars: int = 10
    control_share: float = 0.002
    large_pages: int = 40
    title_page: int = 5
    abstract_codes: int = 12
    review_control_chars: int = 5
    abstract_starts: int = 8
    title_like: int = 20
    author_like: int = 10
    marker_pages: int = 5
    signal_pages: int = 40
    chrome_pages: int = 2
    title_alone: float = 0.70
    title_with_author: float = 0.55
    author: float = 0.25
    match: float = 0.60
    title_weight: float = 0.75
    snippets: int = 3
    surnames: int = 6
    title_words: int = 8
    schema_errors: int = 12


@dataclass(frozen=True)
class Config:
    thresholds: Thresholds = field(default_factory=Thresholds)
    trim_markers: tuple[str, ...] = TRIM_PROGRAM_MARKERS
    screen_markers: tuple[str, ...] = SCREEN_PROGRAM_MARKERS
    chrome_markers: tuple[str, ...] = WEBSITE_CHROME_MARKERS
    institution_markers: tuple[str, ...] = INSTITUTION_MARKERS
    footer_markers: tuple[str, ...] = FOOTER_MARKERS
    #: Keep what never matches: abstract codes sought in lower-cased text, markers with punctuation sought in normalised text.
    compat: bool = True


DEFAULT = Config()
