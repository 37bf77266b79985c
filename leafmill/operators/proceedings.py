"""Multi-document volumes: lines, signals, blocks, matching to a reference, trimming.

Everything is keyed by paper_id and works on exploded lines, so a volume of thousands of lines costs one shuffle of narrow
rows; the text of lines goes along only where titles and previews are built.
"""

from __future__ import annotations

import re
from string import ascii_letters, digits

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.config import ABSTRACT_START, AUTHOR_CREDENTIAL, DEFAULT, TRIM_METHOD, TRIM_REASONS, Config, Thresholds
from leafmill.functions.fuzzy import accepted, combine_title, match_score, ratio_bound, score_authors, sequence_ratio, sequence_ratio_from, surnames, token_overlap
from leafmill.functions.text import any_marker, bool_text, collapse_space, count_markers, is_blank, normalize_text, split_lines, strip, utc_iso
from leafmill.operators.screening import markers

# The registry's columns in order.
DECISION_COLUMNS = [
    "paper_id", "covidence_id", "title", "authors", "source_filename", "source_text_json_path", "trimmed_text_json_path", "n_pages", "abstract_block_count", "title_like_line_count",
    "author_like_line_count", "program_marker_count", "proceedings_detected", "trim_status", "trim_reason", "trim_method", "matched_block_code", "matched_block_title", "title_score",
    "author_score", "match_score", "start_page_index", "end_page_index", "trimmed_at_utc",
]


def lines_of_pages(pages: DataFrame) -> DataFrame:
    """Of (paper_id, page_index, text): (paper_id, page_index, line_index, text) without blank lines, white space collapsed."""
    exploded = pages.select("paper_id", F.coalesce("page_index", F.lit(0)).alias("page_index"), F.posexplode(split_lines(F.coalesce("text", F.lit("")))).alias("line_index", "raw"))
    return exploded.where(~is_blank(F.col("raw"))).select("paper_id", "page_index", "line_index", collapse_space(F.col("raw")).alias("text"))


def flatten_lines(records: DataFrame) -> DataFrame:
    """Lines of records with an array of pages; a page keeps its place if two share an index."""
    pages = records.select("paper_id", F.posexplode("pages").alias("page_pos", "p")).select("paper_id", "page_pos", F.coalesce("p.page_index", F.lit(0)).alias("page_index"), F.col("p.text").alias("text"))
    exploded = pages.select("paper_id", "page_pos", "page_index", F.posexplode(split_lines(F.coalesce("text", F.lit("")))).alias("line_index", "raw"))
    return exploded.where(~is_blank(F.col("raw"))).select("paper_id", "page_pos", "page_index", "line_index", collapse_space(F.col("raw")).alias("text"))


def is_start(line: Column) -> Column:
    return line.rlike(ABSTRACT_START)


def is_author_like(line: Column) -> Column:
    """With several commas, a list or a credential; these are sought last, and only where one of their first letters begins a word."""
    commas = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(",")))
    begins = f"(?=[MDPBRFmdpbrf])(?<![{ascii_letters}{digits}_])"
    return (commas >= 3) | (F.contains(line, F.lit(";")) & (commas >= 1)) | line.rlike(begins + "(?iU)" + AUTHOR_CREDENTIAL)


def is_institution_like(normalized: Column, config: Config = DEFAULT) -> Column:
    return any_marker(normalized, config.institution_markers)


def is_footer_like(normalized: Column, config: Config = DEFAULT) -> Column:
    return any_marker(normalized, markers(config.footer_markers, config))


def _may_be_footer(line: Column, config: Config = DEFAULT) -> Column:
    """False for ASCII lines that do not hold the longest word of any marker: these need not be normalised to tell that they are no footers."""
    longest = {max(re.findall("[a-z0-9]+", m) or [""], key=len) for m in markers(config.footer_markers, config)}
    return (F.octet_length(line) != F.char_length(line)) | any_marker(F.lower(line), sorted(longest))


def starts(lines: DataFrame) -> DataFrame:
    """Adds is_start alone, all that block_lines() needs."""
    return lines.withColumn("is_start", is_start(F.col("text")))


def _kinds(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds is_author, is_institution and is_footer."""
    norm = lines.withColumn("_norm", normalize_text(F.col("text"))).withColumn("is_author", is_author_like(F.col("text")))
    return norm.withColumn("is_institution", is_institution_like(F.col("_norm"), config)).withColumn("is_footer", is_footer_like(F.col("_norm"), config)).drop("_norm")


def _worded() -> Column:
    """Of 4 to 24 words, nearly all with a letter; words are looked into only where their number fits."""
    n = F.octet_length("text") - F.octet_length(F.replace("text", F.lit(" "))) + 1
    alpha = F.regexp_count("text", F.lit(f"(?<![^ ])[^ {ascii_letters}]*+[{ascii_letters}]"))  # words with a letter; a match begins at a word's start only
    return n.between(4, 24) & (alpha >= F.greatest(F.lit(3), n - 2))


def classify(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds is_start, is_author, is_institution, is_footer and is_title."""
    other = F.col("is_start") | F.col("is_author") | F.col("is_institution") | F.col("is_footer")
    return _kinds(starts(lines), config).withColumn("is_title", ~other & _worded())


def classify_early(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds is_start, and of the pages that signals() counts is_author and is_title: only lines that could be titles are normalised."""
    early = F.col("page_index") < config.thresholds.signal_pages
    told = starts(lines).withColumn("is_author", early & is_author_like(F.col("text")))
    told = told.withColumn("_may", early & ~F.col("is_start") & ~F.col("is_author") & _worded()).withColumn("_norm", normalize_text(F.when(F.col("_may"), F.col("text"))))
    return told.withColumn("is_title", F.col("_may") & ~(is_institution_like(F.col("_norm"), config) | is_footer_like(F.col("_norm"), config))).drop("_may", "_norm")


def signals(classified: DataFrame, volumes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Of lines of classify() or classify_early() and (paper_id, source_filename, n_pages): counts for each volume and whether it is a proceedings volume."""
    t = config.thresholds
    early = F.col("page_index") < t.signal_pages
    order = [c for c in ("page_pos", "page_index", "line_index") if c in classified.columns]
    first = F.when(F.col("page_index") < t.marker_pages, F.struct(*order, F.col("text")))
    counts = classified.groupBy("paper_id").agg(
        F.count_if(early & F.col("is_start")).alias("abstract_block_count"),
        F.count_if(early & F.col("is_title")).alias("title_like_line_count"),
        F.count_if(early & F.col("is_author")).alias("author_like_line_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["text"]), " ").alias("_first"),
    )
    joined = volumes.join(counts, "paper_id", "left").fillna(0, ["abstract_block_count", "title_like_line_count", "author_like_line_count"])
    where = normalize_text(F.concat_ws(" ", F.coalesce("source_filename", F.lit("")), normalize_text(F.col("_first"))))
    out = joined.withColumn("program_marker_count", count_markers(where, markers(config.trim_markers, config))).drop("_first")
    return out.withColumn("proceedings_detected", proceedings_rule(F.col("n_pages"), F.col("abstract_block_count"), F.col("title_like_line_count"), F.col("author_like_line_count"), F.col("program_marker_count"), t))


def proceedings_rule(n_pages: Column, starts: Column, titles: Column, authors: Column, program: Column, t: Thresholds = DEFAULT.thresholds) -> Column:
    many = (starts >= t.abstract_starts) | ((titles >= t.title_like) & (authors >= t.author_like)) | (program > 0)
    return F.coalesce((n_pages >= t.large_pages) & many, F.lit(False))


def block_lines(classified: DataFrame) -> DataFrame:
    """Lines with block_no (from 1 for each volume; lines before the first start are dropped), idx in the volume and rn in the block.

    Numbers come from a scan of two levels: lines are numbered within their page, the pages of a volume, a row each, carry what went
    before them (lines, starts and the last start), and both are added. No window takes the lines of a whole volume.
    """
    page = [c for c in ("page_pos", "page_index") if c in classified.columns]
    within = Window.partitionBy("paper_id", *page).orderBy("line_index").rowsBetween(Window.unboundedPreceding, 0)
    lines = (
        classified.withColumn("_line", F.row_number().over(Window.partitionBy("paper_id", *page).orderBy("line_index")))
        .withColumn("_starts", F.sum(F.col("is_start").cast("int")).over(within))
        .withColumn("_own", F.max(F.when(F.col("is_start"), F.col("_line"))).over(within))
    )
    pages = lines.groupBy("paper_id", *page).agg(F.max("_line").alias("_lines"), F.max("_starts").alias("_all"), F.max("_own").alias("_last"))
    before = Window.partitionBy("paper_id").orderBy(*page).rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("_line0", F.coalesce(F.sum("_lines").over(before), F.lit(0))).withColumn("_block0", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    pages = pages.withColumn("_open", F.max(F.col("_line0") + F.col("_last")).over(before)).select("paper_id", *page, "_line0", "_block0", "_open")
    numbered = lines.join(pages, ["paper_id", *page]).withColumn("block_no", F.col("_block0") + F.col("_starts")).where("block_no > 0")
    numbered = numbered.withColumn("idx", F.col("_line0") + F.col("_line") - 1)
    numbered = numbered.withColumn("rn", (F.col("idx") + 2 - F.coalesce(F.col("_line0") + F.col("_own"), F.col("_open"))).cast("int"))
    return numbered.select(*classified.columns, "block_no", "idx", "rn")


#: Lines of a block that make its preview, and its title at most.
PREVIEW_LINES, TITLE_LINES = 12, 5


def blocks(numbered: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row a block: code, title, preview and extents. The title goes on for up to 4 lines, until another kind of line.

    Only a block's first lines are collected; its extents are partial minima and maxima. Lines of starts() are classified here, only
    those that can end a title; of the others of the preview footers are told.
    """
    if "is_footer" not in numbered.columns:
        ends = F.col("rn").between(2, TITLE_LINES)
        told = numbered.withColumn("is_author", ends & is_author_like(F.col("text"))).withColumn("_open", ends & ~F.col("is_author"))
        norm = told.withColumn("_norm", normalize_text(F.when((F.col("rn") <= PREVIEW_LINES) & (F.col("_open") | _may_be_footer(F.col("text"), config)), F.col("text"))))
        numbered = norm.withColumn("is_institution", F.col("_open") & is_institution_like(F.col("_norm"), config)).withColumn("is_footer", is_footer_like(F.col("_norm"), config))
    stop = (F.col("rn") > 1) & (F.col("is_start") | F.col("is_author") | F.col("is_institution") | F.col("is_footer"))
    own = F.when(F.col("rn") == 1, strip(F.regexp_extract("text", ABSTRACT_START, 2))).otherwise(F.col("text"))
    head = F.when(F.col("rn") <= PREVIEW_LINES, F.struct("rn", stop.alias("stop"), own.alias("own"), "text", F.col("is_footer").alias("footer")))
    told = numbered.groupBy("paper_id", "block_no").agg(
        F.array_sort(F.collect_list(head)).alias("_head"),
        F.min("idx").alias("start_index"),
        (F.max("idx") + 1).alias("end_index"),
        F.min_by("page_index", "idx").alias("start_page_index"),
        F.max_by("page_index", "idx").alias("end_page_index"),
    )
    told = told.withColumn("_stop", F.coalesce(F.array_min(F.transform(F.filter("_head", lambda x: x["stop"]), lambda x: x["rn"])), F.lit(TITLE_LINES + 1)))
    title = F.filter("_head", lambda x: (x["rn"] <= TITLE_LINES) & (x["rn"] < F.col("_stop")))
    joined = lambda lines, field: F.array_join(F.filter(F.transform(lines, lambda x: x[field]), lambda x: x != ""), " ")
    return told.select(
        "paper_id",
        "block_no",
        F.regexp_extract(F.get("_head", F.lit(0))["text"], ABSTRACT_START, 1).alias("code"),
        joined(title, "own").alias("title_text"),
        joined(F.filter("_head", lambda x: ~x["footer"]), "text").alias("preview_text"),
        "start_index",
        "end_index",
        "start_page_index",
        "end_page_index",
    )


_HELPERS = ("_ref", "_own", "_names", "_overlap", "_ratio", "_ref_title", "_ref_authors")


def _dealt(b: DataFrame) -> DataFrame:
    """Blocks over all tasks: scoring is long for its bytes, so neither a volume nor what looks small is left to one task."""
    return b.repartition(int(b.sparkSession.conf.get("spark.sql.shuffle.partitions")), "paper_id", "block_no")


def _with_reference(found: DataFrame, references: DataFrame) -> DataFrame:
    """Blocks with the reference of their volume and what of the scores needs no sequence ratio."""
    b = _dealt(found).join(references.select("paper_id", F.col("title").alias("_ref_title"), F.col("authors").alias("_ref_authors")), "paper_id", "left")
    b = b.withColumn("_ref", normalize_text(F.col("_ref_title"))).withColumn("_own", normalize_text(F.col("title_text"))).withColumn("_names", surnames(F.col("_ref_authors")))
    return b.withColumn("author_score", score_authors(F.col("_names"), F.col("preview_text"))).withColumn("_overlap", token_overlap(F.col("_ref"), F.col("_own")))


def _title(ratio: Column) -> Column:
    return combine_title(F.col("_ref"), F.col("_own"), ratio, F.col("_overlap"))


def score_blocks(found: DataFrame, references: DataFrame) -> DataFrame:
    """Blocks joined with (paper_id, title, authors) of their volume, with title, author and match scores."""
    b = _with_reference(found, references).withColumn("_ratio", sequence_ratio(F.col("_ref"), F.col("_own")))
    b = b.withColumn("title_score", _title(F.col("_ratio")))
    return b.withColumn("match_score", match_score(F.col("title_score"), F.col("author_score"))).drop(*_HELPERS)


def best_blocks(scored: DataFrame) -> DataFrame:
    """The block with the best match of each volume, the earliest of equals."""
    w = Window.partitionBy("paper_id").orderBy(F.col("match_score").desc(), "block_no")
    return scored.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def best_match(found: DataFrame, references: DataFrame) -> DataFrame:
    """best_blocks(score_blocks(found, references)), with few sequence ratios.

    The block of each volume that could score highest is scored first. Another one is scored only if the length of its title, and then its
    letters, allow it to reach that score; the others keep a score that is too low to win.
    """
    b = _with_reference(found, references).withColumn("_most", match_score(_title(ratio_bound(F.col("_ref"), F.col("_own"))), F.col("author_score")))
    volume = Window.partitionBy("paper_id")
    b = b.withColumn("_rank", F.row_number().over(volume.orderBy(F.col("_most").desc(), F.col("_overlap").desc(), "block_no")))
    b = b.withColumn("_first", sequence_ratio(F.when(F.col("_rank") == 1, F.col("_ref")), F.col("_own")))
    b = b.withColumn("_reached", F.max(F.when(F.col("_rank") == 1, match_score(_title(F.col("_first")), F.col("author_score")))).over(volume))
    # the ratio without which a title score, and so a match, stays below what is reached; a little less, for rounding
    t = DEFAULT.thresholds.title_weight
    wanted = (F.col("_reached") - (1 - t) * F.col("author_score")) / t
    least = F.least(wanted, (wanted - 0.35 * F.col("_overlap")) / 0.65) - 1e-9
    again = (F.col("_rank") > 1) & (F.col("_most") >= F.col("_reached") - 1e-9)
    b = _dealt(b).withColumn("_later", sequence_ratio_from(F.when(again, F.col("_ref")), F.col("_own"), least))
    b = b.withColumn("title_score", _title(F.when(F.col("_rank") == 1, F.col("_first")).otherwise(F.col("_later"))))
    scored = b.withColumn("match_score", match_score(F.col("title_score"), F.col("author_score")))
    return best_blocks(scored.drop(*_HELPERS, "_most", "_rank", "_first", "_reached", "_later"))


def decide(signalled: DataFrame, best: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Signals with the best block's columns (null if there is none), trim_status and trim_reason."""
    b = best.select("paper_id", F.lit(True).alias("_has"), *[c for c in best.columns if c != "paper_id"])
    d = signalled.join(b, "paper_id", "left")
    good = accepted(F.col("title_score"), F.col("author_score"), F.col("match_score"), config.thresholds)
    state = (
        F.when(~F.col("proceedings_detected"), F.struct(F.lit("not_needed").alias("s"), F.lit(TRIM_REASONS["no_volume"]).alias("r")))
        .when(F.col("_has").isNull(), F.struct(F.lit("manual_review_required").alias("s"), F.lit(TRIM_REASONS["no_block"]).alias("r")))
        .when(~good, F.struct(F.lit("manual_review_required").alias("s"), F.lit(TRIM_REASONS["low_match"]).alias("r")))
        .otherwise(F.struct(F.lit("trimmed_auto").alias("s"), F.lit(TRIM_REASONS["matched"]).alias("r")))
    )
    d = d.withColumn("_state", state).withColumn("trim_status", F.col("_state.s")).withColumn("trim_reason", F.col("_state.r")).drop("_state", "_has")
    seen = F.col("trim_status") != "not_needed"
    return d.select(*[F.when(seen, F.col(c)).alias(c) if c in best.columns and c != "paper_id" else F.col(c) for c in d.columns])


def trimmed_pages(numbered: DataFrame, decided: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(paper_id, page_index, text) of the matched block of each volume that is trimmed, footers and blank pages left out."""
    wanted = decided.where("trim_status = 'trimmed_auto'").select("paper_id", "block_no")
    footer = F.col("is_footer") if "is_footer" in numbered.columns else _may_be_footer(F.col("text"), config) & is_footer_like(normalize_text(F.col("text")), config)
    line = F.when(~footer, F.struct("idx", "text"))  # not in a filter, which would be made before the join, for all lines
    kept = numbered.join(wanted, ["paper_id", "block_no"], "left_semi")
    pages = kept.groupBy("paper_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]), "\n").alias("text"))
    return pages.withColumn("text", strip(F.col("text"))).where("text <> ''")


def trimmed_records(pages: DataFrame, decided: DataFrame, records: DataFrame, references: DataFrame, source_paths: Column | None = None) -> DataFrame:
    """Whole records of trimmed volumes."""
    grouped = pages.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "text"))).alias("pages"))
    d = decided.where("trim_status = 'trimmed_auto'").drop("source_filename", "n_pages")
    r = records.select("paper_id", F.coalesce("source_filename", F.lit("")).alias("source_filename"), F.coalesce("source_sha256", F.lit("")).alias("source_sha256"), F.coalesce("n_pages", F.lit(0)).alias("original_n_pages"), (F.lit("") if source_paths is None else source_paths).alias("source_text_json_path"))
    refs = references.select("paper_id", strip(F.coalesce("title", F.lit(""))).alias("title"), strip(F.coalesce("authors", F.lit(""))).alias("authors"))
    j = d.join(grouped, "paper_id", "left").join(r, "paper_id").join(refs, "paper_id", "left")
    pages_col = F.coalesce("pages", F.array().cast("array<struct<page_index:int,text:string>>"))
    return j.select(
        "paper_id", "source_filename", "source_sha256", "source_text_json_path", "trim_status", F.lit(TRIM_METHOD).alias("trim_method"), F.lit(True).alias("proceedings_detected"),
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("authors", F.lit("")).alias("authors"), F.col("code").alias("matched_block_code"), F.col("title_text").alias("matched_block_title"),
        F.round("match_score", 4).alias("match_score"), F.round("title_score", 4).alias("title_score"), F.round("author_score", 4).alias("author_score"),
        "start_page_index", "end_page_index", "original_n_pages", F.size(pages_col).alias("n_pages"), F.transform(pages_col, lambda p: F.length(p["text"])).alias("page_char_counts"),
        utc_iso(F.current_timestamp()).alias("trimmed_at_utc"), pages_col.alias("pages"),
    )


def decision_rows(decided: DataFrame, references: DataFrame, source_path: Column | None = None, trimmed_dir: str = "text_trimmed") -> DataFrame:
    """The trim registry, all strings."""
    refs = references.select("paper_id", F.col("title").alias("_t"), F.col("authors").alias("_a"))
    d = decided.join(refs, "paper_id", "left")
    auto = F.col("trim_status") == "trimmed_auto"
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    score = lambda c: F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("")) if c else None
    return d.select(
        "paper_id", F.col("paper_id").alias("covidence_id"), strip(text("_t")).alias("title"), strip(text("_a")).alias("authors"), text("source_filename").alias("source_filename"),
        (F.lit("") if source_path is None else source_path).alias("source_text_json_path"), F.when(auto, F.concat(F.lit(trimmed_dir + "/"), F.col("paper_id"), F.lit(".json"))).otherwise("").alias("trimmed_text_json_path"),
        *[text(c).alias(c) for c in ("n_pages", "abstract_block_count", "title_like_line_count", "author_like_line_count", "program_marker_count")],
        bool_text(F.col("proceedings_detected")).alias("proceedings_detected"), "trim_status", "trim_reason", F.when(auto, TRIM_METHOD).otherwise("").alias("trim_method"),
        text("code").alias("matched_block_code"), text("title_text").alias("matched_block_title"),
        *[F.when(F.col(c).isNull(), "").otherwise(score(c)).alias(c) for c in ("title_score", "author_score", "match_score")],
        text("start_page_index").alias("start_page_index"), text("end_page_index").alias("end_page_index"), F.when(auto, utc_iso(F.current_timestamp())).otherwise("").alias("trimmed_at_utc"),
    )
