"""Section summaries of extracted snippets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.config import DEFAULT, GROUP_SECTIONS, INDIVIDUAL_SECTIONS, NOT_STATED
from leafmill.functions.text import strip


def distinct_snippets(extractions: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Of (paper_id, pos, extraction_class, extraction_text): each text once for each class, at its first position; blanks dropped."""
    e = extractions.select("paper_id", "pos", "extraction_class", strip(F.coalesce("extraction_text", F.lit(""))).alias("extraction_text")).where("extraction_text <> ''")
    if classes is not None:
        e = e.where(F.col("extraction_class").isin(list(classes)))
    return e.groupBy("paper_id", "extraction_class", "extraction_text").agg(F.min("pos").alias("pos"))


def section_snippets(extractions: DataFrame, classes: list[str]) -> DataFrame:
    """(paper_id, extraction_class, snippets) in order."""
    return distinct_snippets(extractions, classes).groupBy("paper_id", "extraction_class").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "extraction_text"))), lambda x: x["extraction_text"]).alias("snippets"))


def render(sections: DataFrame, papers: DataFrame, labels: Mapping[str, str], most: int = DEFAULT.thresholds.snippets) -> DataFrame:
    """paper_id, section_summaries (map in section order) and overall_summary for every paper."""
    told = sections.withColumn("s", F.array_join(F.slice("snippets", 1, most), " ")).groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("extraction_class", "s"))).alias("m"))
    j = papers.select("paper_id").distinct().join(told, "paper_id", "left")
    text = {k: F.coalesce(F.col("m").getItem(k), F.lit(NOT_STATED)) for k in labels}
    return j.select(
        "paper_id",
        F.map_from_arrays(F.array(*[F.lit(k) for k in labels]), F.array(*text.values())).alias("section_summaries"),
        F.concat_ws(" ", *[F.concat(F.lit(f"{label}: "), text[k]) for k, label in labels.items()]).alias("overall_summary"),
    )


def modes(individual_only: bool = False, group_only: bool = False) -> dict[str, Mapping[str, str]]:
    """Active modes with their sections; both run if neither flag is set."""
    both = not individual_only and not group_only
    out: dict[str, Mapping[str, str]] = {}
    if individual_only or both:
        out["individual"] = INDIVIDUAL_SECTIONS
    if group_only or both:
        out["group"] = GROUP_SECTIONS
    return out
