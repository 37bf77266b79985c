"""Dictionary-driven assessment: prompts, type detection, structured records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.config import DEFAULT
from leafmill.functions.text import strip
from leafmill.functions.values import default_value, normalise_value, parse_value, resolve_type, value_text
from leafmill.operators.summaries import distinct_snippets

QUALITY_PROMPT = (
    "Study type: {publication_type}.\n"
    "For each field below, report what the text says about it; use the field's name as the extraction class.\n"
    "Write the value first, then ` :: ` and a short quotation as evidence. Write NA for what is not reported or does not apply.\n\n"
    "{field_block}"
)
TYPE_PROMPT = "Name the study type with one extraction of class publication_type. Choose the nearest of these and spell it as it is here:\n{options}"


def type_prompt(types: Sequence[str], template: str = TYPE_PROMPT) -> str:
    return template.replace("{options}", "\n".join(f"- {t}" for t in types))


def quality_prompts(specs: DataFrame, template: str = QUALITY_PROMPT) -> DataFrame:
    """publication_type, prompt: the template with one line for each field in file order."""
    accepted = F.when(F.size("accepted") > 0, F.array_join("accepted", ", ")).otherwise("as reported")
    criterion = F.when(F.col("criterion_text") != "", F.col("criterion_text")).otherwise(F.col("entry_guidance"))
    line = F.concat(F.lit("- "), "field", F.lit(" | type: "), "inferred_type", F.lit(" | accepted: "), accepted, F.lit(" | criterion: "), criterion)
    block = specs.groupBy("publication_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("_block"))
    return block.select("publication_type", F.replace(F.replace(F.lit(template), F.lit("{publication_type}"), F.col("publication_type")), F.lit("{field_block}"), F.col("_block")).alias("prompt"))


def few_shot_fields(specs: DataFrame) -> DataFrame:
    """For each publication type the first field of each inferred type, from which examples are built."""
    return specs.groupBy("publication_type", "inferred_type").agg(F.min_by("field", "ord").alias("field"))


def few_shot_examples(specs: DataFrame) -> DataFrame:
    """publication_type, text, extractions: an example that names a binary and a categorical field, and one that names a binary and a
    string field, for types that have such fields."""
    fields = few_shot_fields(specs).groupBy("publication_type").pivot("inferred_type", ["binary_ordinal", "categorical", "string"]).agg(F.first("field"))
    item = lambda c, t: F.struct(F.col(c).alias("extraction_class"), F.lit(t).alias("extraction_text"))
    graded = F.when(F.col("categorical").isNotNull(), F.struct(F.lit("The aim was stated. The overall rating was fair.").alias("text"), F.array(item("binary_ordinal", "1 :: aim was stated"), item("categorical", "fair :: overall rating was fair")).alias("extractions")))
    noted = F.when(F.col("string").isNotNull(), F.struct(F.lit("How patients were allocated is not reported.").alias("text"), F.array(item("binary_ordinal", "NA :: not reported"), item("string", "Allocation not reported")).alias("extractions")))
    return fields.where("binary_ordinal is not null").select("publication_type", F.explode(F.array_compact(F.array(graded, noted))).alias("e")).select("publication_type", "e.text", "e.extractions")


def detect_type(detections: DataFrame, texts: DataFrame, types: Sequence[str], override: str | None = None) -> DataFrame:
    """paper_id, publication_type, method, error. detections: (paper_id, pos, extraction_class, extraction_text); texts: (paper_id, text).

    The first detection that resolves wins, else what the whole text resolves to, else the row fails. An override must be a type.
    """
    if override is not None:
        if override not in types:
            raise ValueError(f"unknown publication type: {override}")
        return texts.select("paper_id", F.lit(override).alias("publication_type"), F.lit("user_override").alias("method"), F.lit(None).cast("string").alias("error"))
    hit = detections.where("extraction_class = 'publication_type'").withColumn("r", resolve_type(F.col("extraction_text"), types)).where("r is not null")
    first = hit.groupBy("paper_id").agg(F.min_by("r", "pos").alias("r"))
    own = texts.select("paper_id", resolve_type(F.col("text"), types).alias("_own"))  # before the join: types are shuffled, not texts
    j = own.join(first, "paper_id", "left").withColumn("publication_type", F.coalesce("r", "_own"))
    return j.select("paper_id", "publication_type", F.lit("auto_detected").alias("method"), F.when(F.col("publication_type").isNull(), "publication type could not be determined").alias("error"))


def structured_values(papers: DataFrame, extractions: DataFrame, specs: DataFrame) -> DataFrame:
    """One row for each paper and field of its type: value struct<s, i>, evidence (first snippets), missing.

    papers: (paper_id, publication_type). The value comes from the first snippet. Where a type names a field twice, the last
    specification holds.
    """
    w = Window.partitionBy("publication_type", "field").orderBy(F.col("ord").desc())
    last = specs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    want = papers.join(last, "publication_type").select("paper_id", "publication_type", "field", "ord", "inferred_type", "accepted")
    found = distinct_snippets(extractions).groupBy("paper_id", F.col("extraction_class").alias("field")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "extraction_text"))), lambda x: x["extraction_text"]).alias("snippets"))
    j = want.join(found, ["paper_id", "field"], "left")
    value = F.when(F.col("snippets").isNull(), default_value(F.col("inferred_type"), F.col("accepted"))).otherwise(normalise_value(parse_value(F.col("snippets")[0]), F.col("inferred_type"), F.col("accepted")))
    return j.select("paper_id", "publication_type", "field", "ord", value.alias("value"), F.coalesce(F.slice("snippets", 1, DEFAULT.thresholds.snippets), F.array().cast("array<string>")).alias("evidence"), F.col("snippets").isNull().alias("missing"))


def unmatched(papers: DataFrame, extractions: DataFrame, specs: DataFrame) -> DataFrame:
    """Extractions whose class is no field of the paper's type; a null class is unmatched."""
    known = papers.join(specs.select("publication_type", "field").distinct(), "publication_type").select("paper_id", F.col("field").alias("extraction_class"))
    return extractions.join(known, ["paper_id", "extraction_class"], "left_anti").select(extractions.columns)


def quality_records(values: DataFrame) -> DataFrame:
    """Tall values as one record a paper: field_order, values, evidence, missing_fields."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "field", "value", "evidence", "missing")))
    r = values.groupBy("paper_id", "publication_type").agg(rows.alias("r"))
    names = F.transform("r", lambda x: x["field"])
    return r.select(
        "paper_id",
        "publication_type",
        names.alias("field_order"),
        F.map_from_arrays(names, F.transform("r", lambda x: value_text(x["value"]))).alias("values"),
        F.map_from_arrays(names, F.transform("r", lambda x: x["evidence"])).alias("evidence"),
        F.transform(F.filter("r", lambda x: x["missing"]), lambda x: x["field"]).alias("missing_fields"),
    )


def input_status(texts: DataFrame, done: DataFrame | None, force: bool = False, dry_run: bool = False) -> DataFrame:
    """What becomes of each input, in this order: skipped, failed (empty text), validated (dry run), run."""
    t = texts
    if done is not None and not force:
        t = t.join(done.select("paper_id", F.lit(True).alias("_done")).distinct(), "paper_id", "left")
    else:
        t = t.withColumn("_done", F.lit(None).cast("boolean"))
    status = F.when(F.col("_done"), "skipped").when(strip(F.coalesce("text", F.lit(""))) == "", "failed").when(F.lit(dry_run), "validated").otherwise("run")
    return t.withColumn("status", status).drop("_done")
