import pytest
from pyspark.sql import functions as F

from leafmill.config import DEFAULT
from leafmill.operators import acquisition, assessment, extraction, proceedings, quality, registry, screening, summaries, validation
from leafmill.plans import pipelines

PAGES = "paper_id string, pages array<struct<page_index:int,text:string>>"


@pytest.mark.parametrize(
    ("counts", "text", "want"),
    [([10, 10, 100], "", ["low_text"]), ([10, 100], "", []), ([50], "", []), ([], "", []), ([100000], "\x01" * 10, ["control_chars"]), ([400], "\x01", ["control_chars"]), ([500], "\x01", []), ([10], "\x01" * 10, ["low_text", "control_chars"])],
)
def test_quality_flags(spark, counts, text, want):
    df = spark.createDataFrame([([(0, text)], counts)], "pages array<struct<page_index:int,text:string>>, page_char_counts array<int>")
    r = quality.ocr_decision(df).first()
    assert r["ocr_trigger_reasons"] == want
    assert r["ocr_mode"] == ("" if not want else "force-ocr" if "control_chars" in want else "skip-text")


@pytest.mark.parametrize(
    ("line", "start", "author", "institution", "footer"),
    [
        ("M207. Stiff Person Syndrome in a Patient", "M207", False, False, False),
        ("419. Some Title", "419", False, False, False),
        ("S-12. Some Title", "S-12", False, False, False),
        ("7. Some Title", "", False, False, False),
        ("Jane Doe, MD", "", True, False, False),
        ("Doe, Roe, Poe, Moe", "", True, False, False),
        ("Doe, J; Roe", "", True, False, False),
        ("over a thousand samples were read", "", False, True, False),
        ("Annals of Neurology Vol 92", "", False, False, True),
    ],
)
def test_line_classes(spark, line, start, author, institution, footer):
    df = proceedings.classify(spark.createDataFrame([("p", 0, 0, line)], "paper_id string, page_index int, line_index int, text string"))
    r = df.withColumn("code", F.regexp_extract("text", proceedings.ABSTRACT_START, 1)).first()
    assert (r["code"], r["is_start"], r["is_author"], r["is_institution"], r["is_footer"]) == (start, bool(start), author, institution, footer)


# n_pages, starts, title-like, author-like, markers, detected
GOLDEN = [
    (243, 423, 657, 2168, 3, True), (1, 0, 61, 6, 0, False), (1, 0, 30, 2, 0, False), (280, 460, 477, 2328, 3, True), (7, 1, 156, 24, 0, False),
    (2, 0, 103, 17, 0, False), (5, 22, 275, 58, 0, False), (9, 6, 400, 36, 0, False), (5, 23, 317, 31, 0, False), (11, 63, 744, 68, 0, False),
]


def test_proceedings_rule(spark):
    df = spark.createDataFrame(GOLDEN, "n int, s int, t int, a int, m int, want boolean")
    got = df.select("want", proceedings.proceedings_rule(F.col("n"), F.col("s"), F.col("t"), F.col("a"), F.col("m")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def volume(target: int, n: int = 45):
    pages = []
    for i in range(n):
        title = "A rare case of stiff limb syndrome\nwith progressive gait trouble" if i == target else f"Report number {'abcdefghij'[i % 10] * 3} about something else"
        author = "Jane Doe, MD" if i == target else f"Person {i}, PhD"
        pages.append((i, f"{i + 100}. {title}\n{author}\nThe body of item {i}.\nTerms and Conditions apply\n\n"))
    return pages


def test_trim(spark):
    records = spark.createDataFrame(
        [("12", "12_a.pdf", "h", 45, volume(17)), ("13", "13_b.pdf", "h", 2, volume(1, 2)), ("14", "14_c.pdf", "h", 45, [(i, "poster sessions text") for i in range(45)]), ("15", None, None, None, None)],
        "paper_id string, source_filename string, source_sha256 string, n_pages int, pages array<struct<page_index:int,text:string>>",
    )
    refs = spark.createDataFrame([("12", "A rare case of stiff limb syndrome with progressive gait trouble", "Doe, J"), ("14", "x", "y")], "paper_id string, title string, authors string")
    trimmed, rows = pipelines.run_trim(records, refs)
    rows = {r["paper_id"]: r for r in rows.collect()}
    assert [rows[k]["trim_status"] for k in ("12", "13", "14", "15")] == ["trimmed_auto", "not_needed", "manual_review_required", "not_needed"]
    r = rows["12"]
    assert (r["matched_block_code"], r["title_score"], r["author_score"], r["match_score"], r["start_page_index"]) == ("117", "1.0000", "1.0000", "1.0000", "17")
    assert r["abstract_block_count"] == "40" and r["proceedings_detected"] == "true"
    assert set(rows["12"].asDict()) == set(proceedings.DECISION_COLUMNS)
    t = trimmed.collect()
    assert len(t) == 1 and t[0]["n_pages"] == 1 and t[0]["original_n_pages"] == 45
    assert t[0]["pages"][0]["text"] == "117. A rare case of stiff limb syndrome\nwith progressive gait trouble\nJane Doe, MD\nThe body of item 17."
    assert t[0]["page_char_counts"] == [len(t[0]["pages"][0]["text"])]


def test_best_block_takes_the_earliest_of_equals(spark):
    df = spark.createDataFrame([("p", 2, 0.5), ("p", 1, 0.5), ("p", 3, 0.4)], "paper_id string, block_no int, match_score double")
    assert proceedings.best_blocks(df).first()["block_no"] == 1


def test_screen(spark):
    pages = [(i, "Filler text of a page") for i in range(44)] + [(44, "The Target Title appears here\x01\x02\x03\x04\x05")]
    records = spark.createDataFrame(
        [("1", "1_program.pdf", 45, [10] * 45, pages), ("2", "2_x.pdf", 1, [5], [(0, "ab\x01\x02\x03\x04\x05")]), ("3", None, 0, None, None)],
        "paper_id string, source_filename string, n_pages int, page_char_counts array<int>, pages array<struct<page_index:int,text:string>>",
    )
    refs = spark.createDataFrame([("1", "Target title", "Annual Meeting")], "Covidence string, Title string, Journal string")
    got = {r["paper_id"]: r for r in screening.screen(records, refs).collect()}
    assert set(got["1"].asDict()) == set(screening.COLUMNS)
    assert (got["1"]["screen_status"], got["1"]["title_first_page"], got["1"]["title_word_hits"], got["1"]["program_marker_count"], got["1"]["abstract_code_marker_count"]) == ("manual_trim_recommended", "44", "2/2", "2", "0")
    assert got["2"]["screen_status"] == "review_text_quality" and got["2"]["title_word_hits"] == "" and got["2"]["title_exact_match"] == "false"
    assert got["3"]["screen_status"] == "ok" and got["3"]["n_pages"] == "" and got["3"]["total_chars"] == "0"


def test_summaries(spark):
    rows = [("p", 0, "a", " x "), ("p", 1, "a", "x"), ("p", 2, "a", "y"), ("p", 3, "a", "z"), ("p", 4, "a", "w"), ("p", 5, "b", ""), ("p", 6, "c", "no")]
    e = spark.createDataFrame(rows, "paper_id string, pos int, extraction_class string, extraction_text string")
    papers = spark.createDataFrame([("p",), ("q",)], "paper_id string")
    got = {r["paper_id"]: r for r in summaries.render(summaries.section_snippets(e, ["a", "b"]), papers, {"a": "Alpha", "b": "Beta"}).collect()}
    assert got["p"]["overall_summary"] == "Alpha: x y z Beta: Not stated."
    assert got["q"]["section_summaries"] == {"a": "Not stated.", "b": "Not stated."}
    assert list(summaries.modes()) == ["individual", "group"] and list(summaries.modes(group_only=True)) == ["group"]


def failing_reader(content: bytes) -> list[str]:
    if content.startswith(b"BAD"):
        raise ValueError("unreadable")
    return content.decode().split("\f")


def fake_ocr(content: bytes, mode: str) -> bytes:
    if b"fail" in content:
        raise RuntimeError("ocr failed")
    return b"A page of text that is long enough to count as text, surely."


def test_text_records(spark):
    files = spark.createDataFrame([("/d/1_a.pdf", bytearray(b"x\fy")), ("/d/2_b.pdf", bytearray(b"BAD")), ("/d/3_c.pdf", bytearray(b"fail")), ("/d/4_d.pdf", bytearray(b"word " * 30))], "path string, content binary")
    got = {r["paper_id"]: r for r in extraction.text_records(files, failing_reader, fake_ocr).collect()}
    assert got["1"]["ocr_applied"] and got["1"]["ocr_mode"] == "skip-text" and got["1"]["n_pages"] == 1 and not got["1"]["needs_ocr"]
    assert got["2"]["error"] == "unreadable"
    assert not got["3"]["ocr_applied"] and got["3"]["ocr_error"] == "ocr failed" and got["3"]["ocr_mode"] == "skip-text" and got["3"]["needs_ocr"]
    assert got["4"]["ocr_mode"] == "" and not got["4"]["needs_ocr_before_ocr"]


def test_extract_and_assess(spark):
    records = spark.createDataFrame([("1", [(0, "value: 1 end. note: abc")]), ("2", [(0, "  ")])], PAGES)
    rules = extraction.RuleExtractor((("individual_presentation", r"value: \d"), ("group_design", "note: [a-z]+")))
    told, status = pipelines.run_extract(records, rules, {})
    assert {r["paper_id"]: r["status"] for r in status.collect()} == {"1": "processed", "2": "failed"}
    by_mode = {r["mode"]: r for r in told.collect()}
    assert by_mode["individual"]["section_summaries"]["individual_presentation"] == "value: 1" and by_mode["group"]["extraction_count"] == 2
    done = spark.createDataFrame([("1",)], "paper_id string")
    _, again = pipelines.run_extract(records, rules, {}, done=done)
    assert {r["paper_id"]: r["status"] for r in again.collect()} == {"1": "skipped", "2": "failed"}
    _, dry = pipelines.run_extract(records, rules, {}, dry_run=True)
    assert {r["paper_id"]: r["status"] for r in dry.collect()} == {"1": "validated", "2": "failed"}


def test_each_text_meets_the_extractor_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def counted(text: str, prompt: str) -> list[dict]:
        import uuid

        (calls / uuid.uuid4().hex).write_text(text)
        return [{"extraction_class": "group_design", "extraction_text": text, "alignment_status": None}]

    records = spark.createDataFrame([("1", [(0, "one")]), ("2", [(0, "two")])], PAGES)
    for n, passes in ((2, 1), (6, 2)):
        told, status = pipelines.run_extract(records, counted, {}, group_only=True, chunking=extraction.Chunking(passes=passes))
        assert told.count() == 2 and status.count() == 2 and len(list(calls.iterdir())) == n


def test_quality_records(spark):
    specs = spark.createDataFrame([(0, "Case Control", "f1", "", "", "", "binary_ordinal", []), (1, "Case Control", "f2", "", "", "", "string", ["NA"])], "ord int, publication_type string, field string, section string, criterion_text string, entry_guidance string, inferred_type string, accepted array<string>")
    records = spark.createDataFrame([("1", [(0, "a case-control study; f1=1 :: yes")]), ("2", [(0, "nothing to see")])], PAGES)
    rules = extraction.RuleExtractor((("f1", r"1 :: yes"), ("zz", "study")))
    schema = {"properties": {"f1": {"type": "string", "enum": ["0"]}}}
    good = {r["paper_id"]: r for r in pipelines.run_quality(records, specs, rules).collect()}
    assert good["1"]["values"] == {"f1": "1", "f2": "NA"} and good["1"]["missing_fields"] == ["f2"] and good["1"]["evidence"]["f1"] == ["1 :: yes"]
    assert good["2"]["status"] == "failed"
    bad = {r["paper_id"]: r for r in pipelines.run_quality(records, specs, rules, schema).collect()}
    assert bad["1"]["status"] == "failed" and "not in enum" in bad["1"]["error"]


SCHEMA = {
    "type": "object", "required": ["a"], "additionalProperties": False,
    "properties": {"a": {"type": "string"}, "n": {"type": "integer", "minimum": 0, "maximum": 6}, "u": {"anyOf": [{"type": "integer"}, {"enum": ["NA"]}]}, "l": {"type": "array", "items": {"type": "number"}, "uniqueItems": True}, "p": {"type": "string", "pattern": "^[A-Z]{2}$"}},
}


@pytest.mark.parametrize(
    ("value", "count"),
    [({"a": "x"}, 0), ({}, 1), ({"a": "x", "z": 1}, 1), ({"a": "x", "n": True}, 1), ({"a": "x", "n": 7}, 1), ({"a": "x", "u": "NA"}, 0), ({"a": "x", "u": "no"}, 1), ({"a": "x", "l": [1, 1, "q"]}, 2), ({"a": 1, "p": "xyz"}, 2), ([], 1)],
)
def test_validator(value, count):
    assert len(validation.Validator(SCHEMA)(value)) == count


def test_compiled_schema_agrees(spark):
    import json

    rows = [("x", 3, "AB"), (None, 9, "abc"), ("y", -1, None), ("z", None, "QQ")]
    df = spark.createDataFrame(rows, "a string, n int, p string")
    schema = {**SCHEMA, "additionalProperties": True}
    compiled = [r[0] for r in df.select(validation.compile_schema(schema, df.schema)).collect()]
    for got, (a, n, p) in zip(compiled, rows, strict=True):
        assert got == validation.Validator(schema)({k: v for k, v in zip("anp", (a, n, p), strict=True) if v is not None})
    nested = validation.nested_errors(spark.createDataFrame([(json.dumps({"a": 1}),), ("no json",), (None,)], "j string"), "j", SCHEMA).collect()
    assert [len(r["errors"]) for r in nested] == [1, 1, 1]
    many = spark.range(1).select(validation.error_text(F.array(*[F.lit(f"e{i}") for i in range(14)]))).first()[0]
    assert many.endswith("e11 (and 2 more)")


def test_artifact_registry(spark):
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    rows = registry.artifact_registry(
        references=df([("10", " T "), ("9", "U")], "id string, Title string"),
        manifest=df([("9", "failed", "e")], "id string, status string, error string"),
        pdfs=df([("10", ["/r/10_a.pdf", "/r/10_b.pdf"])], "id string, paths array<string>"),
        text=df([("10", "/r/t/10.json", 0, False), ("x1", "/r/t/x1.json", 5, True)], "id string, path string, n_pages int, needs_ocr boolean"),
        trimmed=df([("10", "/r/u/10.json", 0, 1.0)], "id string, path string, start_page_index int, match_score double"),
        trim_rows=df([("10", "trimmed_auto", "7", "0.9000")], "id string, trim_status string, start_page_index string, match_score string"),
        raw=df([], "id string, path string"),
        summaries=df([], "id string, path string"),
        quality_raw=df([], "id string, path string"),
        quality_records=df([("x1", ["a", "b"])], "id string, missing_fields array<string>"),
        root="/r",
    ).collect()
    assert [r["paper_id"] for r in rows] == ["9", "10", "x1"]
    nine, ten, x1 = rows
    assert len(ten) == 69
    assert (nine["download_status"], nine["reference_match_status"], nine["quality_missing_field_count"]) == ("failed", "matched_reference", "0")
    assert (ten["title"], ten["pdf_filenames"], ten["text_n_pages"], ten["text_needs_ocr"], ten["text_trim_start_page"], ten["text_trim_match_score"]) == ("T", "10_a.pdf | 10_b.pdf", "", "", "7", "1.0")
    assert ten["artifact_types_present"] == "reference; pdf; text; text_trimmed"
    assert (x1["reference_match_status"], x1["text_needs_ocr"], x1["quality_missing_field_count"], x1["download_status"]) == ("orphan_artifact", "True", "2", "missing")


def test_source_registry(spark):
    refs = spark.createDataFrame([(" 1 ", "A", 0), ("1", "B", 1), ("2", "C", 2), ("3", "D", 3)], "Covidence string, Title string, _pos int")
    files = spark.createDataFrame([("1", ["/d/1_a.pdf"]), ("2", ["/d/2_a.pdf", "/d/2_b.pdf"]), ("8", ["/d/8_a.pdf"])], "id string, paths array<string>")
    others = spark.createDataFrame([("/d/abc_x.pdf",)], "path string")
    log = spark.createDataFrame([("3", "failed", "", "", "why")], "covidence_id string, status string, method string, download_url string, error string")
    got = [(r["covidence_id"], r["title"], r["pdf_filename"], r["download_status"]) for r in registry.source_registry(refs, files, others, log).collect()]
    assert got == [("1", "A", "1_a.pdf", "downloaded"), ("1", "B", "", "missing"), ("2", "C", "2_a.pdf | 2_b.pdf", "multiple_local_files"), ("3", "D", "", "failed"), ("8", "", "8_a.pdf", "unmatched_local_file"), ("", "", "abc_x.pdf", "unmatched_local_file")]


def test_cascade(spark):
    a = spark.createDataFrame([(1, "D1", "T one"), (2, "", "T Two"), (3, "", "none")], "id int, doi string, title string")
    b = spark.createDataFrame([(11, " d1", "x"), (12, "", "t two!"), (13, "", "t one")], "id int, doi string, title string")
    assert {tuple(r) for r in registry.cascade_match(a, b).collect()} == {(1, 11, "doi"), (2, 12, "title")}


def test_acquisition(spark):
    df = spark.createDataFrame([('a<b>:"c".',), ("x.PDF",), ("",), ("n. ",)], "f string")
    assert [r[0] for r in df.select(acquisition.sanitize_filename(F.col("f"))).collect()] == ["a_b___c_.pdf", "x.PDF", ".pdf", "n.pdf"]
    page = spark.createDataFrame([(1, "http://h/a/b.html?x=1", '<a href="c%20d.pdf?q=1">get</a><a class=z href=/e/f>Full Text.pdf</a><a href="https://o/x">y</a>')], "id int, url string, html string")
    got = [(r["url"], r["filename"], r["is_pdf"]) for r in acquisition.links(page, "id", "url", "html").orderBy("pos").collect()]
    assert got == [("http://h/a/c%20d.pdf?q=1", "c d.pdf", True), ("http://h/e/f", "Full Text.pdf", True), ("https://o/x", "x.pdf", False)]
    cards = acquisition.cards(spark.createDataFrame([(1, "#  77\n2020\nView full text\nThe label\nmore"), (2, "# 77 again\nother"), (3, "no id")], "id int, text string"))
    assert [tuple(r) for r in cards.collect()] == [("77", "The label")]
    present = spark.createDataFrame([("77", ["/d/77_a.pdf"])], "id string, paths array<string>")
    assert acquisition.to_fetch(cards, present).count() == 0 and acquisition.skipped_rows(cards, present).first()["status"] == "skipped_existing"


def test_markers_compat():
    assert "home | login" in screening.markers(DEFAULT.chrome_markers, DEFAULT)
    from dataclasses import replace

    assert "home login" in screening.markers(DEFAULT.chrome_markers, replace(DEFAULT, compat=False))


def test_detect_type_joins_types_not_texts(spark):
    found = spark.createDataFrame([("1", 0, "publication_type", "cohort")], "paper_id string, pos int, extraction_class string, extraction_text string")
    texts = spark.createDataFrame([("1", "a case control study"), ("2", "a case control study"), ("3", "none")], "paper_id string, text string").repartition(2)
    told = assessment.detect_type(found, texts, ["Case Control", "Cohort"])
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan and "Contains(" not in plan.split("Join ")[0]
    assert {(r["paper_id"], r["publication_type"]) for r in told.collect()} == {("1", "Cohort"), ("2", "Case Control"), ("3", None)}
