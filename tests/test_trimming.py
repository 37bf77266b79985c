"""The trimming queries row by row against the standard library, from blocks that test_queries.py compares with SQL."""

import random
import re

import plain
import pytest
from pyspark.sql import functions as F

from leafmill.config import DEFAULT, TRIM_METHOD, TRIM_REASONS
from leafmill.operators import proceedings
from leafmill.plans import testdata


@pytest.fixture(scope="module")
def decided(spark, sf):
    """For each volume: its signals and its best block, scored in Python."""
    lines = testdata._lines(spark, sf)
    refs = {r["paper_id"]: r for r in testdata._volume_references(spark, sf).collect()}
    told = {r["paper_id"]: r.asDict() for r in proceedings.signals(lines, testdata._volumes(spark, sf)).collect()}
    best = {}
    for b in proceedings.blocks(proceedings.block_lines(lines)).orderBy("paper_id", "block_no").collect():
        ref = refs[b["paper_id"]]
        title, author = plain.title_score(ref["title"] or "", b["title_text"]), plain.author_score(ref["authors"] or "", b["preview_text"])
        match = 0.75 * title + 0.25 * author
        if b["paper_id"] not in best or match > best[b["paper_id"]][1] + 1e-12:
            best[b["paper_id"]] = (b.asDict(), match, title, author)
    return told, best, refs


def status(told, best):
    if not told["proceedings_detected"]:
        return "not_needed", TRIM_REASONS["no_volume"]
    if best is None:
        return "manual_review_required", TRIM_REASONS["no_block"]
    _, match, title, author = best
    good = title >= 0.70 or (title >= 0.55 and author >= 0.25 and match >= 0.60)
    return ("trimmed_auto", TRIM_REASONS["matched"]) if good else ("manual_review_required", TRIM_REASONS["low_match"])


def test_trim_decisions(spark, sf, decided):
    told, best, refs = decided
    got = {r["paper_id"]: r.asDict() for r in testdata.q_trim_decisions(spark, sf).collect()}
    assert set(got) == set(told)
    for key, row in got.items():
        state, reason = status(told[key], best.get(key))
        seen = state != "not_needed" and key in best
        block, match, title, author = best.get(key, ({}, 0, 0, 0))
        want = {
            "paper_id": key, "covidence_id": key, "title": (refs[key]["title"] or "").strip(), "authors": (refs[key]["authors"] or "").strip(), "source_filename": "", "source_text_json_path": "",
            "trimmed_text_json_path": f"text_trimmed/{key}.json" if state == "trimmed_auto" else "", "proceedings_detected": str(told[key]["proceedings_detected"]).lower(), "trim_status": state, "trim_reason": reason,
            "trim_method": TRIM_METHOD if state == "trimmed_auto" else "",
        } | {c: str(told[key][c]) for c in ("n_pages", "abstract_block_count", "title_like_line_count", "author_like_line_count", "program_marker_count")}
        want |= {"matched_block_code": block["code"], "matched_block_title": block["title_text"], "start_page_index": str(block["start_page_index"]), "end_page_index": str(block["end_page_index"])} if seen else dict.fromkeys(["matched_block_code", "matched_block_title", "start_page_index", "end_page_index"], "")
        want |= {c: f"{x:.4f}" if seen else "" for c, x in (("title_score", title), ("author_score", author), ("match_score", match))}
        assert row == want
    assert "trimmed_auto" in {r["trim_status"] for r in got.values()}


def test_trimmed_pages(spark, sf, decided):
    told, best, _ = decided
    numbered = proceedings.block_lines(testdata._lines(spark, sf))
    chosen = {k: best[k][0]["block_no"] for k in told if status(told[k], best.get(k))[0] == "trimmed_auto"}
    want: dict = {}
    for r in numbered.orderBy("paper_id", "idx").collect():
        if chosen.get(r["paper_id"]) == r["block_no"] and not r["is_footer"]:
            want.setdefault((r["paper_id"], r["page_index"]), []).append(r["text"])
    got = {(r["paper_id"], r["page_index"]): r["text"] for r in testdata.q_trimmed_pages(spark, sf).collect()}
    assert got == {k: "\n".join(v).strip() for k, v in want.items() if "\n".join(v).strip()}


def test_title_scores(spark, sf):
    items = sorted((r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["title_score"] for r in testdata.q_title_scores(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, score in got.items():
        assert score == pytest.approx(plain.title_score(items[i % len(items)][1], texts[i] or ""), abs=2e-6)


def test_best_match_equals_scoring_every_block(spark):
    blocks = [("v", k, t, p) for k, (t, p) in enumerate([("alpha beta gamma delta", "Ray"), ("alpha beta gamma", "Lee Ray"), ("beta alpha delta gamma words", ""), ("", "Ray"), ("alpha beta gamma delta", "Ray"), ("zzz", "Lee")], 1)]
    blocks += [("w", 1, "nothing alike", ""), ("w", 2, "something alike", ""), ("x", 1, "no reference", "y")]
    refs = spark.createDataFrame([("v", "Alpha beta gamma delta words", "Ray, A; Lee, B"), ("w", "Quite another one", "")], "paper_id string, title string, authors string")
    found = spark.createDataFrame(blocks, "paper_id string, block_no int, title_text string, preview_text string")
    for cut in (found, found.where("block_no > 1"), found.where("block_no < 4")):
        want = proceedings.best_blocks(proceedings.score_blocks(cut, refs)).orderBy("paper_id").collect()
        assert proceedings.best_match(cut, refs).orderBy("paper_id").collect() == want


def test_long_integers(spark):
    from leafmill.functions import values

    digits = "1234567890123456789012345"
    rows = spark.createDataFrame([("integer", f"n = {digits}"), ("integer_or_string_id", digits), ("integer", "n = -12 of 20")], "k string, raw string")
    v = rows.select(values.normalise_value(F.col("raw"), F.col("k"), F.array().cast("array<string>")).alias("v")).select("v.*").collect()
    assert [(r["s"], r["i"]) for r in v] == [(digits, None), (digits, None), (None, -12)]
    assert DEFAULT.thresholds.title_weight == 0.75


def test_segmentation_scans_pages(spark):
    """Blocks over pages, pages without starts or lines, page indexes that repeat; no window takes the lines of a volume."""
    r = random.Random(4)
    line = lambda k: r.choice([f"{100 + k}. Title of {k}", "Smith J, MD", "more words of a title here", "University of X", "plain body", "", "  "])
    volumes = {str(v): [(r.choice((i, i, max(0, i - 1))), "\n".join(line(100 * v + 7 * i + k) for k in range(r.randrange(0, 9)))) for i in range(30)] for v in range(4)}
    df = spark.createDataFrame(list(volumes.items()), "paper_id string, pages array<struct<page_index int, text string>>")
    lines = proceedings.classify(proceedings.flatten_lines(df))
    want = {}
    for v, pages in volumes.items():
        block = rn = idx = 0
        for pos, (_, text) in enumerate(pages):
            for k, raw in enumerate(text.split("\n")):
                t = " ".join(raw.split())
                if not t:
                    continue
                start = t[:1].isdigit()
                block, rn = (block + 1, 1) if start else (block, rn + 1)
                if block:
                    want[v, pos, k] = (block, idx, rn)
                idx += 1
    numbered = proceedings.block_lines(lines)
    assert {(x["paper_id"], x["page_pos"], x["line_index"]): (x["block_no"], x["idx"], x["rn"]) for x in numbered.collect()} == want
    plan = proceedings.blocks(numbered)._jdf.queryExecution().optimizedPlan().toString()
    specs = [re.search(r", \[([^\[\]]*)\], \[([^\[\]]*)\]$", w).groups() for w in plan.split("\n") if "Window [" in w]
    assert len(specs) >= 4 and all("page_pos" in by if "line_index" in order or "_line" in order else "page_pos" in order for by, order in specs)


def test_blocks_classify_their_first_lines_only(spark):
    """Lines of starts() give the blocks of classified ones, whatever stands in lines that no title or preview takes."""
    kinds = ["A. Doe, B. Roe, C. Poe, D", "University of X", "terms and conditions", "A plain title line here", "Jane Roe, m.d.", "x"]
    rows = [("v", p, i, "P-101. A title of some words" if i % 17 == 2 else kinds[(i * 7 + p) % 6]) for p in range(3) for i in range(40)]
    lines = spark.createDataFrame(rows, "paper_id string, page_index int, line_index int, text string")
    short = proceedings.blocks(proceedings.block_lines(proceedings.starts(lines)))
    assert sorted(short.collect()) == sorted(proceedings.blocks(proceedings.block_lines(proceedings.classify(lines))).collect()) and short.count() == 9
