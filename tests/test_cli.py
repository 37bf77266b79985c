import csv
import functools
import json
import shutil

import pytest

from leafmill.operators.extraction import RuleExtractor
from leafmill.plans import pipelines
from leafmill.sources import sinks

RULES = RuleExtractor((("individual_presentation", r"value: \d"), ("f1", r"1 :: yes"), ("zz", "study")))


def picky(text: str, prompt: str) -> list[dict]:
    """Tells the prompt it was asked with; one text is too much for it."""
    if "boom" in text:
        raise ValueError("no answer")
    return [{"extraction_class": "f2" if "Study type" in prompt else "publication_type", "extraction_text": prompt[:30] if "Study type" in prompt else "case control", "alignment_status": None}]


def lines(path):
    return {r["paper_id"]: r for f in sorted(path.rglob("part-*.json")) for r in map(json.loads, f.read_text().splitlines())}


def registry_rows(path):
    return {r["paper_id"]: r for f in sorted(path.glob("part-*.csv")) for r in csv.DictReader(f.open())}


@pytest.fixture
def work(tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files/1_a.txt").write_text("a case-control study; value: 1, 1 :: yes\fsecond page " + "of text " * 20)
    (tmp_path / "files/2_b.txt").write_text("a case-control study, boom " + "of text " * 20)
    (tmp_path / "dict.csv").write_text("publication_type,field,section,criterion_text,entry_guidance,inferred_type,accepted\nCase Control,f1,s,c,g,binary_ordinal,0;1\nCase Control,f2,s,c,g,string,NA\n")
    return tmp_path


def test_commands(spark, work, capsys):
    run = lambda *a: pipelines.main([str(x) for x in a])
    known = ["--artifact", f"text={work}/text", "--artifact", f"summary={work}/summary", "--artifact", f"langextract={work}/raw", "--artifact", f"quality_record={work}/quality", "--artifact", f"quality_raw={work}/qraw", "--artifact-registry", f"{work}/registry"]
    run("text", "--files", work / "files", "--pattern", "*.txt", "--out", work / "text", *known)
    assert lines(work / "text")["1"]["n_pages"] == 2
    assert registry_rows(work / "registry")["2"]["artifact_types_present"] == "text"
    extract = ("extract", "--records", work / "text", "--extractor", "test_cli:RULES", "--out", work / "summary", "--raw-out", work / "raw", "--model-id", "rules")
    run(*extract, "--dry-run")
    assert not (work / "summary").exists()
    run(*extract, "--ids", "1", *known)
    got = lines(work / "summary")
    assert set(got) == {"1"} and got["1"]["model_id"] == "rules" and got["1"]["extraction_modes"]["individual"]["section_summaries"]["individual_presentation"] == "value: 1"
    assert lines(work / "raw")["1"]["extraction_modes"]["group"]["extraction_count"] == 3 and got["1"]["total_extraction_count"] == 6
    capsys.readouterr()
    run(*extract, *known)  # only what is not finished
    assert "'processed': 1" in (said := capsys.readouterr().out) and "'skipped': 1" in said
    assert set(lines(work / "summary")) == {"1", "2"} and sum(len(f.read_text().splitlines()) for f in (work / "summary").rglob("part-*.json")) == 2
    assert registry_rows(work / "registry")["1"]["artifact_types_present"].startswith("text")
    quality = ("quality", "--records", work / "text", "--dictionary", work / "dict.csv", "--extractor", "test_cli:picky", "--out", work / "quality", "--raw-out", work / "qraw")
    with pytest.raises(SystemExit):
        run(*quality, *known)
    assert set(lines(work / "quality")) == {"1"}  # the other failed, and the registry was rebuilt all the same
    assert registry_rows(work / "registry")["1"]["quality_missing_field_count"] == "1"
    raw = lines(work / "qraw")["1"]
    assert raw["publication_type"] == "Case Control" and raw["publication_type_detections"][0]["extraction_text"] == "case control" and raw["unmatched_extractions"] == []
    assert raw["extractions"][0]["extraction_text"].startswith("Study type: Case Control")
    run("registry", *known)
    with pytest.raises(SystemExit):
        run("trim", "--out", work / "x")


def test_each_file_is_read_once(spark, tmp_path):
    for d in ("files", "marks"):
        (tmp_path / d).mkdir()
    for k in range(7):
        (tmp_path / f"files/{k}_x.txt").write_text("b" if k == 5 else f"text of {k}")
    reader = functools.partial(_marked, str(tmp_path / "marks"))
    for n in (7, 14):  # into a new folder, then in place of its records
        with pytest.raises(sinks.RunFailed, match="1 of 7"):
            pipelines.run_text(spark, f"{tmp_path}/files", f"{tmp_path}/out", reader, pattern="*.txt")
        assert len(list((tmp_path / "marks").iterdir())) == n and set(lines(tmp_path / "out")) == set("012346")


def _marked(folder, content):
    import uuid
    from pathlib import Path

    Path(folder, uuid.uuid4().hex).write_bytes(content[:1])
    if content[:1] == b"b":
        raise ValueError("not a file")
    return content.decode().split("\f")


def record_lines(path):
    return sorted((r["paper_id"], r["model_id"]) for f in path.rglob("part-*.json") for r in map(json.loads, f.read_text().splitlines()))


def test_runs_replace_records(spark, tmp_path):
    """--force with ids changes these only; a run that died between its two outputs, or lost one, leaves no doubles when it is repeated."""
    (tmp_path / "files").mkdir()
    for k in (1, 2, 3):
        (tmp_path / f"files/{k}_a.txt").write_text(f"paper {k}; value: {k}")
    run = lambda *a: pipelines.main([str(x) for x in a])
    run("text", "--files", tmp_path / "files", "--pattern", "*.txt", "--out", tmp_path / "text")
    extract = ("extract", "--records", tmp_path / "text", "--extractor", "test_cli:RULES", "--out", tmp_path / "out", "--raw-out", tmp_path / "raw", "--model-id")
    both = lambda: (record_lines(tmp_path / "out"), record_lines(tmp_path / "raw"))
    run(*extract, "m1")
    assert both() == ([(str(k), "m1") for k in (1, 2, 3)],) * 2
    run(*extract, "m2", "--force", "--ids", "2")
    assert both() == ([("1", "m1"), ("2", "m2"), ("3", "m1")],) * 2
    shutil.rmtree(tmp_path / "raw")  # finished papers are those in both
    run(*extract, "m3")
    assert both() == ([(str(k), "m3") for k in (1, 2, 3)],) * 2
    shutil.rmtree(tmp_path / "out")  # raw was written, the other was not
    run(*extract, "m4", "--ids", "1", "3")
    assert both() == ([("1", "m4"), ("3", "m4")], [("1", "m4"), ("2", "m3"), ("3", "m4")])
    run(*extract, "m5")
    assert both() == ([("1", "m4"), ("2", "m5"), ("3", "m4")],) * 2


def test_trimmed_records_vanish(spark, tmp_path):
    """A volume that is no longer trimmed loses its record; volumes that a run leaves out keep theirs."""
    words = "cardiac imaging of young athletes in regional hospitals"
    pages = lambda title: [(i, f"{100 + i}. {title if i == 7 else f'Another abstract number {i} about other things'}\nSmith J, MD; Jones K, MD\nBody text") for i in range(45)]
    ddl = "paper_id string, source_filename string, source_sha256 string, n_pages int, pages array<struct<page_index int, text string>>"
    volume = lambda *of: spark.createDataFrame([(p, "v.pdf", "h", 45, pages(t)) for p, t in of], ddl)
    refs = spark.createDataFrame([(p, words, "Smith, J; Jones, K") for p in ("1", "2")], "paper_id string, title string, authors string")
    out = tmp_path / "trimmed"
    pipelines.run_trim(volume(("1", words), ("2", words)), refs, f"{out}")
    assert set(lines(out)) == {"1", "2"} and lines(out)["1"]["start_page_index"] == 7
    pipelines.run_trim(volume(("1", "Something else entirely that no one asked for")), refs, f"{out}")
    assert set(lines(out)) == {"2"}


def test_given_type_asks_once(spark, work):
    from leafmill.sources import tables

    records = spark.createDataFrame([("1", [(0, "text")]), ("2", [(0, " ")])], "paper_id string, pages array<struct<page_index int, text string>>")
    specs = tables.read_dictionary(spark, f"{work}/dict.csv")
    rows = {r["paper_id"]: r for r in pipelines.run_quality(records, specs, picky, override="Case Control").collect()}
    assert rows["1"]["status"] == "processed" and rows["1"]["values"]["f2"].startswith("Study type") and rows["2"]["error"] == "no extractable text"
    again = {r["paper_id"]: r["status"] for r in pipelines.run_quality(records, specs, picky, override="Case Control", done=spark.createDataFrame([("1",)], "paper_id string")).collect()}
    assert again == {"1": "skipped", "2": "failed"}
