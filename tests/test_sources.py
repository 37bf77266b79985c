import json

import pytest
from pyspark.sql import functions as F

from leafmill import schemas
from leafmill.sources import sinks, tables
from leafmill.streaming import manifest


def test_keyed_csv(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('Covidence,Title\n 1 ,first\n1,"second, ""quoted""\nline"\n,blank\n2,two\n')
    got = {r["Covidence"]: r["Title"] for r in tables.keyed_csv(spark, str(p), "Covidence").collect()}
    assert got == {"1": 'second, "quoted"\nline', "2": "two"}
    assert tables.keyed_csv(spark, str(tmp_path / "none.csv"), "Covidence", ("Title",)).columns == ["Covidence", "Title"]


def test_latest_events(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"covidence_id":"1","status":"failed"}\n\n{"covidence_id":"","status":"x"}\n{"covidence_id":"1","status":"downloaded","method":"direct_fetch"}\n')
    assert [(r["covidence_id"], r["status"], r["method"]) for r in tables.latest_events(spark, str(p)).collect()] == [("1", "downloaded", "direct_fetch")]
    p.write_text("{broken\n")
    with pytest.raises(Exception):
        tables.latest_events(spark, str(p)).collect()
    assert tables.latest_events(spark, str(tmp_path / "none")).count() == 0


def test_json_records_and_selection(spark, tmp_path):
    d = tmp_path / "text"
    d.mkdir()
    for i in ("1", "2", "10"):
        (d / f"{i}.json").write_text(json.dumps({"paper_id": i, "n_pages": 1, "pages": [{"page_index": 0, "text": "t" + i}]}, indent=2))
    r = tables.json_records(spark, str(d), schemas.TEXT_RECORD_DDL)
    assert [x["_stem"] for x in tables.select_inputs(r).collect()] == ["1", "10", "2"]
    assert [x["_stem"] for x in tables.select_inputs(r, [" 2 ", ""], 5).collect()] == ["2"]
    assert [x["_stem"] for x in tables.select_inputs(r, limit=2).collect()] == ["1", "10"]
    assert [x["id"] for x in tables.json_paths(spark, str(d)).collect()] == ["1", "10", "2"]
    t = tables.json_records(spark, str(tmp_path / "none"), schemas.TEXT_RECORD_DDL)
    assert not any(x["used_trimmed_text"] for x in tables.prefer_trimmed(r, t).collect())
    one = r.where("_stem = '2'").withColumn("pages", F.array(F.struct(F.lit(3).alias("page_index"), F.lit("cut").alias("text"))))
    got = {x["_stem"]: (x["used_trimmed_text"], x["pages"][0]["text"]) for x in tables.prefer_trimmed(r, one).collect()}
    assert got == {"1": (False, "t1"), "2": (True, "cut"), "10": (False, "t10")}


def test_files(spark, tmp_path):
    for n in ("12_a.pdf", "12_b.PDF", "12_c.pdf", "abc_x.pdf", "7.pdf"):
        (tmp_path / n).write_bytes(b"%PDF-1")
    files = tables.list_files(spark, str(tmp_path), "*.{pdf,PDF}")
    assert {r["id"]: len(r["paths"]) for r in tables.files_by_prefix(files).collect()} == {"12": 3, "abc": 1, "7": 1}
    named, others = tables.files_by_number(files)
    assert [(r["id"], len(r["paths"])) for r in named.collect()] == [("12", 3)] and others.count() == 2
    content = spark.read.format("binaryFile").load(str(tmp_path))
    assert content.where(tables.is_pdf(F.col("content"))).count() == 5
    assert len(tables.content_hash(content).first()["source_sha256"]) == 64


def test_dictionary_and_assets(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text("publication_type,field,section,criterion_text,entry_guidance,inferred_type,accepted\nT,f1,s,c,g,string,a; NA ;\n,f2,s,c,g,string,\nT,f3,s,,g,integer,\n")
    specs = tables.read_dictionary(spark, str(p)).orderBy("ord").collect()
    assert [(s["field"], s["accepted"]) for s in specs] == [("f1", ["a", "NA"]), ("f3", [])]
    (tmp_path / "e.csv").write_text("field\nx\n")
    with pytest.raises(ValueError, match="accepted"):
        tables.read_dictionary(spark, str(tmp_path / "e.csv"))
    assert tables.prompt_text(str(tmp_path / "none"), "d") == "d"
    (tmp_path / "x.json").write_text("{}")
    with pytest.raises(ValueError):
        tables.example_payload(str(tmp_path / "x.json"), [])
    ex = spark.createDataFrame([(" t ", [(" c ", " x "), ("", "y")]), ("u", [("", "")])], "text string, extractions array<struct<extraction_class:string,extraction_text:string>>")
    assert [(r["text"], len(r["extractions"])) for r in tables.clean_examples(ex).collect()] == [("t", 1)]
    ris = tmp_path / "r.ris"
    ris.write_text("TY  - JOUR\nAU  - Doe, J\nAU  - Roe, M\nTI  - One\nER  - \nTY  - JOUR\nTI  - Two\nER  - \n")
    assert [r["tags"].get("AU") for r in tables.read_ris(spark, str(ris)).orderBy("rec").collect()] == [["Doe, J", "Roe, M"], None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "é", None), ("2", "b", 3)], "paper_id string, t string, n int")
    sinks.export_documents(df, str(tmp_path / "docs"))
    assert json.loads((tmp_path / "docs/1.json").read_text()) == {"paper_id": "1", "t": "é", "n": None}
    sinks.write_registry(df, str(tmp_path / "reg"), ["t", "paper_id"])
    assert tables.read_csv(spark, str(tmp_path / "reg")).columns == ["t", "paper_id"]
    for _ in range(2):
        sinks.append_events(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    done = spark.createDataFrame([("1",)], "paper_id string")
    assert [r["paper_id"] for r in sinks.pending(df, done, done).collect()] == ["2"] and sinks.pending(df, done, force=True).count() == 2
    assert sinks.finish(df.withColumn("status", F.lit("processed"))) == {"processed": 2}
    with pytest.raises(sinks.RunFailed):
        sinks.finish(df.withColumn("status", F.lit("failed")))


def test_manifest_stream(spark, tmp_path):
    ddl = "covidence_id string, status string, finished_at_utc string"
    src, table, check = (str(tmp_path / x) for x in ("src", "table", "check"))
    rows = lambda *r: spark.createDataFrame(list(r), ddl).coalesce(1).write.mode("append").json(src)
    rows(("1", "failed", "2024-01-01"), ("2", "downloaded", "2024-01-01"))
    manifest.upsert_latest(manifest.events_stream(spark, src, ddl), table, check, "covidence_id", ["finished_at_utc"]).awaitTermination()
    rows(("1", "downloaded", "2024-01-02"), ("2", "failed", "2023-12-31"))
    manifest.upsert_latest(manifest.events_stream(spark, src, ddl), table, check, "covidence_id", ["finished_at_utc"]).awaitTermination()
    got = {r["covidence_id"]: r["status"] for r in manifest.read_latest(spark, table, ddl).collect()}
    assert got == {"1": "downloaded", "2": "downloaded"}
    assert manifest.read_latest(spark, str(tmp_path / "none"), ddl).count() == 0


def test_run_registry(spark, tmp_path):
    from leafmill.plans import pipelines

    (tmp_path / "refs.csv").write_text("Covidence,Title\n1,One\n3,Three\n")
    (tmp_path / "log.jsonl").write_text('{"covidence_id":"3","status":"failed","error":"e"}\n')
    for d in ("files", "text", "quality"):
        (tmp_path / d).mkdir()
    (tmp_path / "files/1_a.pdf").write_bytes(b"%PDF")
    (tmp_path / "text/1.json").write_text(json.dumps({"paper_id": "1", "n_pages": 2, "needs_ocr": True, "pages": []}))
    (tmp_path / "quality/x.json").write_text(json.dumps({"paper_id": "x", "missing_fields": ["a"]}))
    rows = pipelines.run_registry(spark, {"references": f"{tmp_path}/refs.csv", "manifest": f"{tmp_path}/log.jsonl", "files": f"{tmp_path}/files", "text": f"{tmp_path}/text", "quality_record": f"{tmp_path}/quality"}, root=str(tmp_path)).collect()
    got = [(r["paper_id"], r["download_status"], r["text_json_path"], r["text_n_pages"], r["text_needs_ocr"], r["quality_missing_field_count"], r["artifact_types_present"]) for r in rows]
    assert got == [("1", "downloaded", "text/1.json", "2", "True", "0", "reference; pdf; text"), ("3", "failed", "", "", "", "0", "reference"), ("x", "missing", "", "", "", "1", "quality_record")]


def test_written_records_are_read_as_a_whole(spark, tmp_path):
    from leafmill import schemas
    from leafmill.sources import sinks, tables

    rows = spark.createDataFrame([(str(i), f"{i}_a.pdf", i) for i in range(50)], "paper_id string, source_filename string, n_pages int")
    sinks.write_records(rows.coalesce(2), f"{tmp_path}/lines")
    got = tables.json_records(spark, f"{tmp_path}/lines", schemas.TEXT_RECORD_DDL)
    assert sorted((r["_stem"], r["n_pages"]) for r in got.collect()) == sorted((str(i), i) for i in range(50))
    assert [r["_stem"] for r in tables.select_inputs(got, ["7", "12"]).collect()] == ["12", "7"]
    sinks.export_documents(rows, f"{tmp_path}/files")
    assert tables.json_records(spark, f"{tmp_path}/files", schemas.TEXT_RECORD_DDL).count() == 50


def _held(spark, path):
    return sorted((r["paper_id"], r["n"]) for r in tables.json_records(spark, str(path), "paper_id string, n int").collect())


def _numbered(spark, *rows):
    return spark.createDataFrame(list(rows), "paper_id string, n int")


def test_records_are_replaced_by_key(spark, tmp_path):
    out = f"{tmp_path}/out"
    sinks.replace_records(_numbered(spark, *[(str(k), 1) for k in range(40)]), out, buckets=8)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "out").rglob("part-*")}
    sinks.replace_records(_numbered(spark, ("3", 2), ("99", 2)), out)
    want = {str(k): 1 for k in range(40)} | {"3": 2, "99": 2}
    assert dict(_held(spark, out)) == want and len(_held(spark, out)) == 41
    kept = {f for f in (tmp_path / "out").rglob("part-*") if before.get(f) == f.stat().st_mtime_ns}
    assert len({f.parent for f in before} - {f.parent for f in kept}) <= 2  # other buckets are as they were
    # keys of the run without a record: they keep their old one, or lose it
    ids = spark.createDataFrame([("3",), ("4",), ("5",)], "paper_id string")
    sinks.replace_records(_numbered(spark, ("4", 3)), out, ids=ids)
    assert dict(_held(spark, out)) == want | {"4": 3}
    sinks.replace_records(_numbered(spark, ("4", 4)), out, ids=ids, vanish=True)
    assert dict(_held(spark, out)) == {k: v for k, v in (want | {"4": 4}).items() if k not in ("3", "5")}
    every = spark.createDataFrame([(k,) for k in want], "paper_id string")
    sinks.replace_records(_numbered(spark, ("7", 9)), out, ids=every, vanish=True)  # buckets run empty
    assert _held(spark, out) == [("7", 9)]
    sinks.replace_records(_numbered(spark).limit(0), out)
    assert _held(spark, out) == [("7", 9)]


def test_a_flat_folder_is_laid_out_in_buckets(spark, tmp_path):
    out = f"{tmp_path}/out"
    sinks.write_records(_numbered(spark, ("1", 1), ("2", 1)), out)
    sinks.replace_records(_numbered(spark, ("2", 2), ("3", 2)), out)
    assert _held(spark, out) == [("1", 1), ("2", 2), ("3", 2)] and not list((tmp_path / "out").glob("part-*"))


def test_replacing_computes_records_once(spark, tmp_path):
    out, seen = f"{tmp_path}/out", spark.sparkContext.accumulator(0)

    def costly(pdfs):
        for pdf in pdfs:
            seen.add(len(pdf))
            yield pdf

    ids = _numbered(spark, *[(str(k), k) for k in range(20)])
    for k in range(3):
        df = ids.mapInPandas(costly, ids.schema)
        sinks.replace_records(df, out, ids=None if k == 2 else ids)
        assert seen.value == 20 * (k + 1)
    assert len(_held(spark, out)) == 20
