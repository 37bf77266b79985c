import brute
import corpus_pipeline
import pytest
from conftest import prose
from pyspark.sql import functions as F

from leafmill.llm import common, language, mixing


def test_run(spark, sf, doc_rows):
    out = corpus_pipeline.run(spark, sf).collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = language.identify(spark.read.parquet(f"{sf}/documents.parquet"), language.fit(spark.read.parquet(f"{sf}/documents.parquet")))
    told = {r["doc_id"] for r in found.collect() if not r["_lang_ambiguous"] or r["lang"] == r["_lang_pred"]}
    kept = [(i, t) for i, t in doc_rows if t and any(c.isalpha() for c in t) and i in told]
    part = brute.jaccard(kept, 5, 80)
    kept = [(i, t) for i, t in kept if part[i][1] == i]
    dirty = brute.decontaminate(kept, items)
    kept = {i: t for i, t in kept if not dirty[i][4]}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.where(docs["doc_id"].isin(list(kept)))
    counts = {r["doc_id"]: r["_mix_copies"] for r in mixing.replicate(docs).select("doc_id", "_mix_copies").distinct().collect()}
    got = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == counts
    for s in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_stages_take_odd_and_empty_rows(spark, odd, empty, tmp_path):
    sf_dir = f"file://{tmp_path}"
    spark.createDataFrame([(1, prose(3, 20))], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    for start in (odd, empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "sharding":
                assert out.columns == start.columns
            docs = common.materialise(out, name)
        assert docs.count() == 0 or start is odd
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, odd, sf_dir).collect()]
    assert 5 in kept and None in kept and not {6, 7, 8, 18} & set(kept)
    clean = [r["doc_id"] for r in corpus_pipeline.decontamination(spark, odd, sf_dir).collect()]
    assert 15 not in clean and 5 in clean
    spoken = [r["doc_id"] for r in corpus_pipeline.language_id(spark, odd, sf_dir).collect()]
    assert not {0, 1, 2, 16} & set(spoken) and {3, 4, 13} <= set(spoken)


def test_decontamination_tells_rows_by_id_and_text(spark, tmp_path):
    dirty, clean, sf_dir = prose(3, 20), prose(5, 20), f"file://{tmp_path}"
    spark.createDataFrame([(1, dirty)], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [(None, "x " + dirty, 1), (None, clean, 2), (8, dirty, 3), (8, clean, 4), (9, None, 5), (None, None, 6), (8, dirty, 7), (8, clean, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = corpus_pipeline.decontamination(spark, df, sf_dir)
    assert got.columns == df.columns and sorted(r["spans"] for r in got.collect()) == [2, 4, 5, 6, 8]


def test_language_stage_uses_its_prediction(spark, docs):
    """Missing and wrong labels are mended; of texts that tell no language those without a right label go."""
    odd = spark.createDataFrame([(-1, "12 34", "en"), (-2, None, "en"), (-3, "Avec.", "en"), (-4, "Avec.", None)], "doc_id long, text string, lang string")
    wrong = F.when(F.col("doc_id") % 10 == 0, F.lit(None)).when(F.col("doc_id") % 40 == 1, F.lit("en")).otherwise(F.col("lang"))
    rows = docs.withColumn("lang", wrong).unionByName(odd, allowMissingColumns=True)
    got = corpus_pipeline.language_id(spark, rows, "")
    assert got.columns == rows.columns
    told, true = {r["doc_id"]: r["lang"] for r in got.collect()}, {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert not {-1, -2} & set(told) and len(told) > 0.97 * len(true)
    assert sum(told[i] == true[i] for i in told if i in true) > 0.95 * len(told)
    model = language.fit(rows)
    found = {r["doc_id"]: r for r in language.identify(rows, model).collect()}
    assert set(told) == {i for i, r in found.items() if r["_lang_lettered"] and (not r["_lang_ambiguous"] or r["lang"] == r["_lang_pred"])}
    assert told == {i: found[i]["_lang_pred"] for i in told}


def test_unlabelled_documents_stay(spark, odd):
    """Without any label, and with a label that is the word for no language."""
    for lang in (None, "und"):
        got = corpus_pipeline.language_id(spark, odd.withColumn("lang", F.lit(lang).cast("string")), "")
        want = [(i, t) for i, t in odd.select("doc_id", "text").collect() if t and any(c.isalpha() for c in t)]
        assert got.columns == odd.columns
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select("doc_id", "text").collect())


def test_the_least_document_stays_once(spark):
    p, q = prose(90, 40), prose(91, 40)
    rows = [(8, p), (8, p), (9, p), (8, p), (20, q), (21, None), (21, None), (30, ""), (30, prose(92, 9)), (None, p), (None, p)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n int")
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert got.columns == df.columns
    want = [(8, p), (20, q), (21, None), (30, ""), (30, prose(92, 9)), (None, p), (None, p)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select("doc_id", "text").collect())


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15), (20, 5), (5, 20), (3, 1)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in common.connected_components(df).collect()}
    assert got == {k: v for k, v in brute.components(edges, {x for e in edges for x in e}).items()}
    assert common.connected_components(df.limit(0)).count() == 0


def test_scratch_folder():
    class Conf:
        def __init__(self, root):
            self.root = root

        def get(self, key, default):
            return self.root

    class Session:
        class sparkContext:  # noqa: N801
            applicationId = "app-1"  # noqa: N815
            master = "local[2]"

    s = Session()
    s.conf = Conf("hdfs://x/y/")
    assert common.scratch_root(s) == "hdfs://x/y"
    s.conf = Conf(None)
    assert common.scratch_root(s) == common.scratch_root(s) and common.scratch_root(s).startswith("file:///")
    # executors elsewhere would not see a folder of the driver
    Session.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_root(s)
    s.conf = Conf("hdfs://x/y/")
    assert common.scratch_root(s) == "hdfs://x/y"
