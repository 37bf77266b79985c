import brute
import numpy as np
import pytest
from conftest import prose
from oracle import assert_same

from leafmill.llm import jaccard, registry


def rows(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_equals_brute_force(spark, sf, doc_rows):
    assert rows(registry.queries()["op2_ngram_jaccard_join"](spark, sf)) == brute.jaccard(doc_rows, 3, 90)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_odd_rows(odd, k, percent):
    got = rows(jaccard.near_components(odd, k, percent))
    assert got.pop(None)[1] is None
    docs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").distinct().collect() if r["doc_id"] is not None]
    assert got == brute.jaccard(docs, k, percent)
    assert jaccard.near_components(odd, k, percent).count() == odd.count()


def test_empty(empty):
    assert jaccard.near_components(empty).count() == 0


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_chains_around_the_threshold(spark, k, percent):
    """Texts that drift away word by word: links near the threshold, components through others, groups of several blocks."""
    docs = []
    for family in range(6):
        w = prose(100 + family, 40 + 60 * family).split()
        for step in range(40):
            w = list(w)
            w[(step * 17) % len(w)] = f"new{family}x{step}"
            docs.append((family * 1000 + step, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(jaccard.near_components(df, k, percent)) == brute.jaccard(docs, k, percent)


def test_signatures_meet_for_all_similar_pairs():
    """With any list of frequent elements: sets at the bound share a signature."""
    rng = np.random.default_rng(5)
    for percent in (90, 80):
        for size in (1, 2, 5, 9, 10, 11, 19, 20, 40, 77, 150, 400):
            for _ in range(6):
                a = np.unique(rng.integers(0, 2**63, size, np.uint64))
                most = (100 - percent) * 2 * len(a) // (100 + percent)
                drop = int(rng.integers(0, most + 1))
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 2**63, most - drop, np.uint64)]))
                both = len(np.intersect1d(a, b))
                if both * 100 < percent * (len(a) + len(b) - both):
                    continue
                for frequent in (np.zeros(0, np.uint64), a[: len(a) // 2], a):
                    owner, sig = jaccard.signatures([a, b], percent, frequent)
                    assert np.intersect1d(sig[owner == 0], sig[owner == 1]).size, (percent, size, len(frequent))


def test_blocks(spark, monkeypatch):
    """Groups of many blocks give the same components."""
    docs = []
    w = prose(7, 120).split()
    for i in range(90):
        v = list(w)
        for j in range(i % 7):
            v[(i * 31 + j * 11) % len(v)] = f"c{i}x{j}"
        docs.append((i, " ".join(v[: 120 - (i % 5) * 8])))
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    for bound in (100_000, 0):
        monkeypatch.setattr(jaccard, "BROADCAST_COUNTS", bound)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert rows(jaccard.near_components(df, 5, 80)) == brute.jaccard(docs, 5, 80)


def test_query_equals_sql(spark, sf):
    assert_same(registry.queries()["op2_ngram_jaccard_join"](spark, sf), registry.oracle_sql()["op2_ngram_jaccard_join"], sf)


def test_unrelated_sets_with_one_signature(spark, monkeypatch):
    """A bucket whose first set is linked with none of the others, of many blocks."""
    docs = [(i, f"{prose(900 + i % 20, 60)} tail{i % 3}") for i in range(120)]
    same = lambda sets, percent, frequent: (np.arange(len(sets)), np.full(len(sets), 7, np.uint64))
    monkeypatch.setattr(jaccard, "signatures", same)
    for most in (1024, 16):
        monkeypatch.setattr(jaccard, "BLOCK_SETS", most)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert rows(jaccard.near_components(df, 5, 80)) == brute.jaccard(docs, 5, 80)


def test_ids_near_the_largest_long(spark):
    top = 2**63 - 1
    docs = [(top - i, prose(40, 60) + f" end{i % 2}") for i in range(30)] + [(top - 100 - i, prose(41, 60)) for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(jaccard.near_components(df, 5, 80)) == brute.jaccard(docs, 5, 80)


def test_sql_splits_at_every_blank(spark, tmp_path):
    """All six ASCII blanks part words, in the operator and in the SQL; other controls do not."""
    texts = ["a\rb\fc d\ve", "a b c d e", "a\tb\nc\r\nd  e", "a\x1cb c d", None, "", " \r\f\v", "x y z w", "A B C D E"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet/part")
    folder = tmp_path / "flat"
    folder.mkdir()
    import duckdb

    duckdb.sql(f"copy (select * from '{tmp_path}/documents.parquet/part/*.parquet') to '{folder}/documents.parquet'")
    for t in ("region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations").split():
        duckdb.sql(f"copy (select 1 as x) to '{folder}/{t}.parquet'")
    assert_same(jaccard.op2_ngram_jaccard_join(spark, str(folder)), jaccard.OP2_SQL, str(folder))
    assert rows(jaccard.op2_ngram_jaccard_join(spark, str(folder)))[0] == (3, 0)


def test_the_list_told_to_tasks_is_bounded(spark, monkeypatch):
    """Many copies in many tasks: the driver gets no more shingles than TOLD, and the result stays the same."""
    rows_ = [(k, prose(500 + k % 40, 60)) for k in range(4000)]
    df = spark.createDataFrame(rows_, "doc_id long, text string").repartition(16)
    want = rows(jaccard.near_components(df, 3, 90))
    monkeypatch.setattr(jaccard, "TOLD", 50)
    monkeypatch.setattr(jaccard, "LEAST_COUNT", 1)
    assert rows(jaccard.near_components(df, 3, 90)) == want == brute.jaccard(rows_, 3, 90)
