"""Ops 8 and 10: held-out quality and awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import language, registry, toxicity


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    x = registry.queries()["op8_language_id"](spark, sf).join(docs, "doc_id").toPandas()
    h = x[x.held_out]
    assert len(x) == docs.count() and len(h) > 20
    assert (h.lang == h.lang_pred).mean() > 0.97
    assert x.score.between(0, 1).all()


def test_language_odd_rows(spark, odd, empty):
    model = language.fit(odd)
    rows = language.identify(odd, model, keep=["doc_id", "text", "score"]).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["_lang_pred"], r["_lang_score"]) == ("und", 0.0)
        else:
            assert r["_lang_pred"] == "en"
    none = language.fit(empty)
    assert none.languages == [] and language.identify(odd, none).where("_lang_pred <> 'und'").count() == 0
    assert language.identify(empty, model).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 12])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert len(code) == n and set(np.unique(code)) <= {-1.0, 1.0}
    if n > 2:
        near = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(near) >= code.shape[1] // 4


def test_toxicity_learns(spark):
    """A vocabulary of toxic words that the labels mark, at the size of a small table."""
    rng = np.random.default_rng(8)
    bad = ["grumblewort", "snarkle", "vilefen"]
    docs, labels = [], []
    for i in range(1500):
        w = [f"w{rng.integers(0, 400)}" for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w[rng.integers(0, 60)] = str(rng.choice(bad)) + str(rng.choice(["", "en", "s"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = language.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(d.where(~held), y)
    x = toxicity.score(d, model).join(y, "doc_id").withColumn("held", held).toPandas()
    h = x[x.held]
    assert ((h.score >= 0.5) == (h.toxic == 1)).mean() > 0.97
    assert abs(h.score.mean() - h.toxic.mean()) < 0.05


def test_toxicity_odd_rows(spark, odd, empty):
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd, no_labels)
    assert [r["score"] < 0.5 for r in toxicity.score(odd, model).collect()] == [True] * odd.count()
    labels = spark.createDataFrame([(i, i % 2) for i in range(3, 19)] + [(None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 8}) == 1
    assert toxicity.score(empty, model).count() == 0


def test_features_are_linear_in_the_text():
    import time

    lex = toxicity.Lexicon({"idiot": 5.0})
    for text in ("x" * (1 << 20), "a1" * (1 << 19), "a_" * (1 << 19), "a." * (1 << 19), "1" * (1 << 20), "ab." * (1 << 18) + "..."):
        start = time.perf_counter()
        lex.features(text)
        assert time.perf_counter() - start < 5, text[:4]


def test_toxicity_query(spark, sf):
    """The registered query: whole table, scores that tell held-out toxic documents apart."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    out = registry.queries()["op10_toxicity"](spark, sf)
    x = out.join(labels, "doc_id", "left").toPandas()
    assert len(x) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert x.score.between(0, 1).all() and (x.predicted == (x.score >= 0.5)).all()
    bad, good = x[x.toxic == 1].score.to_numpy(), x[x.toxic == 0].score.to_numpy()
    assert (bad[:, None] > good[None]).mean() + 0.5 * (bad[:, None] == good[None]).mean() > 0.8  # few labels to learn from


def test_numerals_are_no_letters(spark):
    model = language.fit(spark.createDataFrame([(i, "the words of one" if i % 2 else "les mots d'une", "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, "½ ²", "x"), (2, "① 12", "x"), (3, "é", "x"), (4, "ª", "x")], "doc_id long, text string, _lang_pred string")
    out = language.identify(df, model)
    assert out.columns.count("_lang_pred") == 1
    got = {r["doc_id"]: r["_lang_pred"] for r in out.collect()}
    assert got[1] == got[2] == "und" and got[3] in ("en", "fr") and got[4] in ("en", "fr")


def test_isotonic_rises():
    rng = np.random.default_rng(9)
    m = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * m))).astype(float)
    at, value = toxicity.isotonic(m, y, np.ones(500))
    assert (np.diff(at) > 0).all() and (np.diff(value) >= 0).all() and value.min() >= 0 and value.max() <= 1


def test_features_see_disguised_words():
    lex = toxicity.Lexicon({"idiot": 5.0, "scum*": 4.0})
    plain, masked, spaced, none = (lex.features(t) for t in ("you idiot", "you 1d1ot id!ot", "you i d i o t", "a fine text"))
    assert plain[0] == 0.5 and plain[5] == 1.0
    assert masked[12] > 0 and spaced[12] > 0
    assert none[0] == none[12] == 0.0 and lex.features("scummy")[0] == 1.0 and lex.features(None) == [0.0] * toxicity.FEATURES
