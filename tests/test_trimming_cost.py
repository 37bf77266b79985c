"""What trimming leaves out of its work changes none of its results (F3, F7)."""

import random
import re

import plain
from pyspark.sql import functions as F

from leafmill.functions import fuzzy, text
from leafmill.operators import proceedings
from leafmill.plans import testdata

WORDS = ["Annals", "of", "Neurology", "terms", "and", "conditions", "Tèrms", "ÁNNALS", "University", "usa", "Smith,", "J,", "MD", "m.d.", "xmd", "éMD", "PhD;", "A,", "½", "ß", "ﬁne", "中文", "😀", "12", "plain", "word", "a", "--", "…"]
GAPS = [" "] * 12 + ["  ", "\t", "\xa0", "　", "\x1f", "  "]


def _line(r: random.Random) -> str:
    head = f"{r.randrange(10, 999)}. " if r.random() < 0.15 else ""
    return head + "".join(r.choice(WORDS) + r.choice(GAPS) for _ in range(r.randrange(0, 30)))


def test_lines_and_words_of_odd_texts(spark):
    r = random.Random(11)
    breaks = ["\n"] * 6 + ["\r\n", "\r", "\x0b", "\x1d", "\x85", " ", " "]
    texts = ["".join(_line(r) + r.choice(breaks) for _ in range(r.randrange(0, 8))) for _ in range(60)] + ["", "\n", "\r\n\r\n", " \xa0\n　", "a\r\nb", "a\n\rb"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x["i"]: x for x in df.select("i", text.split_lines(F.col("t")).alias("l"), F.transform(text.split_lines(F.col("t")), text.collapse_space).alias("c"), F.transform(text.split_lines(F.col("t")), text.is_blank).alias("b"), text.normalize_text(F.col("t")).alias("n")).collect()}
    for i, t in enumerate(texts):
        lines = re.split("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", t)
        assert got[i]["l"] == lines
        assert got[i]["c"] == [" ".join(x.split()) for x in lines] and got[i]["b"] == [not x.strip() for x in lines]
        assert got[i]["n"] == plain.normalized(t)


def test_early_classes_give_what_all_classes_give(spark):
    r = random.Random(5)
    pages = [(f"v{v}", p, "\n".join(_line(r) for _ in range(r.randrange(0, 25)))) for v in range(3) for p in range(45)]
    lines = proceedings.lines_of_pages(spark.createDataFrame(pages, "paper_id string, page_index int, text string"))
    full, early = proceedings.classify(lines), proceedings.classify_early(lines)
    volumes = lines.groupBy("paper_id").agg(F.lit(45).alias("n_pages"), F.lit("").alias("source_filename"))
    told = sorted(proceedings.signals(full, volumes).collect())
    assert sorted(proceedings.signals(early, volumes).collect()) == told and all(x["title_like_line_count"] and x["author_like_line_count"] for x in told)
    short = proceedings.block_lines(early.drop("is_author", "is_title"))
    want = proceedings.block_lines(full)
    assert sorted(proceedings.blocks(short).collect()) == sorted(proceedings.blocks(want).collect())
    chosen = proceedings.blocks(want).select("paper_id", "block_no", F.lit("trimmed_auto").alias("trim_status")).where("block_no % 2 = 1")
    kept = sorted(proceedings.trimmed_pages(short, chosen).collect())
    assert kept == sorted(proceedings.trimmed_pages(want, chosen).collect()) and len(kept) > 20
    assert full.where("is_footer").count() > 5


def test_authors_of_blocks_without_a_set_of_their_words(spark):
    rows = [("Roe, A; Van der Poe, B", "x poe der van"), ("Roe, A", "heroes"), ("O Li, A", "o li"), ("O Li, A", "li o"), ("Van Poe, A", "vans poes"), ("Van Poe, A", "poe-van"), ("", "a"), ("Müller, B", "MULLER"), ("Roe, A", None)]
    got = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a string, t string").select("i", fuzzy.score_authors(fuzzy.surnames(F.col("a")), F.col("t")).alias("s")).orderBy("i").collect()
    assert [x["s"] for x in got] == [plain.author_score(a, t or "") for a, t in rows]
    plan = spark.createDataFrame([("a", "b")], "a string, t string").select(fuzzy.score_authors(fuzzy.surnames(F.col("a")), F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" not in plan


def test_references_look_into_last_pages_only(spark, sf):
    refs = testdata._volume_references(spark, sf)
    assert "LeftSemi" in refs._jdf.queryExecution().optimizedPlan().toString()
    last = {}
    for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        v = str(d["doc_id"] // testdata.VOLUME_PAGES)
        last[v] = max(last.get(v, (-1, "")), (d["doc_id"], d["text"] or ""))
    assert {x["paper_id"]: x["title"] or "" for x in refs.collect()} == {v: t.split("\n")[0] for v, (_, t) in last.items()}


def test_ascii_blocks_are_not_normalised_for_names_of_one_word(spark):
    rows = [("Roe, A; Poe, B", "A HEROES' poem. PØE"), ("Roe, A; Poe, B", "R-oe, r oe; POE"), ("Roe, A; Poe, B", "ROE(poe)"), ("Roe, A", ""), ("Roe, A", None), ("Li, B", "a li"), ("Van Poe, C; Li, B", "poe van li")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a string, t string")
    score = fuzzy.score_authors(fuzzy.surnames(F.col("a")), F.col("t"))
    assert [x["s"] for x in df.select("i", score.alias("s")).orderBy("i").collect()] == [plain.author_score(a, t or "") for a, t in rows]
    assert "lower(t" in re.sub(r"#\d+", "", df.select(score)._jdf.queryExecution().optimizedPlan().toString())
