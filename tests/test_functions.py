import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import fuzzy, text, values

LATIN = st.text(st.characters(min_codepoint=1, max_codepoint=0x24F), max_size=40)
ONCE = settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))


def normalized(t):
    a = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()
    return " ".join(re.sub("[^a-z0-9]+", " ", a).split())


@ONCE
@given(st.lists(LATIN, min_size=300, max_size=300))
def test_normalize_text_equals_nfkd(spark, texts):
    texts = [*texts, "", "ﬁne ½ Æon", "a…b", "ABC-Déf", "x y", "naïve ﬂow ™", "ｆｕｌｌ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.normalize_text(F.col("t")).alias("n"))
    for r in df.collect():
        assert r["n"] == normalized(r["t"]), repr(r["t"])


@ONCE
@given(st.lists(LATIN, min_size=200, max_size=200))
def test_control_characters(spark, texts):
    df = spark.createDataFrame([(t,) for t in [*texts, "\t\r\n", "\x01" * 10]], "t string").select("t", text.control_char_count(F.col("t")).alias("n"))
    for r in df.collect():
        assert r["n"] == sum(ord(c) < 32 and c not in "\n\r\t" for c in r["t"])


def one(spark, c, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in cols.items()))
    return row.select(c.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("1 :: clear", "1"), ("a || b :: c", "a || b"), ("x - y", "x"), ("2019-2020", "2019-2020"), ("", ""), (None, ""), (" p -- q ", "p -- q".split(" --")[0])],
)
def test_parse_value(spark, raw, want):
    assert one(spark, values.parse_value(F.col("r")), r=raw) == want


@pytest.mark.parametrize(
    ("kind", "raw", "want"),
    [
        ("binary_ordinal", "0 or 1", ("1", None)),
        ("binary_ordinal", "0", ("0", None)),
        ("binary_ordinal", "10", ("10", None)),
        ("binary_ordinal", "unclear", ("NA", None)),
        ("binary_ordinal", "", ("NA", None)),
        ("categorical", "Good", ("good", None)),
        ("categorical", "not good", ("good", None)),
        ("categorical", "final", ("NA", None)),
        ("categorical", "excellent", ("excellent", None)),
        ("integer", "c. 2020", (None, 2020)),
        ("integer", "national 2020", ("NA", None)),
        ("integer", "abc", ("abc", None)),
        ("integer_or_string_id", "12", (None, 12)),
        ("integer_or_string_id", "12a", ("12a", None)),
        ("string", "", ("", None)),
    ],
)
def test_normalise_value(spark, kind, raw, want):
    v = one(spark, values.normalise_value(F.col("r"), F.lit(kind), F.col("acc")), r=raw, acc=["poor", "fair", "good"])
    assert (v["s"], v["i"]) == want


TYPES = ["Observ Cohort & Cross sect", "Case Control", "Case Series & Reports", "Before-After (Pre-Post) N contr", "Controlled Intervention Studies"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("RCT of x", TYPES[4]), ("case", "Case Control"), ("co", TYPES[0]), ("", None), ("case control", "Case Control"), ("a cohort study", TYPES[0]), ("nothing", None)],
)
def test_resolve_type(spark, raw, want):
    assert one(spark, values.resolve_type(F.col("r"), TYPES), r=raw) == want


def test_title_score(spark):
    pairs = [("Stiff person syndrome", "Stiff Person Syndrome"), ("", "x"), ("a long title of a paper", "another title of some paper"), ("x " * 120 + "end", "x " * 120 + "fin")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.score_title(F.col("a"), F.col("b")).alias("s"))
    for r in df.collect():
        a, b = normalized(r["a"]), normalized(r["b"])
        if not a or not b:
            want = 0.0
        elif a == b:
            want = 1.0
        else:
            ratio = SequenceMatcher(None, a, b).ratio()
            ta, tb = ({w for w in x.split() if len(w) >= 4} for x in (a, b))
            overlap = len(ta & tb) / max(1, len(ta))
            want = max(ratio, 0.65 * ratio + 0.35 * overlap)
        assert r["s"] == pytest.approx(want)


def test_author_score(spark):
    df = spark.createDataFrame([("Doe, J; Van Roe, M; Poe, E", "J. Doe and M. Roe Van"), ("", "x"), (None, None)], "a string, b string")
    got = [r[0] for r in df.select(fuzzy.score_authors(fuzzy.surnames(F.col("a")), F.col("b"))).collect()]
    assert got == [pytest.approx(2 / 3), 0.0, 0.0]


@pytest.mark.parametrize(("t", "a", "m", "want"), [(0.7, 0.0, 0.525, True), (0.55, 0.25, 0.475, False), (0.6, 0.6, 0.6, True), (0.54, 1.0, 0.655, False)])
def test_accept_rule(spark, t, a, m, want):
    assert spark.range(1).select(fuzzy.accepted(F.lit(t), F.lit(a), F.lit(m))).first()[0] is want


def test_page_marked_text(spark):
    df = spark.createDataFrame([([(0, " a "), (1, ""), (4, "b\n")],), ([],)], "pages array<struct<page_index:int,text:string>>")
    assert [r[0] for r in df.select(text.page_marked_text(F.col("pages"))).collect()] == ["[Page 1]\na\n\n[Page 5]\nb", ""]


def test_falsy_and_paths(spark):
    df = spark.createDataFrame([(True, 0, ""), (False, 3, "x"), (None, None, None)], "b boolean, i int, s string")
    got = df.select(text.falsy_text(F.col("b"), "boolean"), text.falsy_text(F.col("i"), "int"), text.falsy_text(F.col("s"), "string")).collect()
    assert [tuple(r) for r in got] == [("True", "", ""), ("", "3", "x"), ("", "", "")]
    p = spark.createDataFrame([("/r/a/12_x y.v2.pdf",)], "p string").select(text.stem(F.col("p")), text.id_prefix(F.col("p")), text.relative_path(F.col("p"), "/r"), text.relative_path(F.col("p"), "/q")).first()
    assert tuple(p) == ("12_x y.v2", "12", "a/12_x y.v2.pdf", "/r/a/12_x y.v2.pdf")


def test_strip_is_linear_and_knows_every_white_space(spark):
    """Blanks inside a text cost no time of their own: a pattern for the right end tries a run from each of its characters."""
    import time

    spaces = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    rows = [(f"{s}{s}a{s}b\u200b{s}\n{s}",) for s in spaces] + [("".join(spaces),), ("",), (None,), ("a" + " " * 100_000 + "b ",)]
    began = time.monotonic()
    got = [r["t"] for r in spark.createDataFrame(rows, "t string").select(text.strip(F.col("t")).alias("t")).collect()]
    assert got == [None if t is None else t.strip() for (t,) in rows] and time.monotonic() - began < 10


def test_resolve_type_makes_its_candidate_once(spark):
    """Whole texts are resolved: stripping and lower-casing belong to the row, not to each of the comparisons."""
    plan = spark.createDataFrame([("x",)], "t string").select(values.resolve_type(F.col("t"), ["Case Control", "Cohort"]).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1


def test_scores_make_their_texts_once(spark):
    """Overlap and author scores of expressions: each text and each list of names is normalised once."""
    d = spark.createDataFrame([("Héllo world", "hello World again", "Doe, J; Roe, K")], "a string, b string, n string")
    plan = lambda c: d.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    overlap = fuzzy.token_overlap(text.normalize_text(F.col("a")), text.normalize_text(F.col("b")))
    author = fuzzy.score_authors(fuzzy.surnames(F.col("n")), F.col("b"))
    assert plan(overlap).count("lower(") == 2 and plan(author).count("lower(") == 2
    assert d.select(overlap, author).first()[:] == (1.0, 0.0)
