import random

import brute
from conftest import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same

from leafmill.llm import registry, spelling


def rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", max_size=6), min_size=1, max_size=30))
def test_trie_meets_each_pair_once(words):
    words = sorted(words)
    got = sorted(tuple(sorted(p)) for p in spelling.Trie(words).pairs())
    assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if brute.near(words[i], words[j])]


def test_query_equals_sql_and_brute_force(spark, sf, doc_rows):
    df = registry.queries()["op11_spelling_variants"](spark, sf)
    assert rows(df) == brute.spelling(doc_rows)
    assert_same(df, registry.oracle_sql()["op11_spelling_variants"], sf)


def test_blocks_are_dealt_again(spark):
    """Words that share long heads and tails, of few letters, so that halves are too large and are split; chains of forms."""
    r = random.Random(5)
    base = ["aaaaaa", "aabaab", "abababa", "stammstammstamm", "ééééééé", "x" * 300]
    words = {w: r.choice((5, 6, 26, 140)) for w in base}
    for _ in range(500):
        w = r.choice(list(words))
        at = r.randrange(len(w))
        w = r.choice((w[:at] + w[at + 1 :], w[:at] + r.choice("abé") + w[at:], w[:at] + r.choice("abé") + w[at + 1 :]))
        if len(w) >= 5:
            words.setdefault(w, r.choice((5, 6, 26, 140, 800)))
    df = spark.createDataFrame([(w, n) for w, n in words.items() if len(w) >= 6], "word string, n long")
    want = {w: sum(brute.near(w, x) for x in words if len(x) >= 6) for w in words if len(w) >= 6}
    for chars in (60, 2000, 10**6):
        got = {x["word"]: (x["n_near"], x["form"], x["form_n"]) for x in spelling.near_words(df, group_chars=chars).collect()}
        assert {w: v[0] for w, v in got.items()} == {w: n for w, n in want.items() if n}
        for w, (_, form, n) in got.items():
            assert (n, form) == max(((words[x], x) for x in want if brute.near(w, x)), key=lambda p: (p[0], [-ord(c) for c in p[1]])) or (n, form) == min(((words[x], x) for x in want if brute.near(w, x)), key=lambda p: (-p[0], p[1]))


def test_chains_of_forms(spark):
    chain = [(f"w{k:03d}", f"w{k + 1:03d}") for k in range(37)] + [("a", "w003"), ("b", "c")]
    got = {r["word"]: r["root"] for r in spelling.last_forms(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "c" if w == "b" else "w037" for w, _ in chain}


def test_odd_rows(spark, odd, empty):
    assert rows(spelling.variants(odd)) == brute.spelling([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert spelling.variants(empty).count() == 0
    text = "x".join(["Größe"]) + " " + " ".join(["Straßen", "straßen", "strassen", "ÉCOLES", "école", prose(1, 5)] * 7)
    df = spark.createDataFrame([(k, text, "w", 1) for k in range(9)] + [(None, text, "w", 1)], "doc_id long, text string, word string, n int")
    assert rows(spelling.variants(df)) == brute.spelling([(r["doc_id"], r["text"]) for r in df.collect()])


def test_runs_lose_a_code_point():
    counts = {}
    spelling.text_words("7", "Été été É".encode(), counts, divisor=1)
    assert sum(counts.values()) == 3 and all(len(w.decode()) in (0, 2) for w in counts)
