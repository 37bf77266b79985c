import random

import brute
import numpy as np
from oracle import assert_same

from leafmill.llm import divergence, registry


def rows(df):
    found = df.collect()
    out = {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in found}
    assert len(out) == len(found)
    return out


def triples(df):
    return [(r["lang"], r["source"], r["text"]) for r in df.select("lang", "source", "text").collect()]


def test_query_equals_sql_and_brute_force(spark, sf, docs):
    df = registry.queries()["op12_source_divergence"](spark, sf)
    assert rows(df) == brute.divergence(triples(docs))
    assert_same(df, registry.oracle_sql()["op12_source_divergence"], sf)


def test_many_blocks_and_ties(spark, docs):
    few = docs.limit(120)
    want = brute.divergence(triples(few), top=5)
    assert rows(divergence.audit(few, top=5, block_bytes=2000)) == want
    text = "alpha beta gamma delta "  # terms whose values tie, beyond the last rank
    tied = spark.createDataFrame([("en", f"s{k % 3}", text * (k % 3 + 1) + f"only{k % 3} also{k % 3} more{k % 3}") for k in range(12)], "lang string, source string, text string")
    assert rows(divergence.audit(tied, top=2, block_bytes=60)) == brute.divergence(triples(tied), top=2)


def test_odd_rows(odd, empty, spark):
    assert rows(divergence.audit(odd)) == brute.divergence(triples(odd))
    assert divergence.audit(empty).count() == 0
    bare = spark.createDataFrame([("en", "a", None), ("en", None, "1 2 3"), ("en", "b", "word"), (None, "c", ""), ("fr", "d", "mot mot")], "lang string, source string, text string")
    got = rows(divergence.audit(bare))
    assert got == brute.divergence(triples(bare)) and got["en", "", "pair", "a"] == (0, 1)


def test_slices_with_one_digest_are_told_apart_by_their_bytes():
    text = b"one two three one TWO four two"
    raw = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(divergence._TERM[raw], prepend=False, append=False))
    for digest in (lambda v: 7, lambda v: len(v), divergence.xxhash.xxh64_intdigest):
        of, terms = divergence.grouped_slices(divergence._LOW[raw], edges[::2], edges[1::2], digest)
        assert [terms[i] for i in of] == text.lower().split() and len(terms) == 4


def test_whole_number_shares():
    r = random.Random(3)
    total = [r.randrange(1, 9 * 10**15) for _ in range(500)]
    n = [r.randrange(0, t) for t in total]
    got = divergence.share(np.array(n), np.array(total))
    assert got.tolist() == [1 + 1_000_000_000 * (a + 1) // t for a, t in zip(n, total, strict=True)]
