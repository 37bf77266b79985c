"""Ops 4 and 9 and what they share."""

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import prose
from pyspark.sql import functions as F

from leafmill.llm import passages, registry, substring, suffix_family


def words(df):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", "n_words", removed, F.sha2(F.col("kept").cast("binary"), 256)).collect()}


def bytes_(df):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()}


def test_queries_equal_brute_force(spark, sf, doc_rows):
    got = {r[0]: tuple(r)[1:] for r in registry.queries()["op4_substring_dedup"](spark, sf).collect()}
    assert got == brute.substring_words(doc_rows)
    got = {r[0]: tuple(r)[1:] for r in registry.queries()["op9_suffix_array_dedup"](spark, sf).collect()}
    assert got == brute.substring_bytes(doc_rows)


def test_odd_rows(odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").distinct().collect() if r["doc_id"] is not None]
    for run, want in ((lambda: words(substring.remove_repeats(odd)), brute.substring_words(docs)), (lambda: bytes_(suffix_family.remove_repeats(odd)), brute.substring_bytes(docs))):
        got = run()
        assert got.pop(None)[1] == 0  # a null id keeps everything
        assert got == want
    assert substring.remove_repeats(odd).count() == suffix_family.remove_repeats(odd).count() == odd.count()


def test_empty(empty):
    assert substring.remove_repeats(empty).count() == suffix_family.remove_repeats(empty).count() == 0


def test_passages_in_many_places(spark):
    """A passage within different surroundings, overlapping passages, periodic texts, order against ids."""
    p, q = prose(50, 80), prose(51, 64)
    docs = [(40 - i, f"{prose(200 + i, 30)} {p} {prose(300 + i, 20)} {q if i % 3 else ''} {p[: 300 + i]}") for i in range(30)]
    docs += [(100, "na " * 300), (101, "na " * 90 + "end"), (102, "abcdefg" * 100), (103, prose(60, 12) * 12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert words(substring.remove_repeats(df)) == brute.substring_words(docs)
    assert bytes_(suffix_family.remove_repeats(df)) == brute.substring_bytes(docs)
    for length, gram in ((12, 4), (7, 7)):
        assert words(substring.remove_repeats(df, length, gram)) == brute.substring_words(docs, length)
        assert bytes_(suffix_family.remove_repeats(df, length, gram)) == brute.substring_bytes(docs, length)


@pytest.mark.parametrize("hot_runs", [1, passages.HOT_RUNS])
def test_a_repeated_row_is_the_first_occurrence(spark, hot_runs):
    """A passage in different surroundings stays once, in the row that repeats."""
    p = prose(80, 60)
    t, u = f"{prose(81, 20)} {p} {prose(82, 20)}", f"{prose(83, 20)} {p} {prose(84, 20)}"
    df = spark.createDataFrame([(8, t), (8, t), (9, u), (8, t)], "doc_id long, text string")
    out = suffix_family.remove_repeats(df, hot_runs=hot_runs)
    assert [bytes(r["kept"]).decode() for r in out.where("doc_id = 8").collect()] == [t] * 3
    assert bytes_(out) == brute.substring_bytes([(8, t), (9, u)])
    assert words(substring.remove_repeats(df, hot_runs=hot_runs)) == brute.substring_words([(8, t), (9, u)])


@pytest.mark.parametrize("most", [1, 3, 10**6])
@pytest.mark.parametrize("checked", [1, 100])
def test_classify_does_not_depend_on_batches(most, checked, monkeypatch):
    monkeypatch.setattr(passages, "CHECKED", checked)
    rng = np.random.default_rng(1)
    rows = sorted({(int(h), int(w), int(d), int(p), int(n), int(h)) for h, w, d, p, n in zip(rng.integers(0, 40, 400), rng.integers(0, 4, 400), rng.integers(0, 9, 400), rng.integers(0, 5, 400), rng.choice([-2, 2], 400), strict=True)})
    rows = sorted(rows + rows[::7])
    aside = [(1, 2, 3, 4, 5, 600), (1, 2, 3, 5, 5, 601)]  # known to repeat before they were dealt

    def run(size, same):
        every = rows + aside
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*every[i : i + size], strict=True)], list("abcdef")) for i in range(0, len(every), size)]
        return sorted(t for b in passages.classify(iter(batches), same, most) for t in zip(*(c.to_pylist() for c in b.columns), strict=True))

    for same in (True, False):
        assert run(1, same) == run(7, same) == run(10_000, same)
        groups = {}
        for h, w, d, p, n, _ in rows:
            groups.setdefault(h, {}).setdefault(w, []).append((d, p, n))
        want = [(3, 4, 5, 1, 2, passages.REPEAT), (3, 5, 5, 1, 2, passages.REPEAT)]
        for h, texts in groups.items():
            kept, repeats = [], 0
            for w, occ in texts.items():
                for k, (d, p, n) in enumerate(occ):
                    if k and occ[k - 1][:2] == (d, p):
                        continue
                    if k and (same or d != occ[0][0]):
                        repeats += 1
                        want.append((d, p, 2, h, w, passages.NAMED if k <= checked else passages.REPEAT))
                    else:
                        kept.append((d, p, n, w))
            if len(texts) == 1 and not repeats:
                kept = [x for x in kept if x[2] < 0]
            kind = passages.HOT if len(texts) > 1 and len(kept) > most else passages.INDEXED
            want += [(d, p, 2, h, w, kind) for d, p, _, w in kept]
        assert run(50, same) == sorted(want)


@pytest.mark.parametrize("same", [True, False])
def test_copies_of_a_batch_are_thinned_out(same):
    rng = np.random.default_rng(8)
    h, w, d, p = (rng.integers(0, k, 600) for k in (3, 3, 12, 6))
    known = passages.thinned(h, w, d, p, same)
    assert known.any()
    for i in np.flatnonzero(known):
        earlier = [(d[j], p[j]) for j in range(600) if not known[j] and h[j] == h[i] and w[j] == w[i]]
        assert len(earlier) >= passages.DEALT and (min(earlier) < (d[i], p[i]) if same else min(earlier)[0] < d[i])


def test_many_copies(spark, monkeypatch):
    """Copies beyond what is dealt, and beyond what the index is asked for."""
    p = prose(90, 120)
    docs = [(i, f"{p} {prose(600 + i, 30) if i % 3 else p[40:600]}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert words(substring.remove_repeats(df)) == brute.substring_words(docs)
    assert bytes_(suffix_family.remove_repeats(df)) == brute.substring_bytes(docs)


def test_hot_groups_are_searched_window_by_window(spark):
    """The same result when every group counts as hot."""
    p = prose(70, 90)
    docs = [(i, f"{prose(400 + i, 15)} {p[i:]} {prose(500 + i, 15)}") for i in range(12)] + [(50, "ab" * 300), (51, p * 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert words(substring.remove_repeats(df, hot_runs=1)) == brute.substring_words(docs)
    assert bytes_(suffix_family.remove_repeats(df, hot_runs=1)) == brute.substring_bytes(docs)


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(2)
    seq = rng.integers(0, 37, 1000)
    m = substring.WaveletMatrix(seq)
    for c in range(37):
        at = rng.integers(0, 1001, 50)
        got = m.rank(np.full(50, c), at) - m.rank(np.full(50, c), np.zeros(50, np.int64))
        assert got.tolist() == [int((seq[:k] == c).sum()) for k in at]


@pytest.mark.parametrize(("symbols", "depth"), [(4, 5), (2, 8), (40, 3), (300, 2)])
def test_fm_index_gives_matching_statistics_of_any_sequence(symbols, depth):
    rng = np.random.default_rng(4)
    seqs = [rng.integers(1, symbols, int(n)) for n in rng.integers(0, 40, 60)]
    docs = np.sort(rng.integers(0, 20, 60))
    index = substring.FMIndex(seqs, docs, depth)
    probe = [*seqs, rng.integers(1, symbols, 50), rng.integers(1, symbols + 9, 80), np.zeros(0, np.int64)]
    where = {}
    for s, d in zip(seqs, docs, strict=True):
        for i in range(len(s)):
            for k in range(1, min(depth, len(s) - i) + 1):
                where.setdefault(tuple(s[i : i + k].tolist()), d)
    for s, length, least in zip(probe, *index.matches(probe), strict=True):
        for i in range(len(s)):
            known = [k for k in range(1, min(depth, len(s) - i) + 1) if tuple(s[i : i + k].tolist()) in where]
            assert length[i] == max(known, default=0)
            assert least[i] == (where[tuple(s[i : i + depth].tolist())] if depth in known else np.iinfo(np.int64).max)


def test_fm_index_shortens_a_lost_match():
    index = substring.FMIndex([np.arange(1, 51)], np.array([7]), 50)
    assert index.earliest([np.append(np.arange(1, 51), 30)])[0].tolist() == [7, np.iinfo(np.int64).max]
    assert index.matches([np.array([99, 1, 2, 200])])[0][0].tolist() == [0, 2, 1, 0]


@pytest.mark.parametrize("length", [3, 4, 8, 9, 16, 20])
def test_index_family_finds_the_first_position(length):
    rng = np.random.default_rng(6)
    f, seen = suffix_family.IndexFamily(length), {}
    for _ in range(12):
        batch = [bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) for n in rng.integers(0, 60, 6)] + [b"ab" * 30]
        want, base = [], f.used
        for t in batch:
            want += [seen.setdefault(t[i : i + length], base + i) for i in range(len(t) - length + 1)]
            base += len(t)
        assert f.add(batch).tolist() == want
        sizes = [len(x[0]).bit_length() for x in f.levels]
        assert len(set(sizes)) == len(sizes)  # levels of about equal size were merged
        for positions, _ in f.levels:
            windows = [bytes(f.buffer[p : p + length]) for p in positions]
            assert windows == sorted(set(windows))
    assert sum(len(x[0]) for x in f.levels) == len(seen)


def test_equal_windows_are_not_sorted_word_by_word(monkeypatch):
    """What the sort is asked for does not grow with the copies of a text, nor with the words of a window."""
    sizes, lexsort = [], np.lexsort
    monkeypatch.setattr(suffix_family.np, "lexsort", lambda keys: sizes.append(len(keys[0])) or lexsort(keys))
    f, texts = suffix_family.IndexFamily(100), [prose(95, 100).encode()] * 40 + [prose(96, 100).encode()] * 40
    first = f.add(texts)
    many, size = [len(t) - 99 for t in texts], len(texts[0])
    ends = np.cumsum([0, *many])
    for k, lead in ((0, 0), (39, 0), (40, 40 * size), (79, 40 * size)):
        assert first[ends[k] : ends[k + 1]].tolist() == list(range(lead, lead + many[k]))
    assert sum(sizes) < len(first) / 2


@pytest.mark.parametrize("batch", [1, 300, 1 << 17])
def test_search_tells_where_each_window_stands_first(batch, monkeypatch):
    monkeypatch.setattr(suffix_family, "BATCH_WINDOWS", batch)
    rng = np.random.default_rng(12)
    texts = [bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(9, 60, 40)]
    doc, start = np.arange(40) // 3, np.arange(40) % 3 * 1000
    seen, want = {}, []
    for d, s, t in zip(doc.tolist(), start.tolist(), texts, strict=True):
        want += [seen.setdefault(t[i : i + 9], (d, s + i)) for i in range(len(t) - 8)]
    many, first_doc, first_start = suffix_family.search(9)(doc, start, texts)
    assert many.tolist() == [len(t) - 8 for t in texts]
    assert list(zip(first_doc.tolist(), first_start.tolist(), strict=True)) == want


@pytest.mark.parametrize("flags", [1, 70])
def test_spans_do_not_depend_on_how_many_windows_are_told_at_once(spark, flags, monkeypatch):
    monkeypatch.setattr(passages, "FLAGS", flags)
    p = prose(97, 80)
    docs = [(i, f"{prose(700 + i, 20)} {p[i % 3 * 30 :]} {p if i % 2 else prose(800 + i, 9)}") for i in range(20)] + [(30, "abc" * 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert words(substring.remove_repeats(df)) == brute.substring_words(docs)
    assert bytes_(suffix_family.remove_repeats(df)) == brute.substring_bytes(docs)


def test_index_family_memory():
    """3 MB of text need less than 100 MB beyond it."""
    import tracemalloc

    rng = np.random.default_rng(9)
    data = rng.integers(97, 123, 3 << 20).astype(np.uint8).tobytes()
    texts = [data[i : i + 137] for i in range(0, len(data) - 137, 137)]
    tracemalloc.start()
    suffix_family.search(100)(np.arange(len(texts)), np.zeros(len(texts), np.int64), texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6
