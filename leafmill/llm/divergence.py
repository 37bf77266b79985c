"""Op 12. Source divergence audit: how far sources of one language lie from each other, and by which terms.

Terms are found on bytes: a lookup table over a chunk of concatenated UTF-8 texts marks term bytes, changes of the mark are
boundaries, xxhash groups the slices, and every slice is compared byte for byte with the first of its group (a collision
is grouped by its bytes). Counts of a chunk leave as rows and are summed by Spark. The kept terms of a language, those in
at least MIN_DOCS of its documents, are dealt by hash into blocks of about BLOCK_BYTES; a block is a CSR matrix of sources
by terms, its sums over the terms of a source are taken by reduceat, and Spark adds the sums of blocks.

With n occurrences in a group, N of all kept terms there and V kept terms, p = 1 + floor(SCALE * (n + 1) / (N + V)), and
p lies from q by floor((p - q)^2 / q). Whole numbers only: the quotient is taken in three steps of a thousand, exact for
N + V below 9e15, and a sum stays in 64 bits for up to 1e9 kept terms of a language.

Only counts are shuffled, never texts. A block holds a bounded number of counts; a language in which S sources occur gives
S * (S - 1) pairs, which is the size of its result, and at most TOP terms a source and block for the ranks of terms.

Defined cases: null text, lang and source count as ''; every row is a document of its own, so repeated rows count again;
every (lang, source) that occurs is a group, without terms too; a language without kept terms has distances of 0; groups
alone in their language have no pairs; empty tables give an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import materialise, small_enough, table
from leafmill.llm.passages import column_chunks

MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Text handled at once in a task, and the estimated bytes of a block of counts.
CHUNK_BYTES, BLOCK_BYTES = 4 << 20, 2 << 20
#: Languages whose block counts may be broadcast.
BROADCAST_LANGS = 10_000

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 0x41) & (_BYTE <= 0x5A)
_TERM = _UPPER | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
_LOW = np.where(_UPPER, _BYTE + 32, _BYTE).astype(np.uint8)


def grouped_slices(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """The number of each slice's term and the terms. Slices with equal digests are one term only if their bytes are equal."""
    data = low.tobytes()
    view = memoryview(data)
    hashes = np.fromiter((digest(view[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    lead = first[of]
    same = size == size[lead]
    # bytes of each slice against those of the first of its group, both gathered in one row
    check = np.flatnonzero(same & (lead != np.arange(len(starts))))
    if len(check):
        n = size[check]
        offset = np.concatenate(([0], np.cumsum(n)[:-1]))
        inside = np.arange(n.sum()) - np.repeat(offset, n)
        differ = low[np.repeat(starts[check], n) + inside] != low[np.repeat(starts[lead[check]], n) + inside]
        same[check[np.add.reduceat(differ, offset, dtype=np.int64) > 0]] = False
    terms = [data[starts[i] : ends[i]] for i in first]
    more: dict[bytes, int] = {}
    for i in np.flatnonzero(~same):
        of[i] = more.setdefault(data[starts[i] : ends[i]], len(terms) + len(more))
    return of, terms + list(more)


def chunk_counts(texts: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """For each group and term that occurs: group, term, occurrences and documents."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edges = np.flatnonzero(np.diff(_TERM[raw], prepend=False))
    if not len(edges):
        return np.empty(0, np.int64), [], np.empty(0, np.int64), np.empty(0, np.int64)
    starts, ends = edges[::2], edges[1::2]
    of, terms = grouped_slices(_LOW[raw], starts, ends)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    doc = np.searchsorted(begins, starts, "right") - 1
    cell, n = np.unique(doc * len(terms) + of, return_counts=True)  # CSR of documents by terms, row by row
    key = groups[cell // len(terms)] * len(terms) + cell % len(terms)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    docs = np.diff(at, append=len(key))
    return key[at] // len(terms), [terms[i] for i in key[at] % len(terms)], np.add.reduceat(n, at), docs


_COUNTS = "lang string, source string, term string, n long, docs long"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text as bytes) to counts of each chunk of texts."""
    for b in batches:
        pairs = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        known = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
        names, code = list(known), np.array([known[p] for p in pairs], np.int64)
        for at, texts in column_chunks(b.column(2), CHUNK_BYTES):
            group, terms, n, docs = chunk_counts(texts, code[at : at + len(texts)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[g][0] for g in group], pa.string()), pa.array([names[g][1] for g in group], pa.string()), pa.array([t.decode() for t in terms], pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / total) in whole numbers; n + 1 <= total < 9e15."""
    rest, out = np.asarray(n, np.int64) + 1, np.zeros(np.broadcast(n, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pair_sums(row: np.ndarray, col: np.ndarray, p: np.ndarray, empty: np.ndarray, terms: int) -> np.ndarray:
    """Sums over all terms of distance(source i, source j) for all i, j, from the cells of a CSR matrix.

    row and col tell each cell's source and term, by row; p is its share, empty[i] that of a term source i lacks. For a source i every
    cell of j is compared with i's share of its term; terms that only i has and terms that neither has are added.
    """
    s = len(empty)
    bounds = np.searchsorted(row, np.arange(s + 1))
    filled = np.flatnonzero(np.diff(bounds))
    out = np.zeros((s, s), np.int64)

    def by_row(x: np.ndarray) -> np.ndarray:
        sums = np.zeros(s, np.int64)
        if len(filled):
            sums[filled] = np.add.reduceat(x, bounds[filled])
        return sums

    cells = np.diff(bounds)
    for i in range(s):
        mine = slice(bounds[i], bounds[i + 1])
        dense, has = np.full(terms, empty[i]), np.zeros(terms, bool)
        dense[col[mine]], has[col[mine]] = p[mine], True
        at, both = dense[col], has[col]
        out[i] = by_row(distance(at, p)) - by_row(np.where(both, distance(at, empty[row]), 0))
        value, times = np.unique(p[mine], return_counts=True)  # counts repeat, so few shares are distinct
        for k in range(0, len(value), 1024):
            out[i] += (distance(value[k : k + 1024, None], empty[None, :]) * times[k : k + 1024, None]).sum(0)
        out[i] += (terms - cells[i] - cells + by_row(both.astype(np.int64))) * distance(empty[i], empty)
    return out


_SCORES = "lang string, source string, part string, item string, value long"


def block_scores(kept: pa.Table, totals: pa.Table, top: int = TOP) -> pa.Table:
    """Of one block of a language's terms: sums of distances for each pair of sources, and for each source its `top` terms."""
    totals = totals.sort_by("source")
    names, n_total = totals["source"].to_pylist(), np.array(totals["total"].to_pylist(), np.int64)
    lang, v, lang_total = totals["lang"][0].as_py(), totals["v"][0].as_py(), totals["lang_total"][0].as_py()
    s, t = len(names), kept.num_rows
    if t:
        of = {name: i for i, name in enumerate(names)}
        per = kept["per"].combine_chunks()
        count = per.flatten().field("n").to_numpy()
        row = np.array([of[x] for x in per.flatten().field("source").to_pylist()], np.int64)
        size = pc.list_value_length(per).to_numpy()
        col = np.repeat(np.arange(t), size)
        own = np.concatenate(([0], np.cumsum(size)[:-1]))
        q = share(np.add.reduceat(count, own), np.int64(lang_total + v))
        order = np.argsort(row, kind="stable")
        row, col, count = row[order], col[order], count[order]
        p = share(count, n_total[row] + v)
        sums = pair_sums(row, col, p, share(np.zeros(s, np.int64), n_total + v), t)
        rank = np.empty(t, np.int64)
        terms = kept["term"].combine_chunks()
        rank[pc.sort_indices(terms).to_numpy()] = np.arange(t)
        above = np.flatnonzero(p > q[col])
        value = distance(p[above], q[col[above]])
        first = np.lexsort((rank[col[above]], -value, row[above]))
        above, value = above[first], value[first]
        place = np.arange(len(above)) - np.searchsorted(row[above], row[above])
        above, value = above[place < top], value[place < top]
        told = ([names[r] for r in row[above]], terms.take(pa.array(col[above])).to_pylist(), value)
    else:
        sums, told = np.zeros((s, s), np.int64), ([], [], np.empty(0, np.int64))
    i, j = np.nonzero(~np.eye(s, dtype=bool))
    n = len(i)
    return pa.table({
        "lang": pa.array([lang] * (n + len(told[0])), pa.string()),
        "source": pa.array([names[x] for x in i] + told[0], pa.string()),
        "part": pa.array(["pair"] * n + ["term"] * len(told[0]), pa.string()),
        "item": pa.array([names[x] for x in j] + told[1], pa.string()),
        "value": pa.array(np.concatenate((sums[i, j], told[2])), pa.int64()),
    })


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block_bytes: int = BLOCK_BYTES, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank of every group of docs."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    groups = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source")).distinct()
    found = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).cast("binary").alias("text")).mapInArrow(count_terms, _COUNTS)
    counts = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("per")).where(F.col("docs") >= min_docs)
    kept = materialise(kept.select("lang", "term", "per"), "kept")
    size = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.size("per") * 16 + F.octet_length("term")).alias("bytes"))
    sums = kept.select("lang", F.explode("per").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total"))
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    # a block takes at least as many counts as it returns sums
    blocks = F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.greatest(F.lit(block_bytes), F.col("sources") * F.col("sources") * 16))).cast("int")
    langs = materialise(sources.join(size, "lang", "left").na.fill(0, ["v", "bytes"]).join(sums.groupBy("lang").agg(F.sum("total").alias("lang_total")), "lang", "left").na.fill(0, ["lang_total"]).withColumn("blocks", blocks), "langs")
    small = small_enough(langs, BROADCAST_LANGS)
    by_lang = F.broadcast(langs) if small else langs
    totals = groups.join(sums, ["lang", "source"], "left").na.fill(0, ["total"]).join(by_lang, "lang")
    totals = totals.select("lang", "source", "total", "v", "lang_total", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = kept.join(by_lang.select("lang", "blocks"), "lang").select("lang", F.expr("pmod(xxhash64(term), blocks)").cast("int").alias("block"), "term", "per")
    scores = dealt.groupBy("lang", "block").cogroup(totals.groupBy("lang", "block")).applyInArrow(lambda k, t: block_scores(k, t, top), _SCORES)
    scores = materialise(scores, "scores")
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = scores.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(w))
    return pairs.unionByName(scores.where("part = 'term'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
o as (select doc_id, lang, source, unnest(list_filter(string_split_regex(t, '[\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '')) as term from d),
k as (select lang, term, count(*)::hugeint as n from o group by lang, term having count(distinct doc_id) >= 3),
l as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from k group by lang),
g as (select distinct lang, source from d),
c as (select o.lang, o.source, o.term, count(*)::hugeint as n from o join k using (lang, term) group by all),
gt as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as total from g left join c using (lang, source) group by all),
p as (select gt.lang, gt.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (gt.total + l.v) as p, 1 + (1000000000::hugeint * (k.n + 1)) // (l.total + l.v) as q
  from gt join l using (lang) join k using (lang) left join c on c.lang = gt.lang and c.source = gt.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select lang, source, 'term', term, (((p - q) * (p - q)) // q)::bigint from p where n > 0 and p > q),
n as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from r)
select lang, source, part, item, value, rank::int as rank from n where part = 'pair' or rank <= 200
"""
