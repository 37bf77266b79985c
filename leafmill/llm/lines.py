"""Op 13. Line dedup, with DataFrame functions only.

A text is split at line feeds. A line's key is the line stripped of ASCII white space, with A-Z lower-cased; keys are told
by two 64-bit hashes. For every hash the distinct documents that hold it are counted; a key of at least MIN_CHARS code
points in at least MIN_DOCS documents loses all its lines, and what is left is put together again by position.

Each document gives a hash once, and counts are summed before the shuffle, so a line that a third of all documents hold
is as many narrow rows as tasks. Frequent hashes are broadcast up to BROADCAST_KEYS; beyond that they are joined by a
shuffle in which those with more than a HOT_SHARE-th of all lines are still broadcast (HOT_SHARE of them at most), so that
no task takes the lines of one key. Texts are shuffled once, to meet the positions they lose.

Defined cases: a null or empty text is one empty line; empty keys are never dropped; a line that occurs several times in
one document counts it once; rows that repeat id and text are one document, and each gets its row; rows that share an id
with different texts are different documents; a null id is an id like others; empty tables give an empty result; columns
besides id and text are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import materialise, small_enough, table
from leafmill.llm.decontaminate import let

MIN_DOCS, MIN_CHARS = 10, 1
#: Frequent keys (two longs each) that may be broadcast.
BROADCAST_KEYS = 200_000
#: A key with more than one in HOT_SHARE of all lines is broadcast, however many frequent keys there are.
HOT_SHARE = 10_000
#: What is stripped at both ends of a line: the blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """A struct of two hashes for each line in order, null where the key is shorter than min_chars."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    key = lambda line: let(F.btrim(line, F.lit(BLANKS)), lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))))
    return F.transform(F.split(low, "\n", -1), key)


def distinct_keys(keys: Column) -> Column:
    """Each key of the array once; sorted, as array_distinct() compares all pairs of structs."""
    known = F.array_sort(F.filter(keys, lambda k: k.isNotNull()))
    return let(known, lambda s: F.filter(s, lambda k, i: (i == 0) | (k != F.get(s, i - 1))))


def frequent_keys(docs: DataFrame, min_docs: int, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """a, b of keys in at least min_docs documents, with `lines`, a count of (document, key) rows.

    Where no id repeats, rows are documents. Otherwise rows are told apart by id and text before they are counted.
    """
    own = distinct_keys(line_keys(F.col(text_col), min_chars))
    repeats = not docs.groupBy(id_col).count().where("count > 1").isEmpty()
    if not repeats:
        held = docs.select(F.explode_outer(own).alias("k")).where("k is not null").select("k.a", "k.b")
    else:
        held = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("t"), F.explode_outer(own).alias("k")).where("k is not null").select("k.a", "k.b", "i", "t").distinct()
    return held.groupBy("a", "b").agg(F.count("*").alias("lines")).where(F.col("lines") >= min_docs)


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (text without the lines of frequent keys) for every row of docs."""
    often = materialise(frequent_keys(docs, min_docs, min_chars, id_col, text_col), "frequent")
    me = [F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_t")]
    at = docs.select(*me, F.posexplode_outer(line_keys(F.col(text_col), min_chars)).alias("p", "k")).where("k is not null").select("doc_id", "_t", "p", "k.a", "k.b")
    if small_enough(often, broadcast_keys):
        lost = at.join(F.broadcast(often.select("a", "b")), ["a", "b"], "left_semi")
    else:
        limit = often.agg(F.sum("lines")).first()[0] // HOT_SHARE
        hot, rest = F.broadcast(often.where(F.col("lines") > limit).select("a", "b")), often.where(F.col("lines") <= limit).select("a", "b")
        lost = at.join(hot, ["a", "b"], "left_semi").unionByName(at.join(hot, ["a", "b"], "left_anti").join(rest, ["a", "b"], "left_semi"))
    # equal rows lose equal positions, each told once for every row
    gone = lost.groupBy("doc_id", "_t").agg(F.collect_set("p").alias("_gone"))
    lines = docs.select(*me, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("_lines"))
    d, g = lines.alias("d"), gone.alias("g")
    both = d.join(g, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d._t") == F.col("g._t")), "left").select("d.doc_id", "_lines", "_gone")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.array_join("_lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    return both.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = drop_lines(table(spark, sf_dir, "documents"))
    return told.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
with l as (select doc_id, p, v[p] as line, translate(trim(v[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, v, unnest(range(1, len(v) + 1)) as p from (select doc_id, string_split(coalesce(text, ''), chr(10)) as v from documents))),
f as (select key from l where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*)::bigint as n_lines, count(f.key)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by p) filter (f.key is null), '')) as kept_sha256
from l left join f using (key) group by doc_id
"""
