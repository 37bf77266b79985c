"""Op 1. Benchmark decontamination by winnowing, with DataFrame functions only.

Every window of WINDOW words keeps the least hash of its GRAM-word grams; neighbouring windows mostly keep the same
one, so a text is known by few fingerprints, and two texts that share a window share its fingerprint. Documents'
fingerprints are joined to the benchmark's; a hit is extended to the windows it stands for, which are compared word for
word. An item of fewer than WINDOW words is one window of its own length; such lengths are looked up at every position.

The benchmark's distinct windows are counted; up to BROADCAST_WINDOWS of them are broadcast, and documents are read
once. With more, fingerprints and windows are joined by shuffles in which AQE may split hot keys.

Defined cases: a null or empty text, or one without words, has no words and no hits; items without words are never
found; repeated item ids count once; items with a null id are sought too, and count as one item whose id is left out of
the digest; rows that repeat both id and text are one document; a null id is kept; empty
tables give an empty result, or one without hits; columns besides id and text are left out.
"""

from __future__ import annotations

# explode_outer throughout: before a plain explode, Spark infers a filter on the size of the array, and moving that filter
# below the projection of the words would compute the words again for every element.
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import materialise, small_enough, table

WINDOW, GRAM = 10, 5
#: Windows, and bytes of their words and item ids, that may be broadcast.
BROADCAST_WINDOWS, BROADCAST_BYTES = 200_000, 64 << 20
#: A word, once A-Z are lower-cased: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then uses it."""
    return F.transform(F.array(value), then)[0]


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)  # lower() is fast and the same for these
    return F.regexp_extract_all(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), F.lit(WORD), F.lit(0))


def gram_hashes(words: Column, gram: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - gram), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(gram)]))


def window_hashes(words: Column, window: int, gram: int) -> Column:
    """For each window of so many words the least hash of its grams; empty if there are fewer words."""
    hashes = let(gram_hashes(words, gram), lambda g: F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.array_min(F.slice(g, i, window - gram + 1))))
    return F.when(F.size(words) >= window, hashes).otherwise(F.array().cast("array<bigint>"))


_RUN = "array<struct<s:int,e:int,h:bigint,n:int>>"


def fingerprints(words: Column, window: int, gram: int, short: list[int]) -> Column:
    """Runs of windows that keep the same hash: first start s, end e, hash h, words n of a window. For each length in short, every position."""

    def runs(m: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
        return let(starts, lambda s: F.transform(s, lambda x, k: F.struct(x.alias("s"), F.coalesce(F.get(s, k + 1), F.size(m)).alias("e"), F.get(m, x).alias("h"), F.lit(window).alias("n"))))

    parts = [F.when(F.size(words) >= window, let(window_hashes(words, window, gram), runs)).otherwise(F.array().cast(_RUN)).cast(_RUN)]
    def every(n: int) -> Column:
        at = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.struct(i.alias("s"), (i + 1).alias("e"), F.xxhash64(F.slice(words, i + 1, n)).alias("h"), F.lit(n).alias("n")))
        return F.when(F.size(words) >= n, at).otherwise(F.array().cast(_RUN)).cast(_RUN)

    parts += [every(n) for n in short]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def benchmark_windows(items: DataFrame, window: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows: key (words joined by a space), n (words), h (fingerprint), items (ids as strings, a null among them)."""
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    long = words.where(F.size("w") >= window).select("item", "w", F.posexplode_outer(window_hashes(F.col("w"), window, gram)).alias("at", "h"))
    long = long.select("item", F.array_join(F.slice("w", F.col("at") + 1, window), " ").alias("key"), F.lit(window).alias("n"), "h").where("h is not null")
    short = words.where(F.size("w") < window).select("item", F.array_join("w", " ").alias("key"), F.size("w").alias("n"), F.xxhash64("w").alias("h"))
    return long.unionByName(short).groupBy("key", "n", "h").agg(F.collect_set(F.struct("item")).alias("items")).withColumn("items", F.col("items.item"))


def covered(spans: Column) -> Column:
    """How many positions lie in at least one of the spans (s, n)."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct(
        (a["total"] + F.greatest(F.lit(0), x["s"] + x["n"] - F.greatest(a["end"], x["s"]))).cast("long").alias("total"), F.greatest(a["end"], x["s"] + x["n"]).alias("end")
    )
    return F.aggregate(F.array_sort(spans), start, step)["total"]


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """For each document: doc_id, text_hash, n_words, spans array<struct<s, n>> (windows found), items array<string>, sorted, a null last."""
    known = materialise(benchmark_windows(items, window, gram, item_id_col, item_text_col), "windows")
    short = sorted(r["n"] for r in known.where(F.col("n") < window).select("n").distinct().collect())
    marks = known.select("h", "n").distinct().withColumn("known", F.lit(True))
    keys = known.select("key", "n", "items")
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), words_of(F.col(text_col)).alias("w"))
    found_runs = fingerprints(F.col("w"), window, gram, short)
    key_of = lambda i: F.array_join(F.slice("w", i + 1, F.col("r.n")), " ")
    whole = F.array(F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.lit(0).cast("long").alias("h"), F.lit(0).alias("n")).cast(_RUN[6:-1]))  # stands for the document itself
    if small_enough(known, broadcast_windows, BROADCAST_BYTES):
        runs = base.withColumn("runs", F.concat(whole, found_runs)).select("doc_id", "text_hash", "w", F.explode_outer("runs").alias("r"))
        alive = runs.join(F.broadcast(marks), (F.col("r.h") == marks["h"]) & (F.col("r.n") == marks["n"]), "left").where("known or r.s < 0")
        at = F.when(F.col("r.s") < 0, F.array(F.struct(F.lit(-1).alias("s"), F.lit("").alias("key")))).otherwise(F.transform(F.sequence(F.col("r.s"), F.col("r.e") - 1), lambda i: F.struct(i.alias("s"), key_of(i).alias("key"))))
        windows = alive.select("doc_id", "text_hash", F.when(F.col("r.s") < 0, F.size("w")).alias("n_words"), F.col("r.n").alias("wn"), F.explode_outer(at).alias("x"))
        told = windows.join(F.broadcast(keys), (F.col("x.key") == keys["key"]) & (F.col("wn") == keys["n"]), "left").where("items is not null or x.s < 0")
        told = told.select("doc_id", "text_hash", "n_words", F.when(F.col("x.s") >= 0, F.struct(F.col("x.s").alias("s"), F.col("wn").alias("n"))).alias("span"), "items")
    else:
        runs = base.select("doc_id", "text_hash", F.explode_outer(found_runs).alias("r")).select("doc_id", "text_hash", "r.s", "r.e", "r.h", "r.n").where("h is not null")
        alive = runs.join(marks, ["h", "n"], "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("s", "e", "n")).alias("runs"))
        again = base.alias("b").join(alive.alias("a"), F.col("b.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("b.text_hash") == F.col("a.text_hash"))).select("b.doc_id", "b.text_hash", "w", F.explode_outer("runs").alias("r"))
        at = F.transform(F.sequence(F.col("r.s"), F.col("r.e") - 1), lambda i: F.struct(i.alias("s"), key_of(i).alias("key")))
        windows = again.select("doc_id", "text_hash", F.col("r.n").alias("n"), F.explode_outer(at).alias("x")).select("doc_id", "text_hash", "n", "x.s", "x.key")
        told = windows.join(keys, ["key", "n"]).select("doc_id", "text_hash", F.lit(None).cast("int").alias("n_words"), F.struct("s", "n").alias("span"), "items")
        told = told.unionByName(base.select("doc_id", "text_hash", F.size("w").alias("n_words"), F.lit(None).cast("struct<s:int,n:int>").alias("span"), F.lit(None).cast("array<string>").alias("items")))
    return told.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"), F.collect_set("span").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as k
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)),
ns as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as k
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, ns where len(w) >= n)),
h as (select dw.doc_id, dw.n, dw.i, bw.item_id from dw join bw using (n, k)),
p as (select doc_id, count(distinct j) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as j from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from h) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(p.n_hit, 0)::bigint as n_hit, coalesce(t.n_items, 0)::bigint as n_items,
  sha256(coalesce(t.items, '')) as items_sha256, coalesce(p.n_hit, 0) > 0 as contaminated
from d left join p using (doc_id) left join t using (doc_id)
"""
