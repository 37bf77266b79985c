"""Op 11. Spelling variants: words one edit apart, grouped by errata tries.

Runs of letters are counted; the words kept are dealt into groups that share all but a block of positions. A pair whose
shorter word has c code points and whose first c' code points agree differs in the block [s, e) that holds c', so both words
share their first s and last c - e code points and meet, once, in the group of those. Blocks are halves at first; a group
of more than GROUP_CHARS code points is dealt again by half of its block, until a block is one position, where a group is
bounded by the square of the alphabet. No group is taken apart by sampling, and none grows with the corpus.

Within a group a trie is built. At every node the largest child is its heavy child; the light subtrees are merged, the smaller into
the larger, with their first character replaced, and the result is walked against the heavy subtree; each light subtree is
walked with its first character skipped against the node, and the node's light side against the heavy child with that one
skipped. Where two words end at one place they are one edit apart. Each word is in a light subtree at most log n times, and
as both words leave the node where they first differ, each pair is met once.

Words leave a group as their number of near words and the best of them; pairs are never written. A word's form is a near word at
least RATIO times as frequent, so chains of forms rise, and roots are found by doubling steps of joins.

Defined cases: a null text has no runs; a null id reads as '' in the digest that picks runs for deletion; rows that repeat id and
text count again; a run loses its only code point to the empty word, which is too short to count; of near words equally frequent
the first in code-point order is the form; empty tables give an empty result; other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import materialise, small_enough, table
from leafmill.llm.passages import column_chunks

LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: A run whose digest it divides loses a code point.
DIVISOR = 199
#: Text handled at once in a task; words counted before they are passed on, by number and bytes.
CHUNK_BYTES, HELD_WORDS, HELD_BYTES = 4 << 20, 200_000, 16 << 20
#: Code points of the words of one group, besides HEAD for each word.
GROUP_CHARS, HEAD = 400_000, 8
BROADCAST_GROUPS = 100_000
#: In UTF-8, U+00C0 to U+00FF are the bytes C3 80 to C3 BF.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def changed(run: bytes, digest: int) -> bytes:
    """The run without the code point that its digest names."""
    text = run.decode()
    at = digest % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def text_words(doc_id: str, text: bytes, counts: dict[bytes, int], divisor: int = DIVISOR) -> None:
    """Adds a text's runs to counts, with a code point less in those that the digest of id and run picks."""
    own: dict[bytes, int] = {}
    for run in _RUN.findall(text.translate(_LOWER)):
        own[run] = own.get(run, 0) + 1
    crc, begun = zlib.crc32, zlib.crc32(f"{doc_id}:".encode())
    for run, n in own.items():
        h = crc(run, begun)
        if not h % divisor:
            run = changed(run, h)
        counts[run] = counts.get(run, 0) + n


def count_words(least_chars: int):
    """(id as string, text as bytes) to (word, n) of words that are long enough."""

    def told(counts: dict[bytes, int]) -> pa.RecordBatch:
        rows = [(w, n) for b, n in counts.items() if len(w := b.decode()) >= least_chars]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        seen = 0
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, texts in column_chunks(b.column(1), CHUNK_BYTES):
                for k, t in enumerate(texts):
                    text_words(ids[at + k], t, counts)
                    seen += len(t)
                if len(counts) > HELD_WORDS or seen > HELD_BYTES and sum(map(len, counts)) > HELD_BYTES:
                    yield told(counts)
                    counts, seen = {}, 0
        yield told(counts)

    return count


class Trie:
    """The trie of sorted, different words: children, the word that ends at a node (or -1), depth and words below."""

    def __init__(self, words: list[str]) -> None:
        self.kids: list[dict[str, int]] = [{}]
        self.end, self.depth, self.size = [-1], [0], []
        for i, w in enumerate(words):
            at = 0
            for d, ch in enumerate(w):
                to = self.kids[at].get(ch)
                if to is None:
                    to = self.kids[at][ch] = len(self.kids)
                    self.kids.append({})
                    self.end.append(-1)
                    self.depth.append(d + 1)
                at = to
            self.end[at] = i
        self.size = [int(e >= 0) for e in self.end]
        for at in range(len(self.kids) - 1, -1, -1):  # children come after their parents
            self.size[at] += sum(self.size[k] for k in self.kids[at].values())

    def meet(self, a: int, b: int, without: str = "", only: list[str] | None = None) -> Iterator[tuple[int, int]]:
        """Words that end at the same place below a and below b; at first a has only the children `only`, and b lacks `without`."""
        kids, end = self.kids, self.end
        if end[a] >= 0 and end[b] >= 0:
            yield end[a], end[b]
        todo = []
        for ch in kids[a] if only is None else only:
            if ch != without and (to := kids[b].get(ch)) is not None:
                todo.append((kids[a][ch], to))
        while todo:
            a, b = todo.pop()
            if end[a] >= 0 and end[b] >= 0:
                yield end[a], end[b]
            other = kids[b]
            if other:
                for ch, k in kids[a].items():
                    if (to := other.get(ch)) is not None:
                        todo.append((k, to))

    def replaced(self, heavy: int, light: list[int]) -> Iterator[tuple[int, int]]:
        """Words of the children heavy and light that are equal after their first character; light ones by size, the largest first."""
        kids, end = self.kids, self.end
        if len(light) == 1:
            yield from self.meet(light[0], heavy)
            return
        merged: list[dict[str, int]] = [{}]
        words: list[list[int]] = [[]]
        for top in light:
            todo = [(top, 0)]
            while todo:
                a, m = todo.pop()
                if end[a] >= 0:
                    for w in words[m]:
                        yield w, end[a]
                    words[m].append(end[a])
                for ch, k in kids[a].items():
                    to = merged[m].get(ch)
                    if to is None:
                        to = merged[m][ch] = len(merged)
                        merged.append({})
                        words.append([])
                    todo.append((k, to))
        todo = [(0, heavy)]
        while todo:
            m, b = todo.pop()
            if end[b] >= 0:
                for w in words[m]:
                    yield w, end[b]
            for ch, k in merged[m].items():
                if (to := kids[b].get(ch)) is not None:
                    todo.append((k, to))

    def pairs(self, most_depth: int | None = None) -> Iterator[tuple[int, int]]:
        """Each pair of words one edit apart, once; with most_depth, those that agree in fewer than so many first characters."""
        for at, kids in enumerate(self.kids):
            if not kids or (most_depth is not None and self.depth[at] >= most_depth):
                continue
            heavy_ch = max(kids, key=lambda ch: self.size[kids[ch]])
            heavy = kids[heavy_ch]
            light = sorted((ch for ch in kids if ch != heavy_ch), key=lambda ch: -self.size[kids[ch]])
            if light:
                yield from self.replaced(heavy, [kids[ch] for ch in light])
                for ch in light:
                    yield from self.meet(kids[ch], at, without=ch)
            yield from self.meet(at, heavy, only=light)


def group_rows(words: list[str], n: list[int], s: int, e: int, c: int, out: list) -> None:
    """Appends (word, near words, the best one's count, the best one) for words of one sorted group; words share all but the block [s, e)."""
    width = e - s
    middle = [w[s : len(w) - (c - e)] for w in words]
    near, best = [0] * len(words), [(0, "")] * len(words)
    for i, j in Trie(middle).pairs(None if e == c else width):
        if len(words[i]) == len(words[j]) > c:  # these meet in the groups of their own length
            continue
        for x, y in ((i, j), (j, i)):
            near[x] += 1
            if best[x][0] < n[y] or best[x][0] == n[y] and words[y] < best[x][1]:
                best[x] = (n[y], words[y])
    out += [(words[i], near[i], *best[i]) for i in range(len(words)) if near[i]]


_NEAR = "word string, near long, best_n long, best string"
_GROUP = ["c", "s", "e", "pre", "suf"]


def near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, s, e, pre, suf, word, n) sorted by group and word to the near words of each word in its group."""
    key, words, n, out = None, [], [], []

    def told() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        batch = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["word", "near", "best_n", "best"])
        out.clear()
        return batch

    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
            if row[:5] != key:
                if len(words) > 1:
                    group_rows(words, n, key[1], key[2], key[0], out)
                key, words, n = row[:5], [], []
            words.append(row[5])
            n.append(row[6])
        yield told()
    if len(words) > 1:
        group_rows(words, n, key[1], key[2], key[0], out)
    yield told()


def _dealt(words: DataFrame, blocks) -> DataFrame:
    """Rows of each word in the groups of its blocks: an array of (c, s, e) for each row."""
    rows = words.select("word", "n", F.explode(blocks).alias("b")).select("b.c", "b.s", "b.e", "word", "n")
    return rows.select("c", "s", "e", F.expr("substring(word, 1, s)").alias("pre"), F.expr("if(c > e, right(word, c - e), '')").alias("suf"), "word", "n")


def near_words(words: DataFrame, least_chars: int = LEAST_CHARS, group_chars: int = GROUP_CHARS) -> DataFrame:
    """For each of words (word, n; words are different) with near words: word, n_near, form (the best near word), form_n."""
    length = F.char_length("word")
    classes = F.filter(F.array(length, length - 1), lambda c: c >= least_chars)  # as the shorter word of a pair, and as the longer one
    halves = F.flatten(F.transform(classes, lambda c: F.array(F.struct(c.alias("c"), F.lit(0).alias("s"), (c / 2).cast("int").alias("e")), F.struct(c.alias("c"), (c / 2).cast("int").alias("s"), c.alias("e")))))
    todo, ready = _dealt(words, halves), None
    while True:
        size = todo.groupBy(*_GROUP).agg(F.sum(F.char_length("word") - F.col("s") - (F.col("c") - F.col("e")) + HEAD).alias("size"))
        hot = materialise(size.where((F.col("size") > group_chars) & (F.col("e") - F.col("s") > 1)).select(*_GROUP), "hot")
        if hot.isEmpty():
            ready = todo if ready is None else ready.unionByName(todo)
            break
        told = F.broadcast(hot) if small_enough(hot, BROADCAST_GROUPS, 16 << 20) else hot
        cool = todo.join(told, _GROUP, "left_anti")
        ready = cool if ready is None else ready.unionByName(cool)
        middle = F.floor((F.col("s") + F.col("e")) / 2).cast("int")
        parts = F.array(F.struct("c", "s", middle.alias("e")), F.struct("c", middle.alias("s"), "e"))
        todo = materialise(_dealt(todo.join(told, _GROUP, "left_semi"), parts), "split")
    found = ready.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "word").mapInArrow(near_rows, _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.word").alias("form"), (-F.col("b.n")).alias("form_n"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): the word at the end of each chain of forms. Each step doubles what has been followed."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.alias("x").join(now.select(F.col("word").alias("root"), F.col("root").alias("_next")).alias("y"), "root", "left")
        after = materialise(further.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        now = after.select("word", "root")
        if after.where("_moved").isEmpty():
            return now


def variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO, id_col: str = "doc_id", text_col: str = "text", group_chars: int = GROUP_CHARS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs that is long and frequent enough."""
    read = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    words = materialise(read.mapInArrow(count_words(least_chars), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count), "words")
    near = words.join(near_words(words, least_chars, group_chars), "word", "left")
    much = F.col("form_n") >= ratio * F.col("n")
    told = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, F.col("form")).alias("form"), F.when(much, F.col("form_n")).alias("form_n"))
    told = materialise(told, "forms")
    roots = last_forms(told.where("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with recursive t as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
r as (select doc_id, run, count(*) as n from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as run from documents) group by all),
x as (select run, n, hex(encode(doc_id || ':' || run)) as h from r),
c as (select run, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::bigint as h from x, t),
w as (select word, sum(n)::bigint as n from (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from c) where length(word) >= 6 group by word having sum(n) >= 5),
d as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as v from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
p as (select distinct a.word, b.word as near, b.n as near_n from d a join d b on a.i = b.i and a.v = b.v and a.word <> b.word
  union select distinct d.word, w.word, w.n from d join w on d.v = w.word union select distinct w.word, d.word, d.n from d join w on d.v = w.word),
b as (select word, count(*) as n_near, max(near_n) as best_n from p group by word),
f as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when best_n >= 5 * w.n then (select near from p where p.word = w.word and near_n = best_n order by encode(near) limit 1) end as form, case when best_n >= 5 * w.n then best_n end::bigint as form_n from w left join b using (word)),
s as (select word, word as at from w union select s.word, f.form from s join f on f.word = s.at where f.form is not null)
select f.word, f.form, s.at as root, f.n, f.n_near, f.form_n from f join s using (word) join f g on g.word = s.at where g.form is null
"""
