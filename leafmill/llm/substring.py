"""Op 4. Substring dedup with a compressed FM-index per shard.

Passages are routed to shards by their fingerprints (passages.py). A shard's index is the Burrows-Wheeler transform of
its passages over a word alphabet, kept in a wavelet matrix of packed bits; documents' passages are streamed against it
from right to left, many at a time. A backward-search step extends each match by one word to the left. Where that is not
possible the match loses words at its right end, as many as it takes to reach the next larger interval, until it is: so
each position gets its matching statistic, the longest match that starts there (up to the passage length), with the
interval of its occurrences. Matches of the full length are reported, with the least document of the interval.

Defined cases: a null text has no words; a null id is compared with nothing and keeps all words; rows that repeat id and
text are one document, and each gets its result; where an id names different texts, each loses the spans found under
the id, clipped to its words; an empty table gives an empty result; columns besides id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import table
from leafmill.llm.passages import HOT_RUNS, Words, merged, repeated_spans

LENGTH, GRAM = 50, 8


class WaveletMatrix:
    """Rank queries on a sequence of small integers, one packed bit plane for each bit, the highest first."""

    def __init__(self, seq: np.ndarray) -> None:
        self.bits = max(1, int(seq.max(initial=1)).bit_length())
        self.planes, self.counts, self.zeros = [], [], []
        for k in range(self.bits - 1, -1, -1):
            bit = ((seq >> k) & 1).astype(bool)
            padded = np.zeros((len(seq) // 64 + 1) * 64, bool)
            padded[: len(seq)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.planes.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.int64))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` comes to lie among the symbols' own last level; differences are counts."""
        for level, (words, counts, zeros) in enumerate(zip(self.planes, self.counts, self.zeros, strict=True)):
            word = at >> 6
            ones = counts[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> (self.bits - 1 - level)) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Index of word sequences (small integers from 1; 0 ends a sequence), each of a document, for matches up to `depth`."""

    def __init__(self, sequences: list[np.ndarray], docs: np.ndarray, depth: int) -> None:
        self.depth = depth
        sizes = np.array([len(s) + 1 for s in sequences])
        text = np.zeros(sizes.sum(), np.int64)
        ends = np.cumsum(sizes)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        text[inside] = np.concatenate(sequences)
        order, names = self._suffixes(text, depth)
        self.size = len(text)
        self.bwt = WaveletMatrix(text[order - 1])
        self.symbols = int(text.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        every = np.arange(self.symbols)
        self.base = self.bwt.rank(every, np.zeros(self.symbols, np.int64))
        self.common = self._common(order, names)
        self.left, self.right = self._smaller()
        # suffixes that share depth - 1 words, and the least document of those that share depth words
        self.first, self.end = self._intervals(depth - 1)
        begin, _ = self._intervals(depth)
        starts = np.unique(begin)
        self.least = np.minimum.reduceat(np.repeat(docs, sizes)[order], starts)[np.searchsorted(starts, begin)]

    @staticmethod
    def _suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Order of the suffixes by their first words, at least `depth`, then by position; and names of their first 1, 2, 4, ... words."""
        n = len(text)
        name, size, names = text, 1, {1: text}
        while size < depth:
            ahead = np.zeros(n, np.int64)
            ahead[: n - size] = name[size:] + 1
            _, name = np.unique((name << 32) | ahead, return_inverse=True)
            size *= 2
            names[size] = name
        return np.argsort(name, kind="stable"), names

    def _common(self, order: np.ndarray, names: dict[int, np.ndarray]) -> np.ndarray:
        """For each rank, and one more: how many first words, up to `depth`, its suffix shares with that of the rank before; -1 at both ends."""
        n = len(order)
        a, b = order[:-1].copy(), order[1:].copy()
        shared = np.zeros(n - 1, np.int64)
        for size in sorted(names, reverse=True):
            inside = (a < n) & (b < n)
            same = np.zeros(n - 1, bool)
            same[inside] = names[size][a[inside]] == names[size][b[inside]]
            step = same * size
            shared, a, b = shared + step, a + step, b + step
        return np.concatenate([[-1], np.minimum(shared, self.depth), [-1]])

    def _smaller(self) -> tuple[np.ndarray, np.ndarray]:
        """For each rank the nearest ranks to the left and right that share less with the rank before them."""
        n = len(self.common)
        left, right, at = np.zeros(n, np.int64), np.full(n, n - 1), np.arange(n)
        for depth in np.unique(self.common[1:-1]):
            here, less = self.common == depth, self.common < depth
            left[here] = np.maximum.accumulate(np.where(less, at, 0))[here]
            right[here] = np.minimum.accumulate(np.where(less, at, n - 1)[::-1])[::-1][here]
        return left, right

    def _intervals(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        change = np.flatnonzero(self.common[:-1] < depth)
        sizes = np.diff(np.append(change, self.size))
        return np.repeat(change, sizes), np.repeat(change + sizes, sizes)

    def step(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward-search step: the intervals of symbol + match."""
        shift = self.before[symbol] - self.base[symbol]
        return self.bwt.rank(symbol, lo) + shift, self.bwt.rank(symbol, hi) + shift

    def shorten(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next larger intervals, with the number of words that their suffixes share."""
        a, b = self.common[lo], self.common[hi]
        depth = np.maximum(np.maximum(a, b), 0)
        return np.where(a >= b, self.left[lo], lo), np.where(b >= a, self.right[hi], hi), depth

    def matches(self, sequences: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Matching statistics of any sequences: for each position the words of the longest match that starts there, up to `depth`, and the
        least document in which a match of `depth` words stands; a large number where there is none."""
        none = np.iinfo(np.int64).max
        sizes = np.array([len(s) for s in sequences], np.int64)
        lanes = np.argsort(-sizes, kind="stable")
        sizes = sizes[lanes]
        ends = np.cumsum(sizes)
        flat = np.concatenate([sequences[i] for i in lanes]) if lanes.size else np.zeros(0, np.int64)
        length, least = np.zeros(len(flat), np.int64), np.full(len(flat), none)
        lo, hi, depth = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.size), np.zeros(len(lanes), np.int64)
        for t in range(1, int(sizes[0]) + 1 if lanes.size else 1):
            live = int(np.searchsorted(-sizes, -t, side="right"))  # lanes with at least t words
            at = ends[:live] - t
            symbol = flat[at]
            a, b, d = lo[:live], hi[:live], depth[:live]
            full = d == self.depth
            a, b, d = np.where(full, self.first[np.minimum(a, self.size - 1)], a), np.where(full, self.end[np.minimum(a, self.size - 1)], b), np.where(full, self.depth - 1, d)
            unknown = (symbol < 1) | (symbol >= self.symbols)
            a[unknown], b[unknown], d[unknown] = 0, self.size, 0
            todo = np.flatnonzero(~unknown)
            while todo.size:
                x, y = self.step(a[todo], b[todo], symbol[todo])
                good = x < y
                hit = todo[good]
                a[hit], b[hit], d[hit] = x[good], y[good], d[hit] + 1
                todo = todo[~good]
                todo = todo[d[todo] > 0]
                a[todo], b[todo], d[todo] = self.shorten(a[todo], b[todo])
            lo[:live], hi[:live], depth[:live] = a, b, d
            length[at] = d
            hit = np.flatnonzero(d == self.depth)
            least[at[hit]] = self.least[a[hit]]
        out: tuple[list, list] = [none] * len(sequences), [none] * len(sequences)
        for i, x, y in zip(lanes.tolist(), np.split(length, ends[:-1]), np.split(least, ends[:-1]), strict=True) if lanes.size else ():
            out[0][i], out[1][i] = x, y
        return out

    def earliest(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of `depth` words of each sequence the least document in which it stands; a large number if none."""
        return [least[: max(0, len(s) - self.depth + 1)] for s, least in zip(sequences, self.matches(sequences)[1], strict=True)]


def search(length: int):
    def run(doc: np.ndarray, start: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids: dict[bytes, int] = {}
        sequences = [np.array([ids.setdefault(w, len(ids) + 1) for w in t.split()], np.int64) for t in texts]
        first: dict[bytes, int] = {}  # a text is indexed once, for its first document
        once = [i for i, t in enumerate(texts) if first.setdefault(t, i) == i]
        index = FMIndex([sequences[i] for i in once], doc[once], length)
        found = dict(zip(once, index.earliest([sequences[i] for i in once]), strict=True))
        least = [found[first[t]] for t in texts]
        every = np.concatenate(least)
        return np.array([len(x) for x in least]), every, np.zeros(len(every), np.int64)

    return run


def repeated_words(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, spans (words covered by a window of that length that also stands in a document with a smaller id, not merged)."""
    return repeated_spans(docs, Words, length, gram, search(length), False, id_col, text_col, hot_runs)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_words, spans array<struct<s, e>> (merged, in words), kept string for every row."""
    spans = repeated_words(docs, length, gram, id_col, text_col, hot_runs)
    both = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    kind = both.select("doc_id").schema[0].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, lost, kept = [], [], []
            for text, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                gone = merged(x or [], len(words))
                at, rest = 0, []
                for s, e in gone:
                    rest += words[at:s]
                    at = e
                sizes.append(len(words))
                lost.append([{"s": s, "e": e} for s, e in gone])
                kept.append(b" ".join(rest + words[at:]).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(lost, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(kept, pa.string())], ["doc_id", "n_words", "spans", "kept"])

    return both.mapInArrow(cut, f"doc_id {kind}, n_words long, spans array<struct<s:long,e:long>>, kept string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = rf"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
x as (select doc_id, i, md5(array_to_string(w[i : i + {LENGTH - 1}], ' ')) as k from (select doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) as i from w where len(w) >= {LENGTH})),
f as (select k, min(doc_id) as first from x group by k),
r as (select distinct x.doc_id, unnest(range(i, i + {LENGTH})) as j from x join f using (k) where first < x.doc_id),
p as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as j from w),
k as (select doc_id, count(r.j) as n_removed, string_agg(word, ' ' order by j) filter (r.j is null) as kept from p left join r using (doc_id, j) group by doc_id)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k using (doc_id)
"""
