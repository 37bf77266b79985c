"""Op 9. Suffix-array dedup of byte strings with a logarithmic family of indexes.

Batches arrive in the order of (doc_id, start). Each gets a suffix array: the positions of its windows, sorted by their
first `length` bytes, eight at a time. It is merge-scanned against the levels already there: stretches of a level that
share their first bytes with a window of the batch are merged with these windows, and equal neighbours tell where each
window came first. What is new joins the family as a level; while two levels are of about equal size they are merged
into one. Texts stay once in a common buffer, and a level holds positions and first bytes only. Passages are routed to
families by their fingerprints (passages.py), so that windows that can be equal meet in one family, and no family
holds the corpus.

Defined cases: a null text counts as empty; a null id is compared with nothing and keeps its whole text; rows that repeat
id and text are one document, and each gets its result; where an id names different texts, each loses the spans found
under the id, clipped to its length; an empty table gives an empty result; columns besides id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import table
from leafmill.llm.passages import HOT_RUNS, Bytes, merged, repeated_spans

LENGTH, GRAM = 100, 24
BATCH_WINDOWS = 1 << 17


class IndexFamily:
    """Suffix arrays of windows of `length` bytes, in levels of about doubling sizes. Positions count over all texts added."""

    def __init__(self, length: int) -> None:
        self.length, self.levels, self.used = length, [], 0
        self.buffer = np.zeros(1 << 16, np.uint8)

    def _append(self, texts: list[bytes]) -> np.ndarray:
        """The positions of the texts' windows, in order."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        need = self.used + len(data) + self.length + 8
        if need > len(self.buffer):
            grown = np.zeros(max(need, 2 * len(self.buffer)), np.uint8)
            grown[: self.used] = self.buffer[: self.used]
            self.buffer = grown
        self.buffer[self.used : self.used + len(data)] = data
        sizes = np.array([len(t) for t in texts])
        base = self.used + np.cumsum(sizes) - sizes
        many = np.maximum(0, sizes - self.length + 1)
        self.used += len(data)
        return np.repeat(base - (np.cumsum(many) - many), many) + np.arange(many.sum())

    def _word(self, positions: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 7 of each window, or as many as it has, as a number that sorts as they do."""
        every = np.ndarray((len(self.buffer) - 7 - 8 * k,), ">u8", self.buffer, 8 * k, (1,))
        out = every[positions].astype(np.uint64)
        rest = self.length - 8 * k
        return out >> np.uint64(64 - 8 * rest) if rest < 8 else out

    def _sorted(self, positions: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions sorted by their windows, equal ones as they came; their first words; whether each differs from the one before.
        Of windows that share their first words only those are sorted by the next one that differ in it."""
        word = self._word(positions, 0) if first is None else first
        order = np.argsort(word, kind="stable")
        positions, word = positions[order], word[order]
        new = np.ones(len(positions), bool)
        new[1:] = word[1:] != word[:-1]
        at = np.arange(len(positions))
        for k in range(1, (self.length + 7) // 8):
            tied = ~new[at]
            tied[:-1] |= tied[1:]
            at = at[tied]
            if not at.size:
                break
            own, head = self._word(positions[at], k), new[at]
            differs = own[1:] != own[:-1]
            differs &= ~head[1:]
            if not differs.any():
                continue
            group = np.cumsum(head) - 1
            mixed = np.zeros(group[-1] + 1, bool)
            mixed[group[1:][differs]] = True
            pick = np.flatnonzero(mixed[group])
            order = pick[np.lexsort((own[pick], group[pick]))]
            positions[at[pick]] = positions[at[order]]
            own[pick] = own[order]
            new[at[1:]] |= own[1:] != own[:-1]
        return positions, word, new

    def _scan(self, level: tuple[np.ndarray, np.ndarray], positions: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted positions those whose window the level holds, as indexes, and where it stands there."""
        held, held_words = level
        lo, hi = np.searchsorted(held_words, words, "left"), np.searchsorted(held_words, words, "right")
        maybe = np.flatnonzero(hi > lo)
        if not maybe.size:
            return maybe, maybe
        depth = np.bincount(lo[maybe], minlength=len(held) + 1) - np.bincount(hi[maybe], minlength=len(held) + 1)
        stretch = np.flatnonzero(np.cumsum(depth)[:-1] > 0)
        both, _, new = self._sorted(np.concatenate([held[stretch], positions[maybe]]), np.concatenate([held_words[stretch], words[maybe]]))
        group = np.cumsum(new) - 1
        first = both[np.flatnonzero(new)][group]  # what the level holds came before, and stands before what is equal to it
        again = ~new
        number = np.searchsorted(np.sort(positions[maybe]), both[again])
        return maybe[np.argsort(positions[maybe], kind="stable")][number], first[again]

    def add(self, texts: list[bytes]) -> np.ndarray:
        """For each window of the texts the position at which it stands first, in an earlier batch or in this one."""
        arrived = self._append(texts)
        if not len(arrived):
            return arrived
        positions, words, new = self._sorted(arrived)
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        fresh, fresh_words = positions[heads], words[heads]
        first = fresh.copy()
        for level in self.levels:
            at, where = self._scan(level, fresh, fresh_words)
            first[at] = where
        by_position = np.empty(arrived[-1] - arrived[0] + 1, np.int64)
        by_position[positions - arrived[0]] = first[group]
        unseen = first == fresh
        if unseen.any():
            self._join((fresh[unseen], fresh_words[unseen]))
        return by_position[arrived - arrived[0]]

    def _join(self, level: tuple[np.ndarray, np.ndarray]) -> None:
        while (k := next((k for k, x in enumerate(self.levels) if len(x[0]).bit_length() == len(level[0]).bit_length()), None)) is not None:
            other = self.levels.pop(k)
            positions, words, _ = self._sorted(np.concatenate([other[0], level[0]]), np.concatenate([other[1], level[1]]))
            level = positions, words
        self.levels.append(level)


def search(length: int):
    def run(doc: np.ndarray, start: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        family, found, part, size = IndexFamily(length), [], [], 0
        for t in texts:
            part.append(t)
            size += len(t) - length + 1
            if size >= BATCH_WINDOWS:
                found.append(family.add(part))
                part, size = [], 0
        if part:
            found.append(family.add(part))
        first = np.concatenate(found)
        sizes = np.array([len(t) for t in texts])
        base = np.cumsum(sizes) - sizes
        many = sizes - length + 1
        text = np.repeat(np.arange(len(texts)), many)
        earlier = np.flatnonzero(first < np.arange(len(first)) + (base - (np.cumsum(many) - many))[text])
        text[earlier] = np.searchsorted(base, first[earlier], "right") - 1
        return many, doc[text], (start - base)[text] + first

    return run


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, spans (bytes covered by a string of that length that also starts earlier, not merged)."""
    return repeated_spans(docs, Bytes, length, gram, search(length), True, id_col, text_col, hot_runs)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, spans array<struct<s, e>> (merged), kept binary for every row."""
    spans = repeated_bytes(docs, length, gram, id_col, text_col, hot_runs)
    both = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    kind = both.select("doc_id").schema[0].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, lost, kept = [], [], []
            for text, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = text or b""
                gone = merged(x or [], len(text))
                at, rest = 0, []
                for s, e in gone:
                    rest.append(text[at:s])
                    at = e
                sizes.append(len(text))
                lost.append([{"s": s, "e": e} for s, e in gone])
                kept.append(b"".join([*rest, text[at:]]) if gone else text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(lost, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return both.mapInArrow(cut, f"doc_id {kind}, n_bytes long, spans array<struct<s:long,e:long>>, kept binary")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
x as (select doc_id, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) as k from (select doc_id, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) as i from d where len(h) >= {2 * LENGTH})),
f as (select doc_id, i from (select *, row_number() over (partition by k order by doc_id, i) as rn from x) where rn > 1),
g as (select *, sum(new::int) over (partition by doc_id order by i) as span from (select *, coalesce(i > lag(i) over (partition by doc_id order by i) + {LENGTH}, true) as new from f)),
s as (select doc_id, min(i) as s, max(i) + {LENGTH} as e from g group by doc_id, span),
c as (select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 0) as was from s),
k as (select doc_id, count(*) as n_spans, sum(e - s) as n_removed, max(e) as last, string_agg(substr(h, 2 * was + 1, 2 * (s - was)), '' order by s) as kept from c join d using (doc_id) group by doc_id)
select d.doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256 from d left join k using (doc_id)
"""
