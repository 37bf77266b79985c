"""Where documents repeat passages of a fixed length: what ops 4 and 9 share.

Texts are sequences of units (bytes, or words). Each window of `length` units keeps the least hash of its grams
(winnowing); a run is a stretch of windows that keep the same one. Equal windows keep equal hashes, so they meet in the
group of that hash, and only there; a hash that one run has is dropped after one shuffle of narrow rows. A group's
distinct texts make part of a shard's index (see substring.py and suffix_family.py), which tells for each window where
it stands first; runs with the text of an earlier run name that text to the index instead of bringing it again.

Copies are thinned out before they are shuffled: of the runs of one batch with one text, all but the first few repeat
one of them, and are dealt out at random. Of those that reach a group, the index is asked for the first CHECKED of each text.
A group with more than HOT_RUNS distinct texts, such as what surrounds a very common line, is not gathered: its runs are
taken apart into single windows, which are dealt out by their own content, the least one of each batch for all equal ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import materialise

#: Units of text that are hashed at once.
CHUNK = 1 << 18
#: A longer run, as in a text that repeats one unit, is cut into runs of so many windows.
LONGEST_RUN = 4096
HOT_RUNS = 2000
#: Of the runs with one text: how many of one batch are dealt to its group, and for how many of these the index is asked.
DEALT, CHECKED = 8, 100
#: Bytes of distinct texts, and rows of 64 bytes that name one, that are indexed and looked up at once.
INDEX_BYTES, ROW_BYTES = 2 << 20, 64
#: Windows whose answers are told at once.
FLAGS = 1 << 20

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_TABLE = np.random.default_rng(20).integers(0, 2**64, 256, np.uint64)
_POWERS = np.random.default_rng(21).integers(0, 2**64, 4096, np.uint64) | np.uint64(1)


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _M1
    x += b * _M2
    x ^= x >> np.uint64(29)
    x *= _M3
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k units from each position, by doubling."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, size, out, done = units, 1, None, 0
    while True:
        if k & size:
            out = level[:n].copy() if out is None else join(out, level[done : done + n])
            done += size
        if size * 2 > k:
            return out
        level = join(level[: len(level) - size], level[size:])
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size, level = 1, x
    while size * 2 <= w:
        level = np.minimum(level[: len(level) - size], level[size:])
        size *= 2
    return level if size == w else np.minimum(level[: len(x) - w + 1], level[w - size : w - size + len(x) - w + 1])


class Bytes:
    """Units are bytes."""

    @staticmethod
    def split(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The joined text, its units' hashes, where each unit starts in it, and where each text's units start."""
        buf = b"".join(texts)
        ends = np.cumsum([0, *map(len, texts)])
        return buf, _TABLE[np.frombuffer(buf, np.uint8)], np.arange(len(buf) + 1), ends

    @staticmethod
    def gap() -> int:
        return 0


class Words:
    """Units are words between ASCII white space, joined by one space."""

    @staticmethod
    def split(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        words = [t.split() for t in texts]
        first = np.cumsum([0, *map(len, words)])
        joined = [b" ".join(w) for w in words if w]
        if not joined:
            return b"", np.zeros(0, np.uint64), np.zeros(1, np.int64), first
        buf = b" ".join(joined) + b" "
        b = np.frombuffer(buf, np.uint8)
        starts = np.concatenate([[0], np.flatnonzero(b == 32) + 1])
        at = np.arange(len(b)) - np.repeat(starts[:-1], np.diff(starts))
        return buf, np.add.reduceat(_TABLE[b] * _POWERS[at % len(_POWERS)], starts[:-1]), starts, first

    @staticmethod
    def gap() -> int:
        return 1


def column_chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, list]]:
    """First row and texts of pieces of about `size` bytes, so that a batch is not held twice."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="left")) + 1
        yield start, column.slice(start, stop - start).to_pylist()
        start = stop


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def runs(texts: list[bytes], units, length: int, gram: int, within: bool) -> tuple[np.ndarray, ...]:
    """For each run: index of its text, first window, windows, hash it keeps, hash of its whole text. within: the number of
    windows is negative where the kept gram stands in the run more than once, so that windows of it can be equal."""
    out = []
    for base, part in chunks(texts):
        buf, hashes, at, first = units.split(part)
        if len(hashes) < length:
            continue
        grams, wide = gram_hashes(hashes, gram), length - gram + 1
        kept = sliding_min(grams, wide)
        last = first[1:] - length  # last window of each text
        some = last >= first[:-1]
        begin = np.ones(len(kept) + 1, bool)
        begin[1:-1] = kept[1:] != kept[:-1]
        begin[first[:-1][some]] = True
        begin[last[some] + 1] = True
        starts = np.flatnonzero(begin)
        starts, ends = starts[:-1], starts[1:]
        doc = np.searchsorted(first, starts, side="right") - 1
        good = starts <= last[doc]
        starts, ends, doc = starts[good], ends[good], doc[good]
        several = np.zeros(len(starts), bool)
        if within:
            view = np.lib.stride_tricks.sliding_window_view(grams, wide)
            value = kept[starts][:, None]
            for lo in range(0, len(starts), 4096):
                part = slice(lo, lo + 4096)
                first_at = (view[starts[part]] == value[part]).argmax(1) + starts[part]
                last_at = ends[part] - 1 + wide - 1 - (view[ends[part] - 1][:, ::-1] == value[part]).argmax(1)
                several[part] = first_at != last_at
        if (long := np.flatnonzero(ends - starts > LONGEST_RUN)).size:
            cut = [(np.arange(starts[i], ends[i], LONGEST_RUN), doc[i], ends[i]) for i in long]
            keep = ends - starts <= LONGEST_RUN
            more = np.concatenate([c[0] for c in cut])
            stop = np.concatenate([np.append(c[0][1:], c[2]) for c in cut])
            several = np.concatenate([several[keep], np.full(len(more), within)])
            starts, ends, doc = np.concatenate([starts[keep], more]), np.concatenate([ends[keep], stop]), np.concatenate([doc[keep], np.repeat([c[1] for c in cut], [len(c[0]) for c in cut])])
        lo, hi = at[starts].tolist(), (at[ends - 1 + length] - units.gap()).tolist()
        digest, view = xxhash.xxh3_64_intdigest, memoryview(buf)
        whole = np.array([digest(view[a:b]) for a, b in zip(lo, hi, strict=True)], np.uint64)
        out.append((doc + base, starts - first[doc], np.where(several, starts - ends, ends - starts), kept[starts], whole))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def thinned(hash_: np.ndarray, whole: np.ndarray, doc: np.ndarray, pos: np.ndarray, same_document: bool) -> np.ndarray:
    """Which runs of a batch repeat an earlier run of it and need not be dealt to their group."""
    order = np.lexsort((pos, doc, whole, hash_))
    h, w, d = hash_[order], whole[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.zeros(len(order), bool)
    out[order] = (np.arange(len(order)) - first >= DEALT) & (same_document | (d != d[first])) & ((d != d[first]) | (pos[order] != pos[order][first]))
    return out


_CLASSIFIED = "doc_id long, pos long, windows long, hash long, whole long, kind int"
REPEAT, INDEXED, HOT, NAMED = 0, 1, 2, 3


def classify(batches: Iterator[pa.RecordBatch], same_document: bool, hot_runs: int = HOT_RUNS) -> Iterator[pa.RecordBatch]:
    """Of rows (hash, whole, doc_id, pos, windows, deal) sorted by (deal, whole, doc_id, pos), with deal = hash but for rows known to repeat:
    INDEXED, or HOT, for the first run of each text in groups of two or more runs, and for those that can repeat windows of their own;
    NAMED for runs whose text came before, which the index is asked about; REPEAT for those it isn't. same_document: whether a run can
    repeat one of its own document. Holds hot_runs rows at most besides a batch, or those of one document."""
    pending: list[np.ndarray] = []  # of the group that is open: rows that wait for a second run
    distinct, again, hot, last, lead, nth = 0, False, False, None, 0, 0

    def told(rows: np.ndarray, kind: int | np.ndarray) -> pa.RecordBatch:
        kind = pa.array(np.broadcast_to(np.asarray(kind, np.int32), len(rows)))
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 2]), pa.array(rows[:, 3]), pa.array(np.abs(rows[:, 4])), pa.array(rows[:, 0]), pa.array(rows[:, 1]), kind], ["doc_id", "pos", "windows", "hash", "whole", "kind"])

    def feed(rows: np.ndarray, texts: int, repeats: bool) -> Iterator[pa.RecordBatch]:
        """Rows of the open group."""
        nonlocal distinct, again, hot, pending
        distinct += texts
        again |= repeats
        if hot:
            yield told(rows, HOT)
            return
        pending.append(rows)
        if distinct > 1 and sum(map(len, pending)) > hot_runs:
            yield told(np.concatenate(pending), HOT)
            pending, hot = [], True

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal distinct, again, hot, pending
        if pending:
            rows = np.concatenate(pending)
            yield told(rows if distinct > 1 or again else rows[rows[:, 4] < 0], INDEXED)
        pending, distinct, again, hot = [], 0, False, False

    for b in batches:
        rows = np.stack([b.column(k).to_numpy() for k in range(6)], 1) if b.num_rows else np.zeros((0, 6), np.int64)
        known = rows[:, 5] != rows[:, 0]
        if known.any():
            yield told(rows[known], REPEAT)
            rows = rows[~known]
        if not len(rows):
            continue
        before = np.vstack([rows[:1] ^ 1 if last is None else last, rows[:-1]])
        new_group = rows[:, 0] != before[:, 0]
        new_text = new_group | (rows[:, 1] != before[:, 1])
        twice = ~new_text & (rows[:, 2] == before[:, 2]) & (rows[:, 3] == before[:, 3])
        at = np.arange(len(rows))
        index = np.maximum.accumulate(np.where(new_text, at, -1))
        first_doc = np.where(index >= 0, rows[index, 2], lead)
        rank = np.where(index >= 0, at - index, at + nth)
        repeat = ~new_text & ~twice & (same_document | (rows[:, 2] != first_doc))
        if repeat.any():
            yield told(rows[repeat], np.where(rank[repeat] <= CHECKED, NAMED, REPEAT))
        wanted = ~repeat & ~twice
        starts = np.flatnonzero(new_group)
        head = starts[0] if starts.size else len(rows)
        if head:
            yield from feed(rows[:head][wanted[:head]], int(new_text[:head].sum()), bool(repeat[:head].any()))
        if starts.size:
            yield from close()
            if starts.size > 1:  # groups that lie within this batch
                lo, hi = starts[0], starts[-1]
                bounds = starts[:-1] - lo
                size = np.diff(starts)
                count = lambda x: np.repeat(np.add.reduceat(x[lo:hi].astype(np.int64), bounds), size)  # noqa: B023, E731
                texts, many, repeats = count(new_text), count(wanted), count(repeat)
                pick = wanted[lo:hi] & ((texts > 1) | (repeats > 0) | (rows[lo:hi, 4] < 0))
                if pick.any():
                    yield told(rows[lo:hi][pick], np.where((many[pick] > hot_runs) & (texts[pick] > 1), HOT, INDEXED))
            tail = starts[-1]
            yield from feed(rows[tail:][wanted[tail:]], int(new_text[tail:].sum()), bool(repeat[tail:].any()))
        last, lead, nth = rows[-1:], int(first_doc[-1]), int(rank[-1]) + 1
    yield from close()


#: Of texts in the order of (doc_id, start), all that can share a window at once: each text's number of windows, and for each window, text
#: after text, the document and the start of its first occurrence; see substring.py and suffix_family.py.
Search = Callable[[np.ndarray, np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]

_PIECES = "route long, whole long, doc_id long, pos long, windows long, t binary"


def repeated_spans(docs: DataFrame, units, length: int, gram: int, search: Search, same_document: bool, id_col: str, text_col: str, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, spans array<struct<s long, e long>>: what windows that repeat an earlier one cover, in units, not merged."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where("doc_id is not null and text is not null")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, parts = b.column(0).to_numpy(), []
            for base, part in column_chunks(b.column(1)):
                doc, pos, many, kept, whole = runs(part, units, length, gram, same_document)
                parts.append((kept.view(np.int64), whole.view(np.int64), ids[base + doc], pos, many))
            if not parts:
                continue
            kept, whole, doc, pos, many = (np.concatenate(c) for c in zip(*parts, strict=True))
            known = thinned(kept, whole, doc, pos, same_document)
            deal = np.where(known, kept ^ (1 + (doc * 31 + pos) % 4093), kept)
            for lo in range(0, max(1, len(kept)), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (kept, whole, doc, pos, many, deal)], ["hash", "whole", "doc_id", "pos", "windows", "deal"])

    found = texts.mapInArrow(find, "hash long, whole long, doc_id long, pos long, windows long, deal long")
    told = found.repartition("deal").sortWithinPartitions("deal", "whole", "doc_id", "pos").mapInArrow(lambda b: classify(b, same_document, hot_runs), _CLASSIFIED)
    told = materialise(told, "runs")
    span = F.struct(F.col("pos").alias("s"), (F.col("pos") + F.col("windows") + (length - 1)).alias("e"))
    repeats = told.where(F.col("kind") == REPEAT).select("doc_id", span.alias("x"))
    named = told.where(F.col("kind") == NAMED).select(F.col("hash").alias("route"), "whole", "doc_id", "pos", "windows", F.lit(None).cast("binary").alias("t"))
    wanted = told.where(F.col("kind").isin(INDEXED, HOT)).groupBy("doc_id").agg(F.collect_list(F.struct("hash", "whole", "pos", "windows", "kind")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of runs, by hash; of hot ones their windows, by content. A row without text and with route 0 stands for windows that repeat one of the same batch."""
        for b in batches:
            out: list[tuple] = []
            least: dict[bytes, tuple[int, int]] = {}
            windows: list[tuple[int, int, bytes]] = []

            def flush() -> pa.RecordBatch:
                cols = list(zip(*out, strict=True)) or [()] * 6  # noqa: B023
                out.clear()  # noqa: B023
                return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:5]), pa.array(cols[5], pa.binary())], ["route", "whole", "doc_id", "pos", "windows", "t"])

            for base, part in column_chunks(b.column(1)):
                for i, text, wants in zip(b.column(0).slice(base, len(part)).to_pylist(), part, b.column(2).slice(base, len(part)).to_pylist(), strict=True):
                    buf, _, at, _ = units.split([text])
                    seen = set()
                    for r in wants:
                        lo, hi = r["pos"], r["pos"] + r["windows"] - 1 + length
                        if (lo, hi) in seen:
                            continue
                        seen.add((lo, hi))
                        if r["kind"] == INDEXED:
                            out.append((r["hash"], r["whole"], i, lo, r["windows"], buf[at[lo] : at[hi] - units.gap()]))
                        else:
                            for p in range(lo, hi - length + 1):
                                t = buf[at[p] : at[p + length] - units.gap()]
                                windows.append((i, p, t))
                                if t not in least or (i, p) < least[t]:
                                    least[t] = (i, p)
                    if len(out) > 5_000:
                        yield flush()
            for i, p, t in windows:
                if (i, p) == least[t] or (not same_document and i == least[t][0]):
                    digest = xxhash.xxh3_64_intdigest(t) - 2**63
                    out.append((digest, digest, i, p, 1, t))
                else:
                    out.append((0, 0, i, p, 1, None))
                if len(out) > 20_000:
                    yield flush()
            yield flush()

    pieces = texts.join(wanted, "doc_id").select("doc_id", "text", "runs").mapInArrow(cut, _PIECES)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of whole routes, as many as INDEX_BYTES allow at once."""
        held: list[pa.Table] = []
        size = 0

        def go(part: pa.Table) -> pa.RecordBatch:
            part = part.sort_by([("doc_id", "ascending"), ("pos", "ascending")])
            route, whole, doc, pos, many = (part[c].to_numpy() for c in ("route", "whole", "doc_id", "pos", "windows"))
            given = part["t"].is_valid().to_numpy()
            same = (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])
            keep, near = given.copy(), np.zeros(len(part), bool)
            near[1:] = same
            near[:-1] |= same
            seen = set()  # a row that repeats an id and its text is cut again: its pieces are the same ones
            for i in np.flatnonzero(given & near).tolist():
                piece = (doc[i], pos[i], route[i], part["t"][i].as_py())
                keep[i] = piece not in seen
                seen.add(piece)
            once, rest = np.flatnonzero(keep), np.flatnonzero(~given)
            counts = first_doc = first_start = np.zeros(0, np.int64)
            if once.size:
                counts, first_doc, first_start = search(doc[once], pos[once], part["t"].filter(pa.array(keep)).to_pylist())
            # rows without text ask for the first text of their route and name
            both = np.concatenate([once, rest])
            order = np.lexsort((whole[both], route[both]))
            r, w = route[both][order], whole[both][order]
            head = np.ones(len(both), bool)
            head[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1])
            number = np.empty(len(both), np.int64)
            number[order] = order[head][np.cumsum(head) - 1]
            number[: len(once)] = np.arange(len(once))
            known = number < len(once)
            alone = both[~known]  # their text repeats another one of its batch, or their group is hot and was taken apart
            out = [(doc[alone], pos[alone], pos[alone] + many[alone] - 1 + length)]
            row, number = both[known], number[known]
            size, base = counts[number], np.cumsum(counts) - counts
            ends = np.cumsum(size)
            lo = 0
            while lo < len(row):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + FLAGS, "right")))
                out.append(spans(doc[row[lo:hi]], pos[row[lo:hi]], size[lo:hi], base[number[lo:hi]], first_doc, first_start))
                lo = hi
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["doc_id", "s", "e"])

        def spans(doc: np.ndarray, pos: np.ndarray, size: np.ndarray, base: np.ndarray, first_doc: np.ndarray, first_start: np.ndarray) -> tuple[np.ndarray, ...]:
            """What the windows cover that stand earlier: of rows with `size` windows each, whose answers start at `base`."""
            begin = np.cumsum(size) - size
            nth = np.arange(int(size.sum())) - np.repeat(begin, size)
            at, own = np.repeat(base, size) + nth, np.repeat(doc, size)
            flags = first_doc[at] < own
            if same_document:
                flags |= (first_doc[at] == own) & (first_start[at] < np.repeat(pos, size) + nth)
            inner = nth[1:] > 0
            on, off = flags.copy(), flags.copy()
            on[1:] &= ~(flags[:-1] & inner)
            off[:-1] &= ~(flags[1:] & inner)
            starts, stops = np.flatnonzero(on), np.flatnonzero(off)
            i = np.searchsorted(begin, starts, "right") - 1
            return doc[i], pos[i] + starts - begin[i], pos[i] + stops - begin[i] + length

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            size += b.column(5).nbytes + ROW_BYTES * b.num_rows
            if size > INDEX_BYTES:
                whole = pa.concat_tables(held)
                route = whole["route"].to_numpy()
                done = int(np.flatnonzero(route != route[-1])[-1] + 1) if (route != route[-1]).any() else 0
                if done:
                    yield go(whole.slice(0, done))
                elif route[-1] == 0:  # no index is needed for these
                    yield go(whole)
                    done = len(whole)
                held = [whole.slice(done).combine_chunks()]
                size = held[0]["t"].nbytes + ROW_BYTES * len(held[0])
        if held:
            yield go(pa.concat_tables(held))

    dealt = pieces.unionByName(named).withColumn("deal", F.when(F.col("route") == 0, F.xxhash64("doc_id", "pos")).otherwise(F.col("route")))
    searched = dealt.repartition("deal").drop("deal").sortWithinPartitions("route").mapInArrow(look, "doc_id long, s long, e long").select("doc_id", F.struct("s", "e").alias("x"))
    return repeats.unionByName(searched).groupBy("doc_id").agg(F.collect_list("x").alias("spans"))


def merged(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs covered by spans, clipped to size."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        e = min(e, size)
        if s >= e:
            continue
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]
