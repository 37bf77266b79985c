"""Op 2. N-gram Jaccard join by PartEnum signatures, exact, with connected components.

Sets are dealt into bands of nearly equal size. Two sets of similarity t or more, the smaller in a given band, differ in at
most k elements. The domain is cut by a hash into n1 parts. From 90 % on, similar sets differ in at most one element in
at least one part, and of that part's three cells two agree, so each set has a signature for each part and each two of
its cells; below 90 %, where parts are small, there are more of them, one agrees as a whole, and each part has one
signature. A set signs for its own band and, where a smaller partner can lie there, for the band below.

A signature of few elements, or of none but frequent ones, would bring together what has little in common. n1 is
therefore larger than needed by a slack of d parts: similar sets then agree in 1 + d parts at least, and a set may
leave out its signatures with up to c elements that are not frequent, as long as at most d of its parts have such ones.
No link is lost by that, since what either side leaves out lies among the d parts of the side with the larger c.
Which elements are frequent is counted over all documents, in the pass that measures them, against a share of the corpus;
the list only has to be the same for all, and decides how much work there is, never the result.

Equal sets are one class. Candidates are verified within the buckets of their signatures, and only verified links are closed
over. First each class of a bucket is compared with the bucket's first one. Where that leaves all of a bucket in one component,
its other pairs can add nothing. The classes of the other buckets are put together by their first class, and all of similar size are
compared with each other in blocks, as matrix products over the elements that occur twice. A comparison reports one edge for
each linked class, not its pairs. Links of all comparisons make the components.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing; a text of fewer
words than a shingle has the whole sequence as its only element; a null id links with nothing; rows that repeat an id
get a row each and one component, in which any of their texts may link; an empty table gives an empty result; columns
besides id and text are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import HUB_LEAST, HUB_SHARE, connected_components, drop_materialised, materialise, small_enough, table
from leafmill.llm.passages import Words, chunks, join, column_chunks, gram_hashes

BLOCK_SETS, BLOCK_ELEMENTS = 1024, 1 << 20
#: Rows of (group, band) counts that may be broadcast; only groups of more than one block have such rows.
BROADCAST_COUNTS = 100_000
SLACK = 0.2
MOST_LEFT_OUT = 2
#: A shingle counts as frequent if it stands in one of FREQUENT distinct sets or more. With sets of 500 shingles in the mean that is true
#: of FREQUENT * 500 shingles at most; the share rises with longer sets, so that TOLD shingles (4 MB) bound what is told to all tasks (a set may be counted once for each task, so the list is cut there; it decides what is compared, never the result).
FREQUENT, TOLD = 1000, 500_000
#: Shingles that are counted at once before counts leave a task, and the least count that does.
COUNTED, LEAST_COUNT = 1 << 20, 4
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each lower-cased text."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    for base, part in chunks(texts):
        _, hashes, _, first = Words.split([t.translate(_FOLD) for t in part])
        grams = gram_hashes(hashes, k)
        for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if hi - lo >= k:
                out[base + i] = np.unique(grams[lo : hi - k + 1])
            elif hi > lo:
                out[base + i] = gram_hashes(hashes[lo:hi], hi - lo) ^ np.uint64(hi - lo)
    return out


@lru_cache
def _band_list(percent: int, top: int) -> tuple[list[int], list[int]]:
    low, high = [1], []
    while True:
        high.append(low[-1] * 100 // max(1, percent - 10))
        if high[-1] >= top:
            return low, high
        low.append(high[-1] + 1)


def bands(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    top = 1 << max(10, int(sizes.max(initial=1) * 2).bit_length())
    low, high = (np.array(x) for x in _band_list(percent, top))
    at = np.searchsorted(low, sizes, side="right") - 1
    return at, low, high


def parts_of(largest: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts and slack of bands by their largest size; 0 parts if only equal sets are similar enough."""
    k = (100 - percent) * (largest + largest * 100 // percent) // (100 + percent)
    need = (k + 2) // 2 if percent >= 90 else k + 1
    slack = np.ceil(need * SLACK).astype(np.int64) * (need > 2)
    return np.where(k == 0, 0, need + slack), slack


def signatures(sets: list[np.ndarray], percent: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the set and signature, for all signatures of all sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    where = np.flatnonzero(sizes)
    if not where.size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    cells_of_part = 3 if percent >= 90 else 1
    band, low, high = bands(sizes[where], percent)
    below = np.maximum(band - 1, 0)
    downward = (band > 0) & (sizes[where] * percent <= 100 * high[below]) & (parts_of(high[below], percent)[0] > 0)
    owner, band = np.concatenate([where, where[downward]]), np.concatenate([band, below[downward]])
    n1, slack = parts_of(high[band], percent)
    total = n1 * cells_of_part
    offset = np.concatenate([[0], np.cumsum(total)])
    elements = np.concatenate([sets[i] for i in owner])
    count = sizes[owner]
    of = np.repeat(np.arange(len(owner)), count)
    mixed = join(elements, np.full(len(elements), 0x51ED270B, np.uint64))
    whole = np.add.reduceat(mixed, np.concatenate([[0], np.cumsum(count)[:-1]]))
    out_owner, out = [], []
    if (only := np.flatnonzero(n1 == 0)).size:
        out_owner.append(owner[only])
        out.append(join(whole[only], band[only].astype(np.uint64)))
    some = n1[of] > 0
    of, mixed, raw = of[some], mixed[some], elements[some]
    if of.size:
        place = join(raw, np.full(len(raw), 0x2545F491, np.uint64))
        part = ((place >> np.uint64(32)) % n1[of].astype(np.uint64)).astype(np.int64)
        cell = offset[of] + part * cells_of_part + ((place & np.uint64(0xFFFFFFFF)) % np.uint64(cells_of_part)).astype(np.int64)
        number = np.bincount(cell, minlength=offset[-1])
        rare = np.ones(len(raw))
        if len(frequent):
            rare[frequent[np.minimum(np.searchsorted(frequent, raw), len(frequent) - 1)] == raw] = 0
        weight = np.bincount(cell, rare, offset[-1])
        order = np.argsort(cell, kind="stable")
        sums = np.zeros(offset[-1], np.uint64)
        begin = np.concatenate([[0], np.cumsum(number)[:-1]])
        filled = np.flatnonzero(number)
        sums[filled] = np.add.reduceat(mixed[order], begin[filled])
        value, held = sums.reshape(-1, cells_of_part), weight.reshape(-1, cells_of_part)
        if cells_of_part > 1:  # all cells of a part but one
            value, held = value.sum(1, dtype=np.uint64, keepdims=True) - value, held.sum(1, keepdims=True) - held
        part_owner = np.repeat(np.arange(len(owner)), n1)
        thin = held.min(1)
        limit = np.full(len(owner), -1)
        for c in range(MOST_LEFT_OUT + 1):
            limit[np.bincount(part_owner, thin <= c, len(owner)) <= slack] = c
        limit[slack == 0] = -1
        keep = held > limit[part_owner][:, None]
        within = np.arange(len(part_owner)) - (offset[:-1] // cells_of_part)[part_owner]
        tag = (band[part_owner].astype(np.uint64) << np.uint64(40)) + (within.astype(np.uint64) << np.uint64(2))
        sig = join(value, tag[:, None] + np.arange(cells_of_part, dtype=np.uint64))
        out_owner.append(np.repeat(owner[part_owner][:, None], cells_of_part, 1)[keep])
        out.append(sig[keep])
    return np.concatenate(out_owner), np.concatenate(out)


def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (sig, cls) sorted by both: (sig, cls, lead), lead the first class with that signature, for every other one."""
    last_sig, last, lead = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        sig, cls = b.column(0).to_numpy(), b.column(1).to_numpy()
        new = np.concatenate([[last_sig is None or sig[0] != last_sig], sig[1:] != sig[:-1]])
        index = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
        first = np.where(index >= 0, cls[index], lead)
        pick = (cls != first) & (new | (cls != np.concatenate([[last], cls[:-1]])))
        last_sig, last, lead = sig[-1], cls[-1], first[-1]
        yield pa.RecordBatch.from_arrays([pa.array(c[pick]) for c in (sig, cls, first)], ["sig", "cls", "lead"])


def linked_labels(ids: np.ndarray, sets: list[np.ndarray], split: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with a link, and the least id each is tied to: links of the sets before `split` with those from it on, or of all
    sets if split is their number."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    often = count[inverse] > 1
    owner, inverse = owner[often], inverse[often]
    _, column = np.unique(inverse, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    rows, cols = (slice(0, n), slice(0, n)) if split == n else (slice(0, split), slice(split, n))
    exact = np.float32 if sizes.max() < 1 << 24 else np.float64  # sums of ones
    common = np.zeros((rows.stop - rows.start, cols.stop - cols.start), exact)
    width = max(256, min(8192, (1 << 22) // n))
    bounds = np.searchsorted(column, np.arange(0, (int(column[-1]) if column.size else -1) + width + 1, width))
    for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if lo < hi:
            x = np.zeros((n, width), exact)
            x[owner[lo:hi], column[lo:hi] - k * width] = 1
            common += x[rows] @ x[cols].T
    both = common.astype(np.int64)
    links = both * (100 + percent) >= percent * (sizes[rows][:, None] + sizes[cols][None])
    if split == n:
        np.fill_diagonal(links, False)
    label = ids.copy()
    big = np.iinfo(np.int64).max
    while True:
        a = np.minimum(label[rows], np.where(links, label[cols][None], big).min(1))
        now = label.copy()
        now[rows] = np.minimum(now[rows], a)
        now[cols] = np.minimum(now[cols], np.where(links, now[rows][:, None], big).min(0))
        if (now == label).all():
            break
        label = now
    some = np.zeros(n, bool)
    some[rows] |= links.any(1)
    some[cols] |= links.any(0)
    return ids[some], label[some]


def linked_to(lead: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets are linked with lead; all are sorted."""
    sizes = np.array([len(s) for s in sets], np.int64)
    elements = np.concatenate(sets)
    found = lead[np.minimum(np.searchsorted(lead, elements), len(lead) - 1)] == elements
    both = np.add.reduceat(found.astype(np.int64), np.cumsum(sizes) - sizes)
    return both * (100 + percent) >= percent * (sizes + len(lead))


def compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (key, role, doc_id, set) sorted by key and role: (a, b) ties within each key; rows of role 1 are compared with those of
    role 0, or these with each other if a key has no others. Holds the rows of role 0 of a key and BLOCK_SETS of role 1."""
    none = np.zeros(0, np.int64)

    def done(base: list[tuple], more: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        rows = base + more
        if not base or len(rows) < 2:
            return none, none
        ids, sets = np.array([r[2] for r in rows], np.int64), [np.frombuffer(r[3], np.uint64) for r in rows]
        if len(base) == 1:
            found = ids[1:][linked_to(sets[0], sets[1:], percent)]
            return found, np.full(len(found), ids[0])
        return linked_labels(ids, sets, len(base), percent)

    def told(out: list) -> pa.RecordBatch:
        a, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none)
        a, c = a[a != c], c[a != c]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    key, base, more, asked = None, [], [], False  # asked: some rows of role 1 were compared
    for b in batches:
        out = []
        for row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if row[0] != key:
                if more or not asked:
                    out.append(done(base, more))
                key, base, more, asked = row[0], [], [], False
            if row[1] == 0:
                base.append(row)
            else:
                more.append(row)
                if len(more) == BLOCK_SETS:
                    out.append(done(base, more))
                    more, asked = [], True
        yield told(out)
    if more or not asked:
        yield told([done(base, more)])


class Frequencies:
    """Shingles and the number of distinct sets they stand in, for those that are not rare among COUNTED ones."""

    def __init__(self) -> None:
        self.sets, self.held = {}, 0

    def add(self, sets: list[np.ndarray], names: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for name, s in zip(names.tolist(), sets, strict=True):
            if len(s) and name not in self.sets:
                self.sets[name] = s
                self.held += len(s)
                if self.held >= COUNTED:
                    yield self.flush()

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.sets:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        values, count = np.unique(np.concatenate(list(self.sets.values())), return_counts=True)
        often = count >= max(LEAST_COUNT, len(self.sets) // FREQUENT)
        self.sets, self.held = {}, 0
        return values[often], count[often]


def set_name(s: np.ndarray, salt: int) -> int:
    return int(join(s, np.full(len(s), salt, np.uint64)).sum(dtype=np.uint64))


def verified(usable: DataFrame, wanted: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): ties of documents linked within a key. wanted: (doc_id, key, role) as compare() takes them."""
    keys = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "role")).alias("keys"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = (b.column(k).to_pylist() for k in (0, 2))
            for base, part in column_chunks(b.column(1)):
                sets = [s.tobytes() for s in shingle_sets(part, shingle)]
                rows = [(k["key"], k["role"], ids[base + i], s) for i, s in enumerate(sets) if s for k in keys[base + i]]
                for lo in range(0, len(rows), 512):
                    cols = list(zip(*rows[lo : lo + 512], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], ["key", "role", "doc_id", "elements"])

    dealt = usable.join(keys, "doc_id").select("doc_id", "text", "keys").mapInArrow(deal, "key string, role int, doc_id long, elements binary")
    ties = dealt.repartition("key").sortWithinPartitions("key", "role").mapInArrow(lambda b: compare(b, percent), "a long, b long")
    return materialise(ties.distinct(), "ties")


def blocks(members: DataFrame, percent: int) -> DataFrame:
    """(doc_id, key, role) to compare all pairs of similar size within each grp of members (grp, doc_id, n)."""
    sized = members.groupBy("grp").agg(F.count("*").alias("sets"), F.sum("n").alias("elements"))
    one = (F.col("sets") <= BLOCK_SETS) & (F.col("elements") <= BLOCK_ELEMENTS)
    small = members.join(sized.where(one), "grp").select("doc_id", F.col("grp").cast("string").alias("key"), F.lit(0).alias("role"))
    # groups of several blocks: blocks of sets of one size class, by a hash; sets of sizes that are not similar don't meet
    step = math.log(100 / percent)
    large = members.join(sized.where(~one), "grp").withColumn("size", F.floor(F.log("n") / step).cast("int"))
    counts = large.groupBy("grp", "size").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_ELEMENTS)).cast("int").alias("blocks"))
    counts = materialise(counts, "counts")
    hint = F.broadcast if small_enough(counts, BROADCAST_COUNTS) else (lambda x: x)
    large = large.join(hint(counts), ["grp", "size"])
    for side in (-1, 1):
        large = large.join(hint(counts.select("grp", (F.col("size") - side).alias("size"), F.col("blocks").alias(f"beside{side + 1}"))), ["grp", "size"], "left")
    large = large.withColumn("mine", F.pmod(F.xxhash64(F.lit("block"), "doc_id"), F.col("blocks").cast("long")).cast("int"))
    name = lambda size, block, size2, block2: F.concat_ws("/", "grp", size, block, size2, block2)
    none = F.array().cast("array<struct<key:string,role:int>>")
    own = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(name(F.col("size"), F.least("mine", j), F.col("size"), F.greatest("mine", j)).alias("key"), (F.col("mine") > j).cast("int").alias("role")))
    up = F.when(F.col("beside2").isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("beside2", F.lit(1)) - 1), lambda j: F.struct(name(F.col("size"), F.col("mine"), F.col("size") + 1, j).alias("key"), F.lit(0).alias("role"))))
    down = F.when(F.col("beside0").isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("beside0", F.lit(1)) - 1), lambda j: F.struct(name(F.col("size") - 1, j, F.col("size"), F.col("mine")).alias("key"), F.lit(1).alias("role"))))
    return small.unionByName(large.select("doc_id", F.explode(F.concat(own, up, down)).alias("k")).select("doc_id", "k.key", "k.role"))


def near_components(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row: documents linked where 100 * intersection >= percent * union."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    usable = texts.where("doc_id is not null and text is not null")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and rows (e, seen) of shingles that are not rare."""
        names, counted = ["doc_id", "n_shingles", "h1", "h2", "e", "seen"], Frequencies()
        longs = lambda n: pa.nulls(n, pa.int64())

        def seen(e: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(longs(len(e)) for _ in range(4)), pa.array(e.view(np.int64)), pa.array(count)], names)

        for b in batches:
            for base, part in column_chunks(b.column(1)):
                sets = shingle_sets([t or b"" for t in part], shingle)
                h = [np.array([set_name(s, c) for s in sets], np.uint64) for c in (3, 5)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(base, len(part)), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x.view(np.int64)) for x in h), longs(len(part)), longs(len(part))], names)
                for told in counted.add(sets, h[0]):
                    yield seen(*told)
        yield seen(*counted.flush())

    measured = materialise(texts.mapInArrow(measure, "doc_id long, n_shingles long, h1 long, h2 long, e long, seen long"), "sets")
    told = measured.where("e is null").select("doc_id", "n_shingles", "h1", "h2")
    classes = materialise(told.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.count("*").alias("rows")), "classes")
    total = classes.agg(F.count("*").alias("classes"), F.sum("n").alias("elements"), F.sum("rows").alias("rows"), F.max("rows").alias("most")).first()
    if not total["classes"]:
        return told.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    least = max(LEAST_COUNT, total["classes"] / FREQUENT, total["elements"] / TOLD)
    often = measured.where("e is not null").groupBy("e").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= least).orderBy(F.desc("seen"), "e").limit(TOLD).select("e").toArrow()
    frequent = np.sort(often["e"].to_numpy().view(np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[int] = set()  # equal sets of a task sign once
        for b in batches:
            for _, part in column_chunks(b.column(0)):
                sets = shingle_sets(part, shingle)
                names = [set_name(s, 3) for s in sets]
                new = [i for i, n in enumerate(names) if n not in signed and (signed.add(n) or True)]
                owner, sig = signatures([sets[i] for i in new], percent, frequent)
                cls = np.array([names[i] for i in new], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(cls[owner])], ["sig", "cls"])

    signed = usable.select("text").mapInArrow(sign, "sig long, cls long")
    met = materialise(signed.repartition("sig").sortWithinPartitions("sig", "cls").mapInArrow(star, "sig long, cls long, lead long"), "met")

    # each class of a bucket against the first one; what a lead with very many partners compares is split
    pairs = materialise(met.select("cls", "lead").distinct(), "pairs")
    partners = pairs.groupBy("lead").count()
    most = max(BLOCK_SETS // 4, pairs.count() // HUB_SHARE)
    split = F.broadcast(partners.where(F.col("count") > most).select("lead", F.ceil(F.col("count") / most).alias("chunks")))  # HUB_SHARE rows at most
    dealt = pairs.join(split, "lead", "left").withColumn("key", F.concat_ws("/", "lead", F.pmod(F.xxhash64("cls"), F.coalesce("chunks", F.lit(1)))))
    asked = dealt.select("cls", "key", F.lit(1).alias("role")).unionByName(dealt.select(F.col("lead").alias("cls"), "key", F.lit(0).alias("role")).distinct())
    of_class = classes.select(F.col("h1").alias("cls"), "doc_id", "n")
    ties = verified(usable, asked.join(of_class, "cls").select("doc_id", "key", "role"), shingle, percent)
    parts = materialise(connected_components(ties).select(F.col("node").alias("doc_id"), F.col("component").alias("part")), "parts")

    # buckets whose classes are not all in one component yet: all pairs of those that share a lead, so that a set goes out once for each lead
    members = met.select("sig", "cls").unionByName(met.groupBy("sig").agg(F.first("lead").alias("cls")))
    where = of_class.join(parts, "doc_id", "left").select("cls", F.coalesce("part", "doc_id").alias("part"))
    open_ = members.join(where, "cls").groupBy("sig").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("sets"))
    together = met.join(open_.where("low <> high and sets > 2").select("sig"), "sig", "left_semi").select("lead", "cls").distinct()
    together = materialise(together, "open")
    drop_materialised(met)
    drop_materialised(pairs)
    if not together.isEmpty():
        both = together.unionByName(together.select("lead", F.col("lead").alias("cls")).distinct())
        rest = materialise(both.join(of_class, "cls").select(F.col("lead").alias("grp"), "doc_id", "n"), "rest")
        more = verified(usable, blocks(rest, percent), shingle, percent)
        parts = materialise(connected_components(ties.unionByName(more)).select(F.col("node").alias("doc_id"), F.col("component").alias("part")), "parts")
        drop_materialised(more)
        drop_materialised(rest)
    drop_materialised(ties)
    drop_materialised(together)

    named = classes.join(parts, "doc_id", "left").select("h1", "h2", "rows", F.coalesce("part", "doc_id").alias("part"))
    limit = max(HUB_LEAST, total["rows"] // HUB_SHARE)
    if total["most"] > limit:  # rows of classes with very many copies, HUB_SHARE classes at most, stay where they are
        often = F.broadcast(named.where(F.col("rows") > limit).select("h1", "h2", "part"))
        joined = told.join(often, ["h1", "h2"]).unionByName(told.join(often, ["h1", "h2"], "left_anti").join(named.where(F.col("rows") <= limit).select("h1", "h2", "part"), ["h1", "h2"], "left").select("h1", "h2", "doc_id", "n_shingles", "part"))
    else:
        joined = told.join(named.select("h1", "h2", "part"), ["h1", "h2"], "left")
    joined = joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("part", "doc_id")).otherwise(F.col("doc_id")).alias("part"))
    known = joined.where("doc_id is not null").select("doc_id", "n_shingles", F.min("part").over(Window.partitionBy("doc_id")).alias("component_id"))
    return known.unionByName(joined.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), shingle=3, percent=90)


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP2_SQL = rf"""
with recursive w as (select doc_id, list_filter(string_split_regex({_FOLDED}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
e as materialized (select doc_id, len(s) as n, unnest(s) as e from s),
p as materialized (select a.doc_id as a, b.doc_id as b from e a join e b on a.e = b.e and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
c as (select doc_id as node, doc_id as label from s union select p.b, c.label from c join p on p.a = c.node),
m as (select node, min(label) as component_id from c group by node)
select s.doc_id, len(s.s)::bigint as n_shingles, m.component_id from s join m on m.node = s.doc_id
"""
