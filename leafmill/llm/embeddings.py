"""Op 3. Near duplicates among embeddings by PCA-ordered tiled comparison, exact for a cosine threshold.

Unit vectors are rotated onto their principal axes, strongest first, and dealt into tiles by a k-d tree over the leading
axes. For two vectors, the product over the leading axes plus the product of the norms of what is left bounds the
cosine; the comparison of two tiles takes more axes only for pairs whose bound still reaches the threshold. Tile pairs
whose boxes lie too far apart are not compared at all. The rotation and the tree come from a bounded sample
(SAMPLE rows in the mean); they decide the order of work only, never the result.

Equal vectors are one class with a weight, so a vector that is repeated a million times is compared once. A tile pair
reports link counts and one edge for each linked class, not its pairs.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components links with nothing; vectors of
different length don't link; repeated rows are vectors of their own; a null id stays alone; an empty table gives an
empty result; columns besides id and vector are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import HUB_LEAST, HUB_SHARE, connected_components, materialise, table

SAMPLE = 8000
TILE = 4096
#: Leaves of the tree at most; beyond that leaves hold several tiles. Splits, boxes and counts of leaves are all that the driver holds.
LEAVES = 4096
#: Rows of a tile that are compared at once.
ROWS = 512
LEAD = 16
STEPS = (12, 24)
PARTNERS = 8
#: Cosines this close to the threshold are computed again from the original vectors.
CLOSE = 1e-9


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Orthogonal axes as columns, the strongest first."""
    _, axes = np.linalg.eigh(sample.T @ sample)
    return axes[:, ::-1].copy()


def build_tree(sample: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """Splits of a complete k-d tree in heap order; a node splits its widest leading axis at the median."""
    depth = max(0, math.ceil(math.log2(max(1, leaves))))
    parts, splits = [sample[:, :LEAD]], []
    for _ in range(depth):
        below = []
        for p in parts:
            axis = int(p.var(0).argmax()) if len(p) else 0
            cut = float(np.median(p[:, axis])) if len(p) else 0.0
            splits.append((axis, cut))
            right = p[:, axis] > cut
            below += [p[~right], p[right]]
        parts = below
    return splits


def leaf_of(rotated: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    if not splits:
        return np.zeros(len(rotated), np.int64)
    axis, cut = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
    node = np.zeros(len(rotated), np.int64)
    while node.size and node[0] < len(splits):
        node = 2 * node + 1 + (rotated[np.arange(len(rotated)), axis[node]] > cut[node])
    return node - len(splits)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)  # components may be so large or small that their squares leave the range
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def vectors_of(x: np.ndarray, axes: np.ndarray) -> dict:
    """Unit vectors x, the same on the principal axes r, and the given ones o, scaled by powers of two (which is exact), with norms n."""
    unit = _unit(x)
    given = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return {"x": unit, "r": unit @ axes, "o": given, "n": np.linalg.norm(given, axis=1)}


def linked(own: dict, other: dict, threshold: float) -> np.ndarray:
    """Boolean matrix of pairs of vectors_of() with cosine >= threshold."""
    return np.concatenate([_linked_rows({c: own[c][k : k + ROWS] for c in "xron"}, other, threshold) for k in range(0, len(own["x"]), ROWS)])


def _linked_rows(own: dict, other: dict, threshold: float) -> np.ndarray:
    a, b, ra, rb = own["x"], other["x"], own["r"], other["r"]
    d = a.shape[1]

    def decided(i: np.ndarray, j: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Whether pairs reach the threshold; close ones from the given vectors."""
        out = cosine >= threshold
        near = np.flatnonzero(np.abs(cosine - threshold) < CLOSE)
        p, q = i[near], j[near]
        out[near] = np.einsum("ij,ij->i", own["o"][p], other["o"][q]) / (own["n"][p] * other["n"][q]) >= threshold
        return out

    def rest(r: np.ndarray, k: int) -> np.ndarray:
        return np.sqrt((r[:, k:] ** 2).sum(1))

    first = min(STEPS[0], d)
    bound = np.hstack([ra[:, :first], rest(ra, first)[:, None]]) @ np.hstack([rb[:, :first], rest(rb, first)[:, None]]).T
    out = bound >= threshold - CLOSE
    count = np.count_nonzero(out)
    if count > 0.05 * out.size:
        exact = a @ b.T
        out = exact >= threshold
        i, j = np.nonzero(np.abs(exact - threshold) < CLOSE)
        out[i, j] = decided(i, j, exact[i, j])
        return out
    i, j = np.nonzero(out)
    out[:] = False
    for step in [*(s for s in STEPS[1:] if s < d), d]:
        keep = []
        sa, sb = rest(ra, step), rest(rb, step)
        for lo in range(0, len(i), 50_000):
            p, q = i[lo : lo + 50_000], j[lo : lo + 50_000]
            if step == d:
                ok = decided(p, q, np.einsum("ij,ij->i", a[p], b[q]))
            else:
                ok = np.einsum("ij,ij->i", ra[p, :step], rb[q, :step]) + sa[p] * sb[q] >= threshold - CLOSE
            keep.append(ok)
        ok = np.concatenate(keep) if keep else np.zeros(0, bool)
        i, j = i[ok], j[ok]
    out[i, j] = True
    return out


def _least(links: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """For each row the least label it is linked to."""
    big = np.iinfo(np.int64).max
    return np.concatenate([np.where(links[k : k + ROWS], labels[None], big).min(1) for k in range(0, len(links), ROWS)])


def compare_tiles(own: dict, other: dict, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each class with a link: its id, the least id it is tied to within the two tiles, and how many vectors it links to."""
    links = linked(own, other, threshold)
    if same:
        np.fill_diagonal(links, False)
    n_own, n_other = links @ other["w"], (np.zeros(len(other["w"]), np.int64) if same else links.T @ own["w"])
    rows, cols = links.any(1), links.any(0)
    sub = links[np.ix_(rows, cols)]
    la, lb = own["id"][rows].copy(), other["id"][cols].copy()
    while sub.size:
        # the least label over each row's links, then over each column's, until nothing changes
        na = np.minimum(la, _least(sub, lb))
        nb = np.minimum(lb, _least(sub.T, na))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    ids = np.concatenate([own["id"][rows], other["id"][cols]])
    counts = np.concatenate([n_own[rows], n_other[cols]])
    return ids, np.concatenate([la, lb]), counts


def _load(row: pd.Series, axes: np.ndarray, d: int) -> dict:
    n = len(row["ids"]) // 8
    kind = np.float32 if len(row["x"]) == 4 * n * d else np.float64
    x = np.frombuffer(row["x"], kind).astype(np.float64).reshape(-1, d)
    return {"id": np.frombuffer(row["ids"], np.int64), "w": np.frombuffer(row["w"], np.int64)} | vectors_of(x, axes)


def _links_of_length(vectors: DataFrame, d: int, threshold: float) -> DataFrame:
    """class_id, to, n: rows to sum and tie, of classes (class_id, weight, x array<double>) of one length."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit("pca"), "class_id"), 11).cast("double") * (2.0**-53)
    total = vectors.count()
    sample = _unit(np.array([r["x"] for r in vectors.where(u < min(1.0, SAMPLE / max(1, total))).select("x").collect()] or [[1.0] * d]))
    axes = principal_axes(sample)
    splits = build_tree(sample @ axes, min(LEAVES, math.ceil(total / TILE)))

    def deal(chunks: np.ndarray | None):
        """Leaf of each vector, and the chunk of the leaf by a hash; without chunks only the leaf."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = np.ascontiguousarray(b.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
                    leaf = leaf_of(_unit(x) @ axes, splits)
                    if chunks is None:
                        yield pa.RecordBatch.from_arrays([pa.array(leaf)], ["leaf"])
                    else:
                        chunk = b.column(3).to_numpy() % chunks[leaf]
                        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(leaf), pa.array(chunk)], ["class_id", "weight", "x", "leaf", "chunk"])

        return run

    plain = vectors.select("class_id", "weight", "x", F.pmod(F.xxhash64(F.lit("chunk"), "class_id"), F.lit(1 << 31)).alias("u"))
    sizes = plain.mapInArrow(deal(None), "leaf long").groupBy("leaf").count().collect()
    # a leaf that the sample underrates is cut further, by a hash
    chunks = np.ones(len(splits) + 1, np.int64)
    for r in sizes:
        chunks[r["leaf"]] = math.ceil(r["count"] / TILE)
    dealt = plain.mapInArrow(deal(chunks), "class_id long, weight long, x binary, leaf long, chunk long")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["x"]), np.float64).reshape(-1, d)
        r = _unit(x) @ axes
        with np.errstate(over="ignore"):
            short = x.astype(np.float32)
        x = short if (short == x).all() else x  # half the bytes where nothing is lost
        seen = np.hstack([r[:, :LEAD], np.sqrt((r[:, LEAD:] ** 2).sum(1, keepdims=True))])
        return pd.DataFrame({"ids": [pdf["class_id"].to_numpy(np.int64).tobytes()], "w": [pdf["weight"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "low": [seen.min(0)], "high": [seen.max(0)], "leaf": [int(pdf["leaf"].iloc[0])], "chunk": [int(pdf["chunk"].iloc[0])]})

    tiles = materialise(dealt.groupBy("leaf", "chunk").applyInPandas(pack, "ids binary, w binary, x binary, low array<double>, high array<double>, leaf long, chunk long"), "tiles")
    width = min(LEAD, d) + 1
    bounds = [F.array(*[f(F.col(c)[k]) for k in range(width)]).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))]
    boxes = tiles.groupBy("leaf").agg(*bounds).orderBy("leaf").collect()
    leaves, low, high = np.array([r["leaf"] for r in boxes]), np.array([r["low"] for r in boxes]), np.array([r["high"] for r in boxes])
    before = np.cumsum(chunks) - chunks  # tiles are numbered leaf by leaf

    def route(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each tile to the groups (owner, block of partners) that compare it, as the owner (role 0) or as a partner (role 1)."""
        for pdf in pdfs:
            for row in pdf.itertuples(index=False):
                t, box = int(before[row.leaf] + row.chunk), int(np.searchsorted(leaves, row.leaf))
                gap = np.maximum(0, np.maximum(low - high[box], low[box] - high))
                near = np.concatenate([np.arange(before[x], before[x] + chunks[x]) for x in leaves[1 - (gap**2).sum(1) / 2 >= threshold - CLOSE]])
                keys = [(t, c, 0) for c in sorted({int(j) // PARTNERS for j in near if j >= t})] + [(int(i), t // PARTNERS, 1) for i in near if i <= t]
                for k in range(0, len(keys), 8):
                    part = keys[k : k + 8]
                    yield pd.DataFrame({"owner": [x[0] for x in part], "block": [x[1] for x in part], "role": [x[2] for x in part], "tile": t, "ids": [row.ids] * len(part), "w": [row.w] * len(part), "x": [row.x] * len(part)})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        owner = _load(pdf[pdf["role"] == 0].iloc[0], axes, d)
        found = []
        for _, row in pdf[pdf["role"] == 1].sort_values("tile").iterrows():
            same = row["tile"] == row["owner"]
            found.append(compare_tiles(owner, owner if same else _load(row, axes, d), threshold, same))
        ids, to, n = (np.concatenate(v) if found else np.zeros(0, np.int64) for v in (zip(*found, strict=True) if found else ((), (), ())))
        out = pd.DataFrame({"class_id": ids.astype(np.int64), "to": to.astype(np.int64), "n": n.astype(np.int64)})
        return out.groupby(["class_id", "to"], as_index=False)["n"].sum()

    routed = tiles.select("leaf", "chunk", "ids", "w", "x").mapInPandas(route, "owner long, block long, role int, tile long, ids binary, w binary, x binary")
    return routed.groupBy("owner", "block").applyInPandas(compare, "class_id long, to long, n long")


def near_duplicates(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, class_id (least id of an equal vector), n_links, component_id and kept for every row."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    top = F.array_max(F.transform("x", F.abs))
    good = F.coalesce(F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (top > 0), F.lit(False))
    alone = rows.where(~good).select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    valid = rows.where(good)
    classes = materialise(valid.groupBy("x").agg(F.min("vec_id").cast("long").alias("class_id"), F.count("*").alias("weight")), "classes")
    found = None
    for r in classes.groupBy(F.size("x").alias("d")).count().orderBy("d").collect():
        part = _links_of_length(classes.where(F.size("x") == r["d"]), r["d"], threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    found = materialise(found, "links")
    counts = found.groupBy("class_id").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("to <> class_id").select(F.col("class_id").alias("a"), F.col("to").alias("b")))
    told = materialise(
        classes.join(counts, "class_id", "left")
        .join(parts.withColumnRenamed("node", "class_id").withColumnRenamed("component", "part"), "class_id", "left")
        .select("x", "class_id", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("part", "class_id").alias("component_id")),
        "told",
    )
    size = classes.agg(F.sum("weight").alias("rows"), F.max("weight").alias("most")).first()
    limit = max(HUB_LEAST, size["rows"] // HUB_SHARE)
    if size["most"] > limit:  # rows of vectors with very many copies, HUB_SHARE vectors at most, stay where they are
        hot = F.broadcast(told.where(F.col("weight") > limit))
        out = valid.join(hot, "x").unionByName(valid.join(hot, "x", "left_anti").join(told.where(F.col("weight") <= limit), "x"))
    else:
        out = valid.join(told, "x")
    out = out.select("vec_id", "class_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.95).select("vec_id", "n_links", "component_id", "kept")


OP3_SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
g as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v
  where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.vec_id as a, b.vec_id as b from g a join g b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where a.n > 0 and b.n > 0 and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
c as (select vec_id as node, vec_id as label from v union select p.b, c.label from c join p on p.a = c.node),
m as (select node, min(label) as component_id from c group by node),
k as (select a, count(*) as n_links from p group by a)
select v.vec_id, coalesce(k.n_links, 0)::bigint as n_links, m.component_id, v.vec_id = m.component_id as kept
from v join m on m.node = v.vec_id left join k on k.a = v.vec_id
"""
