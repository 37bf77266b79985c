"""Op 5. Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A node of weight W has a draw for each unit of its weight, -ln(u), u from a hash of the key, the region's name and the unit's
number (a last part of a unit divides its draw by its size); the node's own draw is the least of these. A key descends: from
the regions to the one with the least draw, from that one's racks to the one with the least, and so from that one's shards
(`descend`). So each level gets keys in proportion to weight, and a node whose weight stays keeps its draw: movement stays
within the subtrees whose weights change. Racks and regions are filled one after the other; a new shard brings its region's
last units, and wins only keys that go to it (law `key`), at every level and for any number of shards.

The tree is data: one expression walks its levels, whatever the number of nodes.

Defined cases: a null key hashes as a null and has a place like any other; a null text has no bytes (size 1, crc 0); an
empty text the same; rows that repeat a key go to the same shard and take slots of their own; an empty table gives an
empty result; further columns of the input, whatever their names, are left out.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import let
from leafmill.llm.common import table
from leafmill.llm.mixing import uniform

#: A tree is a list of regions, a region (name, racks), a rack (name, shards), a shard (number, weight).
Tree = list[tuple[str, list[tuple[str, list[tuple[int, float]]]]]]

ROWS_PER_SLOT_BUCKET = 100_000
LEAST_BUCKETS, MOST_BUCKETS = 32, 4096


SHARDS_PER_RACK, RACKS_PER_REGION = 4, 4


def layout(n_shards: int, shards_per_rack: int = SHARDS_PER_RACK, racks_per_region: int = RACKS_PER_REGION) -> Tree:
    """Shards 0 to n-1 of weight 1, added one by one."""
    tree: Tree = []
    for _ in range(n_shards):
        tree = grow(tree, 1.0, shards_per_rack, racks_per_region)
    return tree


def grow(tree: Tree, weight: float = 1.0, shards_per_rack: int = SHARDS_PER_RACK, racks_per_region: int = RACKS_PER_REGION) -> Tree:
    """The tree with one more shard: in the last rack, else in a new rack of the last region, else in a new region."""
    n = 1 + max((s for _, racks in tree for _, shards in racks for s, _ in shards), default=-1)
    shard = (n, weight)
    if tree:
        region, racks = tree[-1]
        rack, shards = racks[-1]
        if len(shards) < shards_per_rack:
            return [*tree[:-1], (region, [*racks[:-1], (rack, [*shards, shard])])]
        if len(racks) < racks_per_region:
            return [*tree[:-1], (region, [*racks, (f"{region}/k{len(racks)}", [shard])])]
    name = f"g{len(tree)}"
    return [*tree, (name, [(f"{name}/k0", [shard])])]


def units(tree: Tree) -> list[tuple[str, float, int]]:
    """(path, size, shard) of each unit of weight: numbered within its region, racks and shards in order."""
    out = []
    for region, racks in tree:
        i = 0
        for shard, weight in (s for _, shards in racks for s in shards):
            left = weight
            while left > 0:
                out.append((f"{region}/{i}", min(1.0, left), shard))
                left -= 1.0
                i += 1
    return out


def draws(key: Column, tree: Tree) -> Column:
    """array<struct<draw, shard>> of a key, one for each unit of the tree in order."""
    found = units(tree)
    told = lambda values: F.split(F.lit(",".join(map(str, values))), ",")  # noqa: E731  one literal, however many units
    paths, sizes, shards = (told(c) for c in zip(*found, strict=True))
    sizes, shards = sizes.cast("array<double>"), shards.cast("array<int>")
    return F.transform(paths, lambda p, i: F.struct((-F.log(uniform(key, p)) / F.get(sizes, i)).alias("draw"), F.get(shards, i).alias("shard")))


#: A node: its first unit (from 1), how many it has, its name and its children; nodes without weight are left out.
_SHARDS = "array<struct<first:int,units:int,shard:int>>"
_RACKS = f"array<struct<first:int,units:int,name:string,children:{_SHARDS}>>"
_REGIONS = f"array<struct<first:int,units:int,name:string,children:{_RACKS}>>"


def nodes(tree: Tree) -> list[dict]:
    """The tree with the units of each node: a region's are those of its racks, a rack's those of its shards."""

    def node(children: list[dict], **named) -> list[dict]:
        return [{"first": children[0]["first"], "units": sum(c["units"] for c in children), **named, "children": children}] if children else []

    first, regions = 1, []
    for region, racks in tree:
        inner = []
        for rack, shards in racks:
            leaves = []
            for shard, weight in shards:
                n = math.ceil(weight)
                leaves += [{"first": first, "units": n, "shard": shard}] if n else []
                first += n
            inner += node(leaves, name=rack)
        regions += node(inner, name=region)
    return regions


def _pick(race: Column, children: Column) -> Column:
    """The child with the least draw; a child's draw is the least of its units'."""
    drawn = F.transform(children, lambda c: F.struct(F.array_min(F.slice(race, c["first"], c["units"]))["draw"].alias("draw"), c.alias("child")))
    return F.array_min(drawn)["child"]


def descend(race: Column, tree: Tree) -> Column:
    """struct<region, rack, shard>: from a key's draws down the tree, a pick at each level among the children of the node picked before. Draws beyond the tree's units are not looked at."""
    top = F.from_json(F.lit(json.dumps(nodes(tree))), _REGIONS)  # one literal
    path = lambda g, k, s: F.struct(g["name"].alias("region"), k["name"].alias("rack"), s["shard"].alias("shard"))
    return let(_pick(race, top), lambda g: let(_pick(race, g["children"]), lambda k: let(_pick(race, k["children"]), lambda s: path(g, k, s))))


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key under a tree, an int."""
    return let(draws(key, tree), lambda race: descend(race, tree)["shard"])


def _bucket(key: Column, buckets: int) -> Column:
    return F.floor(uniform(key, F.lit("slot")) * buckets).cast("int")


def assign_shards(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tree: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of df.

    Slots are gapless without one task a shard: rows of a shard are hashed into buckets, numbered within each bucket,
    and shifted by the rows of the buckets before. The table of bucket counts has n_shards * MOST_BUCKETS rows at most,
    whatever the input, so it is broadcast.
    """
    tree = layout(n_shards) if tree is None else tree
    grown = grow(tree)
    key = F.col(id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.count()
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, math.ceil(rows / (n_shards * ROWS_PER_SLOT_BUCKET))))
    placed = df.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        let(draws(key, grown), lambda race: F.struct(descend(race, tree)["shard"].alias("now"), descend(race, grown)["shard"].alias("grown"))).alias("_shards"),
        _bucket(key, buckets).alias("_bucket"),
    )
    placed = placed.withColumns({"shard": F.col("_shards.now"), "grown_shard": F.col("_shards.grown")}).drop("_shards")  # a grown tree's new units come last
    numbered = placed.withColumn("_at", F.expr("row_number() over (partition by shard, _bucket order by doc_id)"))
    counts = df.select(shard_of(key, tree).alias("shard"), _bucket(key, buckets).alias("_bucket")).groupBy("shard", "_bucket").count()
    before = counts.selectExpr("shard", "_bucket", "coalesce(sum(count) over (partition by shard order by _bucket rows between unbounded preceding and 1 preceding), 0) as _before")
    return numbered.join(F.broadcast(before), ["shard", "_bucket"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("_before") + F.col("_at") - 1).cast("long").alias("slot"), "grown_shard"
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), n_shards=8)


def _sql(n: int) -> str:
    def placed(tree: Tree, out: str) -> str:
        return f"select doc_id, arg_min(t.shard, -ln((('0x' || substr(md5(doc_id || ':' || t.path), 1, 13))::bigint + 0.5) * pow(2.0, -52)) / t.size)::int as {out} from documents, (values {', '.join(map(str, units(tree)))}) t(path, size, shard) group by doc_id"

    return f"""
with t as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
d as (select doc_id, strlen(coalesce(text, ''))::bigint + 1 as size, hex(encode(coalesce(text, ''))) as h from documents),
c as (select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::bigint as text_crc32 from d, t),
a as ({placed(layout(n), "shard")}), b as ({placed(layout(n + 1), "grown_shard")}),
p as (select *, floor((('0x' || substr(md5(doc_id || ':slot'), 1, 13))::bigint + 0.5) * pow(2.0, -52) * least({MOST_BUCKETS}, greatest({LEAST_BUCKETS}, (select ceil(count(*) / {n * ROWS_PER_SLOT_BUCKET}.0) from documents)))) as bucket from a)
select doc_id, size, text_crc32, 'key' as law, shard, (row_number() over (partition by shard order by bucket, doc_id) - 1)::bigint as slot, grown_shard
from p join b using (doc_id) join d using (doc_id) join c using (doc_id)
"""


OP5_SQL = _sql(8)
