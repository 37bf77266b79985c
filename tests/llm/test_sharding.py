import zlib

import pytest
from oracle import assert_same

from leafmill.llm import registry, sharding


def check(rows, docs, n):
    assert len(rows) == len(docs)
    for r in rows:
        t = docs[r["doc_id"]] if r["doc_id"] in docs else None
        b = (t or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(b) + 1, zlib.crc32(b), "key")
        assert 0 <= r["shard"] < n and r["grown_shard"] in (r["shard"], n)
    for s in range(n):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_documents(docs, doc_rows):
    check(sharding.assign_shards(docs).collect(), dict(doc_rows), 8)


def test_odd_and_empty(odd, empty):
    rows = sharding.assign_shards(odd, 3).collect()
    assert len(rows) == odd.count()
    for s in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in rows if r["doc_id"] == 8}) == 1
    assert sharding.assign_shards(empty).count() == 0


def test_shards_are_even_and_follow_weights(spark):
    big = spark.range(40_000).selectExpr("id as doc_id", "'t' as text")
    sizes = [r["count"] for r in sharding.assign_shards(big).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.06 * 5000 and min(sizes) > 0.94 * 5000
    tree = [("a", [("a/k", [(0, 1.0), (1, 3.0)])]), ("b", [("b/k", [(2, 4.0), (3, 0.0)])])]
    got = {r["shard"]: r["count"] for r in sharding.assign_shards(big, 4, tree=tree).groupBy("shard").count().collect()}
    assert 3 not in got and got[0] == pytest.approx(5000, rel=0.06) and got[1] == pytest.approx(15000, rel=0.06) and got[2] == pytest.approx(20000, rel=0.06)


def test_movement_stays_in_the_changed_subtree(spark):
    from pyspark.sql import functions as F

    old = [("g0", [("g0/k0", [(0, 1.0), (1, 1.0)]), ("g0/k1", [(2, 1.0), (3, 1.0)])]), ("g1", [("g1/k0", [(4, 2.0)])])]
    new = [("g0", [("g0/k0", [(0, 1.0), (1, 1.0)]), ("g0/k1", [(2, 2.0), (3, 0.0)])]), *old[1:]]  # within one rack
    moved = spark.range(20_000).select(sharding.shard_of(F.col("id"), old).alias("a"), sharding.shard_of(F.col("id"), new).alias("b")).where("a <> b").distinct().collect()
    assert {(r["a"], r["b"]) for r in moved} == {(3, 2)}


def test_movement_follows_region_weights(spark):
    """A region that gains weight takes keys from others into itself; between the others nothing moves."""
    from pyspark.sql import functions as F

    old = [(f"g{r}", [(f"g{r}/k0", [(4 * r, 1.0), (4 * r + 1, 1.0)]), (f"g{r}/k1", [(4 * r + 2, 1.5)])]) for r in range(3)]
    new = [old[0], ("g1", [old[1][1][0], ("g1/k1", [(6, 3.0)])]), old[2]]
    moved = spark.range(20_000).select(sharding.shard_of(F.col("id"), old).alias("a"), sharding.shard_of(F.col("id"), new).alias("b")).where("a <> b").distinct().collect()
    assert moved and {r["b"] for r in moved} == {6} and {r["a"] for r in moved} == {0, 1, 2, 4, 5, 8, 9, 10}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    """For every number of shards from 1 to 64, whether the new one joins a rack, opens a rack or a region; racks and regions have several children."""
    from pyspark.sql import functions as F

    widest = sharding.layout(65)
    assert len(widest) == 5 and all(len(racks) == 4 and all(len(shards) == 4 for _, shards in racks) for _, racks in widest[:4])
    race = sharding.draws(F.col("id"), widest)
    names = [F.transform(F.sequence(F.lit(1), F.lit(65)), lambda n: F.array_min(F.slice(race, F.lit(1), n))["shard"]).alias("m")]
    rows = spark.range(300).select("id", *names).collect()
    for r in rows:
        assert all(r["m"][n] in (r["m"][n - 1], n) for n in range(1, 65))
    for n in (1, 3, 4, 5, 16, 17, 40, 64):
        own = {r["id"]: (r["a"], r["b"]) for r in spark.range(300).select("id", sharding.shard_of(F.col("id"), sharding.layout(n)).alias("a"), sharding.shard_of(F.col("id"), sharding.grow(sharding.layout(n))).alias("b")).collect()}
        assert own == {r["id"]: (r["m"][n - 1], r["m"][n]) for r in rows}


def test_many_shards_are_planned_quickly(spark):
    import time

    big = spark.range(2000).selectExpr("id as doc_id", "'t' as text").repartition(4)
    sharding.assign_shards(big, 2).collect()
    began = time.monotonic()
    df = sharding.assign_shards(big, 1000)
    df._jdf.queryExecution().executedPlan()
    planned = time.monotonic() - began
    rows = df.collect()
    assert planned < 6 and len({r["shard"] for r in rows}) > 800 and all(r["grown_shard"] in (r["shard"], 1000) for r in rows)


def test_tree_equals_brute_force(spark):
    """Draws of plain Python: each region's least, then the unit that won names the rack and shard."""
    import hashlib
    import math

    from pyspark.sql import functions as F

    trees = [[("a", [("a/k", [(0, 1.0), (1, 3.0)]), ("a/l", [(4, 0.5)])]), ("b", [("b/k", [(2, 4.0), (3, 0.0)])])], sharding.layout(8), sharding.layout(21)]

    def draw(key, region, i, size):
        return -math.log((int(hashlib.md5(f"{key}:{region}/{i}".encode()).hexdigest()[:13], 16) + 0.5) * 2.0**-52) / size

    def descend(key, tree):
        best = []
        for region, racks in tree:
            sizes = []
            for rack, shards in racks:
                for s, w in shards:
                    sizes += [(rack, s, 1.0)] * int(w) + ([(rack, s, w % 1)] if w % 1 else [])
            best.append(min((draw(key, region, i, size), rack, s) for i, (rack, s, size) in enumerate(sizes)))
        return min(best)[2]

    for tree in trees:
        for r in spark.range(500).select("id", sharding.shard_of(F.col("id"), tree).alias("s")).collect():
            assert r["s"] == descend(r["id"], tree)


def test_a_key_descends_level_by_level(spark):
    """At each level the child with the least draw among the children of the node before it, by draws of its own units only; no node without weight is entered."""
    from pyspark.sql import functions as F

    weighted = [("a", [("a/k", [(0, 1.0), (1, 2.5)]), ("a/e", [(7, 0.0)]), ("a/l", [(4, 0.5)])]), ("e", [("e/k", [(8, 0.0)])]), ("b", [("b/k", [(2, 4.0), (3, 0.0)])])]
    for tree in (weighted, sharding.layout(8), sharding.layout(21)):
        race = sharding.draws(F.col("id"), tree)
        entered = set()
        for r in spark.range(300).select(race.alias("race"), sharding.descend(race, tree).alias("p")).collect():
            least = lambda shards, r=r: min((x["draw"] for x in r["race"] if x["shard"] in shards), default=float("inf"))
            region = min(tree, key=lambda g: least({s for _, shards in g[1] for s, _ in shards}))
            rack = min(region[1], key=lambda k: least({s for s, _ in k[1]}))
            shard = min(rack[1], key=lambda s: least({s[0]}))[0]
            assert (r["p"]["region"], r["p"]["rack"], r["p"]["shard"]) == (region[0], rack[0], shard)
            entered |= {region[0], rack[0], shard}
        assert entered == {x for g, racks in tree for k, shards in racks for s, w in shards if w for x in (g, k, s)}


def test_query_equals_sql(spark, sf):
    assert_same(registry.queries()["op5_sharding"](spark, sf), registry.oracle_sql()["op5_sharding"], sf)
