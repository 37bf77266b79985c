import numpy as np
from oracle import assert_same

from leafmill.llm import embeddings, registry


def test_query_equals_sql(spark, sf):
    assert_same(registry.queries()["op3_embedding_near_dedup"](spark, sf), registry.oracle_sql()["op3_embedding_near_dedup"], sf)


def brute(rows, t=0.95):
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.abs(v).max() for i, v in good.items()}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = {i: [j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= t] for i in unit}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links.get(i, [])), min(seen))
    return out


def test_odd_vectors_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 10))
    rows = [(i, (base[i % 12] + rng.normal(scale=0.08, size=10)).tolist()) for i in range(160)]
    rows += [(200, None), (201, []), (202, [0.0] * 10), (203, [1.0] * 9 + [None]), (204, [float("nan")] * 10), (205, [float("inf")] + [1.0] * 9), (206, base[0].tolist()), (207, base[0].tolist()), (208, (base[0] * 1e200).tolist()), (209, (base[0] * 1e-200).tolist()), (210, base[1][:4].tolist()), (211, (base[1][:4] * 2).tolist())]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, label int, n_links int")
    want = brute(rows)
    for tile in (2048, 16):
        monkeypatch.setattr(embeddings, "TILE", tile)
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
        assert got == want, tile
    lone = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted((str(r["vec_id"]), r["n_links"], r["kept"]) for r in embeddings.near_duplicates(lone).collect()) == [("1", 1, True), ("1", 1, True), ("None", 0, True)]


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_cosines_at_the_threshold_link(spark):
    """Integer vectors with dot / (|a| |b|) = 0.95 exactly, in both ways of comparing, at any scale."""
    for scale in (1.0, 3.0, 2.0**-700):
        rows = [(1, [3.0, 0.0, 0.0, 0.0, 0.0]), (2, [38 * scale, 3 * scale, 7 * scale, 7 * scale, 7 * scale]), (3, [38.0, 4.0, 7.0, 7.0, 7.0])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {r["vec_id"]: r["component_id"] for r in embeddings.near_duplicates(df).collect()}
        assert got[2] == 1, scale
    a, b = np.array([[3.0, 0, 0, 0, 0]]), np.vstack([[38.0, 3, 7, 7, 7], -np.eye(5).repeat(30, 0)])
    axes = np.eye(5)
    for many in (1, len(b)):  # few or many pairs pass the first bound
        assert embeddings.linked(embeddings.vectors_of(a, axes), embeddings.vectors_of(b[:many], axes), 0.95)[0, 0]


def test_leaves_of_several_tiles_and_hot_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(9, 8))
    rows = [(i, (base[i % 9] + rng.normal(scale=0.1, size=8)).tolist()) for i in range(120)] + [(1000 + i, base[0].tolist()) for i in range(60)]
    for name, value in (("TILE", 8), ("LEAVES", 2), ("HUB_LEAST", 10), ("HUB_SHARE", 10)):
        monkeypatch.setattr(embeddings, name, value)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute(rows)
