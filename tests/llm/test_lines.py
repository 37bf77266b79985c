import brute
from conftest import prose
from oracle import assert_same

from leafmill.llm import lines, registry


def rows(df):
    return sorted(map(str, ((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect())))


def test_query_equals_sql(spark, sf):
    assert_same(registry.queries()["op13_line_dedup"](spark, sf), registry.oracle_sql()["op13_line_dedup"], sf)


def test_no_python_worker(spark, sf):
    plan = registry.queries()["op13_line_dedup"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def pages(spark):
    """Lines that differ in blanks and case only, lines of blanks, repeated lines within a document, an id with two texts, repeated rows."""
    out = []
    for k in range(14):
        own = [prose(200 + k, 6), "\tSubscribe NOW\r", "", "  ", f"menu {k % 7}", "Ünï É" if k < 10 else "ünï é", "again", "again"]
        out.append((k, "\n".join(own[k % 3 :])))
    return [*out, out[3], out[3], (3, "subscribe now"), (None, "subscribe now\nx"), (None, "subscribe now\nx"), (50, None), (51, ""), (52, "\n\n"), (53, "a\n")]


def test_equals_brute_force(spark):
    data = pages(spark)
    df = spark.createDataFrame([(*r, "n", 1) for r in data], "doc_id long, text string, kept string, p int").repartition(4)
    for least, most in ((10, 0), (10, 10**6), (2, 0), (2, 3)):
        want = sorted(map(str, brute.drop_lines(data, least)))
        assert rows(lines.drop_lines(df, least, broadcast_keys=most)) == want
    unique = {i: (i, t) for i, t in data if i is not None}.values()
    got = lines.drop_lines(spark.createDataFrame(list(unique), "doc_id long, text string"), 4, 5)
    assert rows(got) == sorted(map(str, brute.drop_lines(list(unique), 4, 5)))


def test_odd_rows(odd, empty):
    data = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for least in (2, 10):
        assert rows(lines.drop_lines(odd, least)) == sorted(map(str, brute.drop_lines(data, least)))
    assert lines.drop_lines(empty).count() == 0


def test_a_long_document(spark):
    text = "\n".join(f"line {k % 700}" for k in range(60_000))
    data = [(k, text if k < 2 else "line 5\nown") for k in range(11)]
    assert rows(lines.drop_lines(spark.createDataFrame(data, "doc_id long, text string"))) == sorted(map(str, brute.drop_lines(data)))
