"""compile_json_schema() against Validator, message by message."""

import json
import random

from pyspark.sql import functions as F

from leafmill.operators import validation

ITEM = {"type": "object", "required": ["id"], "additionalProperties": False, "properties": {"id": {"type": "integer", "minimum": 0}, "tags": {"type": "array", "items": {"type": "string", "pattern": "^[a-z]"}, "uniqueItems": True}, "of": {"anyOf": [{"type": "null"}, {"type": "number", "maximum": 9.5}, {"enum": ["NA", "it's"]}]}}}
SCHEMA = {
    "type": "object", "required": ["name", "items"], "additionalProperties": False,
    "properties": {"name": {"type": "string"}, "items": {"type": "array", "items": ITEM, "uniqueItems": True}, "grid": {"type": "array", "items": {"type": "array", "items": {"type": "number", "minimum": -1, "maximum": 1e17}}}, "flag": {"enum": [True, "yes", None, 2]}, "free": {}, "deep": {"type": "object", "properties": {"a": {"type": "object", "properties": {"b": {"type": "boolean"}}, "required": ["b"]}}}, "odd 'key'": {"type": "integer"}},
}


def some(r, depth=0):
    plain = [None, True, False, 0, 1, -3, 12, 2.0, 9.75, -0.5, 1e-5, 2.5e8, 1e16, 3e20, 123456789012345678901234567890, "", "x", "NA", "it's", 'say "hi"', "both ' and \"", "Ünï", "tab\there\nline\\", "z" * 120, "yes"]
    if depth > 2 or r.random() < 0.55:
        return r.choice(plain)
    if r.random() < 0.5:
        return [some(r, depth + 1) for _ in range(r.randrange(0, 4))]
    return {r.choice(["id", "tags", "of", "a", "b", "extra"]): some(r, depth + 1) for _ in range(r.randrange(0, 4))}


def record(r):
    item = lambda: r.choice([some(r), {"id": r.randrange(-2, 5), "tags": [r.choice(["a", "b", "C", 1]) for _ in range(r.randrange(0, 4))], "of": r.choice([None, 9.5, 10, "NA", "it's", [1]])}])
    parts = {"name": r.choice(["n", some(r)]), "items": r.choice([[item() for _ in range(r.randrange(0, 5))], some(r)]), "grid": r.choice([[[0, 1.5], [], [2e17, -4, "x"]], [[1], 1], some(r)]), "flag": r.choice([True, 1, 2.0, "yes", "no", None, [2]]), "free": some(r), "deep": r.choice([{"a": {"b": 1}}, {"a": {}}, {"a": {"b": True}}, {}, some(r)]), "odd 'key'": some(r), "more": 1}
    names = r.sample(list(parts), r.randrange(0, len(parts) + 1))
    return {n: parts[n] for n in names}


def test_equals_the_validator(spark):
    r = random.Random(9)
    values = [record(r) for _ in range(600)] + [some(r) for _ in range(200)]
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=i % 2 == 0, separators=(",", ":") if i % 3 else None)) for i, v in enumerate(values)], "i int, j string")
    validate, seen = validation.Validator(SCHEMA), set()
    for i, got in df.select("i", validation.compile_json_schema(F.col("j"), SCHEMA)).collect():
        want = validate(values[i])
        assert got == want, values[i]
        seen |= {m.split(": ", 1)[1].split(" ")[0] for m in want}
    assert {"expected", "missing", "additional", "value", "duplicate"} <= seen


def test_stays_in_the_jvm(spark):
    df = validation.nested_errors(spark.createDataFrame([('{"name": "a", "items": []}',), ("no json",), (None,), ('{"name":"a","name":"b","items":[]}',), ("[1",), (" [] ",)], "j string"), "j", SCHEMA)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r["errors"] for r in df.collect()] == [[], ["$: not a JSON text"], ["$: not a JSON text"], ["$: not a JSON text"], ["$: not a JSON text"], ["$: expected type 'object', got []"]]


def test_wide_schema_and_long_values(spark):
    """A schema as wide as those in use is planned and run in seconds; strings and arrays longer than what is shown."""
    import time

    schema = {"type": "object", "additionalProperties": False, "required": ["f3"], "properties": {f"f{k}": {"anyOf": [{"type": "integer", "minimum": 0}, {"enum": ["NA"]}]} if k % 3 else {"type": "string", "pattern": "^[a-z]*$"} for k in range(86)}}
    values = [{f"f{k}": k if k % 3 else "x" * (300 * k) for k in range(86)}, {"f1": "no", "f0": list(range(5000)), "f85": -1}]
    df = spark.createDataFrame([(json.dumps(v),) for v in values], "j string")
    began = time.monotonic()
    got = [r[0] for r in df.select(validation.compile_json_schema(F.col("j"), schema)).collect()]
    assert time.monotonic() - began < 60
    assert got == [validation.Validator(schema)(v) for v in values]


def test_an_object_is_parsed_once(spark):
    """Its keys come from the map of its values, in their order."""
    assert "json_object_keys" not in str(validation.compile_json_schema(F.col("j"), {"properties": {"b": {"type": "string"}, "a": {"type": "string"}}}))
