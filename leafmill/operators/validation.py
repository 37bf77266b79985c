"""Validation against a subset of JSON Schema.

compile_schema() turns a flat object schema into one Column of error texts over typed columns; a null column is an absent key.
compile_json_schema() does so over JSON texts of any shape. Both stay inside the JVM. Validator checks plain Python values, one at a time.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.config import DEFAULT
from leafmill.functions.text import let

_KINDS = {
    "string": (T.StringType,),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "number": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType),
    "boolean": (T.BooleanType,),
    "array": (T.ArrayType,),
    "object": (T.StructType, T.MapType),
    "null": (),
}


def _shown(c: Column, kind: T.DataType, most: int = 80) -> Column:
    text = F.concat(F.lit("'"), c.cast("string"), F.lit("'")) if isinstance(kind, T.StringType) else c.cast("string")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def _number(x: Any) -> str:
    return str(x)


def _errors(c: Column, kind: T.DataType, schema: dict, path: str) -> list[Column]:
    """Columns that are an error text or null; a wrong type or value outside the enumeration ends the node."""
    shown = _shown(c, kind)
    if "anyOf" in schema:
        good = F.lit(False)
        for option in schema["anyOf"]:
            bad = F.lit(False)
            for e in _errors(c, kind, option, path):
                bad = bad | e.isNotNull()
            good = good | ~bad
        return [F.when(~good, F.concat(F.lit(f"{path}: value "), shown, F.lit(" does not match anyOf options")))]
    wanted = schema.get("type")
    if isinstance(wanted, str) and wanted in _KINDS and not isinstance(kind, _KINDS[wanted]):
        return [F.concat(F.lit(f"{path}: expected type '{wanted}', got "), shown)]
    out: list[Column] = []
    inside = F.lit(True)
    if "enum" in schema:
        literals = [v for v in schema["enum"] if v is not None and isinstance(v, str) == isinstance(kind, T.StringType)]
        inside = c.isin(literals) if literals else F.lit(False)
        out.append(F.when(~inside, F.concat(F.lit(f"{path}: value "), shown, F.lit(f" not in enum {schema['enum']}"))))
    if isinstance(kind, _KINDS["number"]):
        if "minimum" in schema:
            out.append(F.when(inside & (c < schema["minimum"]), F.concat(F.lit(f"{path}: value "), c.cast("string"), F.lit(f" < minimum {_number(schema['minimum'])}"))))
        if "maximum" in schema:
            out.append(F.when(inside & (c > schema["maximum"]), F.concat(F.lit(f"{path}: value "), c.cast("string"), F.lit(f" > maximum {_number(schema['maximum'])}"))))
    if isinstance(kind, T.StringType) and "pattern" in schema:
        out.append(F.when(inside & ~c.rlike(schema["pattern"]), F.concat(F.lit(f"{path}: value "), shown, F.lit(f" does not match pattern {schema['pattern']}"))))
    return out


def compile_schema(schema: dict, row: T.StructType, prefix: str = "") -> Column:
    """array<string> of errors of a row's columns, in the order: missing, additional, then column by column."""
    props = schema.get("properties", {})
    names = [f.name for f in row.fields]
    found: list[Column] = []
    for key in schema.get("required", []):
        missing = F.lit(f"$: missing required key '{key}'")
        found.append(F.when(F.col(prefix + key).isNull(), missing) if key in names else missing)
    if schema.get("additionalProperties", True) is False:
        found += [F.when(F.col(prefix + n).isNotNull(), F.lit(f"$: additional property '{n}' is not allowed")) for n in names if n not in props]
    for f in row.fields:
        if f.name in props:
            c = F.col(prefix + f.name)
            found += [F.when(c.isNotNull(), e) for e in _errors(c, f.dataType, props[f.name], f"$.{f.name}")]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def error_text(errors: Column, most: int = DEFAULT.thresholds.schema_errors) -> Column:
    """The first errors joined, with a count of the others; null without errors."""
    more = F.when(F.size(errors) > most, F.concat(F.lit(" (and "), (F.size(errors) - most).cast("string"), F.lit(" more)"))).otherwise("")
    return F.when(F.size(errors) > 0, F.concat(F.lit("Schema validation failed: "), F.array_join(F.slice(errors, 1, most), "; "), more))


class Validator:
    """Errors of plain values; one check for each keyword."""

    def __init__(self, schema: dict) -> None:
        self.schema = schema

    def __call__(self, value: Any) -> list[str]:
        return list(self._node(value, self.schema, "$"))

    @staticmethod
    def kind(value: Any) -> set[str]:
        if value is None:
            return {"null"}
        if isinstance(value, bool):
            return {"boolean"}
        if isinstance(value, int):
            return {"integer", "number"}
        return {{float: "number", str: "string", list: "array", dict: "object"}.get(type(value), "")}

    @staticmethod
    def shown(value: Any) -> str:
        text = repr(value)
        return text if len(text) <= 80 else text[:77] + "..."

    def _node(self, v: Any, s: dict, at: str):
        if (options := s.get("anyOf")) is not None:
            if all(any(True for _ in self._node(v, o, at)) for o in options):
                yield f"{at}: value {self.shown(v)} does not match anyOf options"
            return
        kinds, wanted = self.kind(v), s.get("type")
        if isinstance(wanted, str) and wanted in _KINDS and wanted not in kinds:
            yield f"{at}: expected type '{wanted}', got {self.shown(v)}"
            return
        if "enum" in s and v not in s["enum"]:
            yield f"{at}: value {self.shown(v)} not in enum {s['enum']}"
            return
        if "number" in kinds:
            if v < s.get("minimum", -math.inf):
                yield f"{at}: value {v} < minimum {s['minimum']}"
            if v > s.get("maximum", math.inf):
                yield f"{at}: value {v} > maximum {s['maximum']}"
        elif "string" in kinds and not re.search(s.get("pattern", ""), v):
            yield f"{at}: value {self.shown(v)} does not match pattern {s['pattern']}"
        elif "object" in kinds:
            yield from self._object(v, s, at)
        elif "array" in kinds:
            yield from self._array(v, s, at)

    def _object(self, v: dict, s: dict, at: str):
        props = s.get("properties", {})
        yield from (f"{at}: missing required key '{k}'" for k in s.get("required", []) if k not in v)
        if s.get("additionalProperties", True) is False:
            yield from (f"{at}: additional property '{k}' is not allowed" for k in v if k not in props)
        for k in filter(props.__contains__, v):
            yield from self._node(v[k], props[k], f"{at}.{k}")

    def _array(self, v: list, s: dict, at: str):
        if isinstance(items := s.get("items"), dict):
            for i, x in enumerate(v):
                yield from self._node(x, items, f"{at}[{i}]")
        if s.get("uniqueItems"):
            marks = [json.dumps(x, sort_keys=True, ensure_ascii=False, default=str) for x in v]
            seen: set[str] = set()
            again = next((i for i, m in enumerate(marks) if m in seen or seen.add(m)), None)
            if again is not None:
                yield f"{at}: duplicate item {self.shown(v[again])} not allowed (uniqueItems)"


#: Errors before they are worded: path, words before the value, its kind and text (null: none is shown), words after it.
_NONE = "array<struct<a:string,b:string,k:string,t:string,z:string>>"
#: Spark's words for the kinds of a variant, by the schema's.
_INTEGER, _FLOATS = "BIGINT", ("DECIMAL", "DOUBLE", "FLOAT")
_NAMED = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID", "array": "ARRAY", "object": "OBJECT", "integer": _INTEGER}
_SHOWN, _ENOUGH = 80, 600


def _variant_kind(v: Column, text: Column) -> Column:
    """The first word of a variant's schema; a whole number beyond 64 bits is kept as a decimal, which its text tells."""
    told = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return let(told, lambda t: F.when((t == "DECIMAL") & text.rlike("^-?[0-9]+$"), _INTEGER).otherwise(t))


def _float_text(text: Column) -> Column:
    """A number as the validator prints floats: shortest digits, an exponent below 1e-4 and from 1e16 on."""
    x = text.cast("double")
    plain = F.regexp_replace(x.cast("decimal(38,20)").cast("string"), r"(\.[0-9]*?[0-9])0+$", "$1")
    parts = F.split(x.cast("string"), "E")
    power = F.get(parts, F.lit(1)).cast("int")
    digits = F.lpad(F.abs(power).cast("string"), 2, "0")
    sci = F.concat(F.regexp_replace(parts[0], r"\.0$", ""), F.when(power < 0, "e-").otherwise("e+"), F.when(F.length(F.abs(power).cast("string")) > 2, F.abs(power).cast("string")).otherwise(digits))
    return F.when(power.isNull(), x.cast("string")).when((power >= -4) & (power < 16), plain).otherwise(sci)


def _string_text(text: Column) -> Column:
    """A string in quotes, double ones if it holds single ones only, with escapes of back slashes and control characters."""

    def quoted(s: Column) -> Column:
        double = F.contains(s, F.lit("'")) & ~F.contains(s, F.lit('"'))
        s = F.replace(s, F.lit("\\"), F.lit("\\\\"))
        for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            s = F.replace(s, F.lit(raw), F.lit(shown))
        spelled = F.array_join(F.transform(F.split(s, ""), lambda c: F.when(c.rlike("[\\x00-\\x1f\\x7f]"), F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")))).otherwise(c)), "")
        s = F.when(s.rlike("[\\x00-\\x1f\\x7f]"), spelled).otherwise(s)
        return F.when(double, F.concat(F.lit('"'), s, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return let(F.substring(text, 1, _ENOUGH), quoted)


def _json_text(text: Column) -> Column:
    """An array or object as the validator prints it; only its beginning is looked at, which is more than is shown."""
    tokens = F.regexp_extract_all(F.substring(text, 1, _ENOUGH), F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++'), F.lit(0))

    def token(t: Column) -> Column:
        other = F.replace(F.replace(F.regexp_replace(t, r"\s+", ""), F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))
        for json_word, word in (("true", "True"), ("false", "False"), ("null", "None")):
            other = F.replace(other, F.lit(json_word), F.lit(word))
        return F.when(F.startswith(t, F.lit('"')), _string_text(F.try_variant_get(F.try_parse_json(t), "$", "string"))).when(t.rlike("^-?[0-9]+[.eE]"), _float_text(t)).otherwise(other)

    return F.array_join(F.transform(tokens, token), "")


def _value_text(kind: Column, text: Column) -> Column:
    whole = (
        F.when(kind == "STRING", _string_text(text))
        .when(kind == "VOID", "None")
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(kind == _INTEGER, text)
        .when(kind.isin(*_FLOATS), _float_text(text))
        .otherwise(_json_text(text))
    )
    return let(whole, lambda t: F.when(F.length(t) <= _SHOWN, t).otherwise(F.concat(F.substring(t, 1, _SHOWN - 3), F.lit("..."))))


def _child_path(key: str) -> str:
    for quote in ("'", '"'):
        if quote not in key:
            return f"$[{quote}{key}{quote}]"
    raise ValueError(f"a property name with both kinds of quotes: {key}")


def _error(at: Column, before: str | Column, kind: Column | None = None, text: Column | None = None, after: str = "") -> Column:
    null = F.lit(None).cast("string")
    return F.struct(at.alias("a"), (F.lit(before) if isinstance(before, str) else before).alias("b"), (null if kind is None else kind).alias("k"), (null if text is None else text).alias("t"), F.lit(after).alias("z"))


def _worded(errors: Column) -> Column:
    """Errors as texts. Values are put in words here only, so that the expression of a wide schema stays small."""
    return F.transform(errors, lambda e: F.concat(e["a"], F.lit(": "), e["b"], F.when(e["k"].isNull(), "").otherwise(_value_text(e["k"], e["t"])), e["z"]))


def _node_errors(v: Column, text: Column, schema: dict, at: Column) -> Column:
    """Errors of a variant; text is its JSON, or a string's content. Each is computed once, however many checks use it."""
    return let(F.struct(v.alias("v"), text.alias("t"), _variant_kind(v, text).alias("k")), lambda x: _checks(x["v"], x["t"], x["k"], schema, at))


def _checks(v: Column, text: Column, kind: Column, schema: dict, at: Column) -> Column:
    bad = lambda before, after="": F.array(_error(at, before, kind, text, after))
    out = F.array().cast(_NONE)
    if (options := schema.get("anyOf")) is not None:
        every = F.lit(True)
        for o in options:
            every = every & (F.size(_checks(v, text, kind, o, at)) > 0)
        return F.when(every, bad("value ", " does not match anyOf options")).otherwise(out)
    if schema.get("properties") or schema.get("required") or schema.get("additionalProperties", True) is False:
        out = F.when(kind == "OBJECT", _object_errors(v, text, schema, at)).otherwise(out)
    if isinstance(schema.get("items"), dict) or schema.get("uniqueItems"):
        out = F.when(kind == "ARRAY", _array_errors(v, text, schema, at)).otherwise(out)
    if "pattern" in schema:
        out = F.when((kind == "STRING") & ~text.rlike(schema["pattern"]), bad("value ", f" does not match pattern {schema['pattern']}")).otherwise(out)
    bounds = []
    for name, sign in (("minimum", "<"), ("maximum", ">")):
        if name in schema:
            beyond = text.cast("double") < schema[name] if sign == "<" else text.cast("double") > schema[name]
            bounds.append(F.when(beyond, _error(at, "value ", kind, text, f" {sign} {name} {schema[name]}")))
    if bounds:
        out = F.when(kind.isin(_INTEGER, *_FLOATS), F.array_compact(F.array(*bounds))).otherwise(out)
    if "enum" in schema:
        out = F.when(~_in_enum(v, text, kind, schema["enum"]), bad("value ", f" not in enum {schema['enum']}")).otherwise(out)
    wanted = schema.get("type")
    if isinstance(wanted, str) and wanted in _KINDS:
        fits = kind.isin(_INTEGER, *_FLOATS) if wanted == "number" else kind == _NAMED[wanted]
        out = F.when(~fits, bad(f"expected type '{wanted}', got ")).otherwise(out)
    return out


def _in_enum(v: Column, text: Column, kind: Column, options: list) -> Column:
    """Whether a value is one of options; 1, 1.0 and true are equal there, as in the validator."""
    inside = F.lit(False)
    if strings := [o for o in options if isinstance(o, str)]:
        inside = inside | ((kind == "STRING") & text.isin(strings))
    if numbers := [float(o) for o in options if isinstance(o, (bool, int, float))]:
        value = F.when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0)).when(kind.isin(_INTEGER, *_FLOATS), text.cast("double"))
        inside = inside | F.coalesce(value.isin(numbers), F.lit(False))
    if None in options:
        inside = inside | (kind == "VOID")
    for o in options:
        if isinstance(o, (list, dict)):
            inside = inside | (kind.isin("ARRAY", "OBJECT") & (F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(o))))))
    return inside


def _object_errors(v: Column, text: Column, schema: dict, at: Column) -> Column:
    props, none = schema.get("properties", {}), F.array().cast(_NONE)

    def told(o: Column) -> Column:
        keys, parts = o["keys"], []
        if schema.get("required"):
            parts.append(F.array_compact(F.array(*[F.when(~F.array_contains(keys, k), _error(at, f"missing required key '{k}'")) for k in schema["required"]])))
        if schema.get("additionalProperties", True) is False:
            extra = F.filter(keys, lambda k: ~k.isin(list(props))) if props else keys
            parts.append(F.transform(extra, lambda k: _error(at, F.concat(F.lit("additional property '"), k, F.lit("' is not allowed")))))
        if props:  # in the order of the object's keys
            children = [
                F.struct(F.array_position(keys, k).alias("p"), F.when(F.array_contains(keys, k), _node_errors(F.variant_get(v, _child_path(k), "variant"), F.try_element_at(o["m"], F.lit(k)), s, F.concat(at, F.lit(f".{k}")))).otherwise(none).alias("e"))
                for k, s in props.items()
            ]
            parts.append(F.flatten(F.transform(F.array_sort(F.array(*children)), lambda c: c["e"])))
        return F.concat(*parts) if parts else none

    return let(F.from_json(text, "map<string,string>"), lambda m: let(F.struct(F.map_keys(m).alias("keys"), m.alias("m")), told))  # one parse; the map keeps the order of keys


def _array_errors(v: Column, text: Column, schema: dict, at: Column) -> Column:
    def told(a: Column) -> Column:
        values, texts, parts = a["v"], a["t"], []
        if isinstance(items := schema.get("items"), dict):
            parts.append(F.flatten(F.transform(values, lambda x, i: _node_errors(x, F.get(texts, i), items, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))))
        if schema.get("uniqueItems"):
            kind = lambda x, i: _variant_kind(x, F.get(texts, i))
            mark = F.transform(values, lambda x, i: F.concat_ws(" ", F.when(kind(x, i).isin(*_FLOATS), "FLOAT").otherwise(kind(x, i)), F.when(kind(x, i).isin(*_FLOATS), F.get(texts, i).cast("double").cast("string")).otherwise(F.to_json(x))))
            again = lambda m: F.get(F.filter(F.transform(m, lambda x, i: F.when(F.array_position(m, x) <= i, i)), lambda i: i.isNotNull()), F.lit(0))
            message = lambda i: _error(at, "duplicate item ", _variant_kind(F.get(values, i), F.get(texts, i)), F.get(texts, i), " not allowed (uniqueItems)")
            first = let(mark, lambda m: F.when(F.size(F.array_distinct(m)) < F.size(m), again(m)))
            parts.append(let(first, lambda i: F.when(i.isNull(), F.array().cast(_NONE)).otherwise(F.array(message(i)))))
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    return let(F.struct(F.variant_get(v, "$", "array<variant>").alias("v"), F.from_json(text, "array<string>").alias("t")), told)


def compile_json_schema(text: Column, schema: dict) -> Column:
    """array<string> of errors of a JSON text, of any nesting, inside the JVM: paths, messages and their order are Validator's.

    A schema becomes one expression over the parsed variant, arrays a transform; the order of an object's keys, which a variant does not
    keep, is read from the text. A null text, one that is no JSON, and an object that repeats a key have one error. Messages differ from
    Validator's in escapes of unprintable characters beyond ASCII only.
    """

    def root(v: Column) -> Column:
        own = F.when(F.startswith(F.ltrim(text), F.lit('"')), F.try_variant_get(v, "$", "string")).otherwise(F.trim(text))
        return F.when(v.isNull(), F.array(_error(F.lit("$"), "not a JSON text"))).otherwise(_node_errors(v, own, schema, F.lit("$")))

    return _worded(let(F.try_parse_json(text), root))


def nested_errors(df: DataFrame, json_col: str, schema: dict, out: str = "errors") -> DataFrame:
    """Adds the errors of a JSON text, of any nesting."""
    return df.withColumn(out, compile_json_schema(F.col(json_col), schema))
