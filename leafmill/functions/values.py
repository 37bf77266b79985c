"""Column functions on dictionary-driven values: parsing, coercion, defaults, type resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.config import NA_HINTS, PUBLICATION_ALIASES, VALUE_SEPARATORS
from leafmill.functions.text import any_marker, let, strip


def parse_value(c: Column, separators: Sequence[str] = VALUE_SEPARATORS) -> Column:
    """Text before the first separator by priority, not by position."""
    raw = strip(F.coalesce(c, F.lit("")))
    out = raw
    for sep in reversed(separators):
        out = F.when(F.contains(raw, F.lit(sep)), strip(F.substring_index(raw, sep, 1))).otherwise(out)
    return out


def accepts_na(accepted: Column) -> Column:
    return F.coalesce(F.exists(accepted, lambda x: F.upper(strip(x)) == "NA"), F.lit(False))


VALUE = "struct<s:string,i:bigint>"


def _text(c: Column) -> Column:
    return F.struct(c.alias("s"), F.lit(None).cast("bigint").alias("i"))


def _integer(digits: Column) -> Column:
    fits = digits.try_cast("bigint")
    return F.struct(F.when(fits.isNull(), digits).alias("s"), fits.alias("i"))


def normalise_value(raw: Column, inferred: Column, accepted: Column) -> Column:
    """struct<s, i>: the coerced value, in i if it is an integer of 64 bits, else in s (digits of a longer integer as they stand)."""

    def coerced(raw: Column, low: Column) -> Column:
        hinted = any_marker(low, NA_HINTS)
        binary = F.when(raw.rlike(r"(?U)\b1\b"), "1").when(raw.rlike(r"(?U)\b0\b"), "0").when(hinted | (raw == ""), "NA").otherwise(raw)
        tokens = F.coalesce(accepted, F.array().cast("array<string>"))
        exact = F.get(F.filter(tokens, lambda t: F.lower(t) == low), F.lit(0))
        inside = F.get(F.filter(tokens, lambda t: (t != "") & F.contains(low, F.lower(t))), F.lit(0))
        na_token = F.get(F.filter(tokens, lambda t: F.upper(t) == "NA"), F.lit(0))
        categorical = F.coalesce(exact, inside, F.when(hinted, F.coalesce(na_token, F.lit("NA"))), raw)
        number = F.regexp_extract(raw, r"-?\d+", 0)
        return (
            F.when(inferred == "binary_ordinal", _text(binary))
            .when(inferred == "categorical", _text(categorical))
            .when(inferred == "integer", F.when(hinted, _text(F.lit("NA"))).when(number != "", _integer(number)).otherwise(_text(raw)))
            .when(inferred == "integer_or_string_id", F.when(raw.rlike(r"^-?\d+$"), _integer(raw)).otherwise(_text(raw)))
            .when((inferred == "string") & (raw == "") & accepts_na(accepted), _text(F.lit("NA")))
            .otherwise(_text(raw))
        )

    return let(strip(F.coalesce(raw, F.lit(""))), lambda raw: let(F.lower(raw), lambda low: coerced(raw, low)))


def default_value(inferred: Column, accepted: Column) -> Column:
    """struct<s, i> for a field without an extraction."""
    return _text(F.when(inferred.isin("binary_ordinal", "integer") | accepts_na(accepted), "NA").otherwise(""))


def value_text(v: Column) -> Column:
    return F.coalesce(v["i"].cast("string"), v["s"])


def resolve_type(c: Column, types: Sequence[str], aliases: Sequence[tuple[str, str]] = PUBLICATION_ALIASES) -> Column:
    """Exact match, else the first type that contains the candidate or is contained in it, else the first alias; null if none."""
    none = F.lit(None).cast("string")

    def told(cand: Column) -> Column:
        out = none
        for key, target in reversed([a for a in aliases if a[1] in types]):
            out = F.when(F.contains(cand, F.lit(key)), F.lit(target)).otherwise(out)
        for t in reversed(types):
            out = F.when(F.contains(cand, F.lit(t.lower())) | F.contains(F.lit(t.lower()), cand), F.lit(t)).otherwise(out)
        exact = {t.lower(): t for t in types}
        for low, t in reversed(exact.items()):
            out = F.when(cand == low, F.lit(t)).otherwise(out)
        return F.when(cand == "", none).otherwise(out)

    return let(F.lower(strip(F.coalesce(c, F.lit("")))), told)  # the candidate can be a whole text: it is made once, not for each comparison
