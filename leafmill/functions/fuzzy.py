"""Fuzzy scores of titles and authors. Only the sequence ratio leaves the JVM, in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.config import DEFAULT, Thresholds
from leafmill.functions.text import let, normalize_text, strip, token_set


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio with its defaults, the reference title first; null and empty texts give 0, equal ones 1."""
    return pd.Series([0.0 if not x or not y else 1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def sequence_ratio_from(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """sequence_ratio() where it reaches `least`; 0 where the letters that both texts hold already rule that out, or a text is null."""

    def one(x: str | None, y: str | None, bound: float) -> float:
        if not x or not y:
            return 0.0
        if x == y:
            return 1.0
        m = SequenceMatcher(None, x, y)
        return m.ratio() if m.quick_ratio() >= bound else 0.0

    return pd.Series([one(x, y, bound) for x, y, bound in zip(a, b, least, strict=True)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """No sequence ratio is larger: all of the shorter text would match."""
    x, y = F.length(a), F.length(b)
    return F.coalesce(2 * F.least(x, y) / F.nullif(x + y, F.lit(0)), F.lit(0.0))


def token_overlap(ref: Column, block: Column) -> Column:
    """Share of the reference's tokens of 4 letters or more in the block, at least 0.95 if one text contains the other; both are normalised."""

    def told(ref: Column, block: Column) -> Column:
        share = let(token_set(ref, 4, normalized=True), lambda tokens: F.size(F.array_intersect(tokens, token_set(block, 4, normalized=True))) / F.greatest(F.lit(1), F.size(tokens)))
        return let(share, lambda s: F.when(F.contains(block, ref) | F.contains(ref, block), F.greatest(s, F.lit(0.95))).otherwise(s))

    return let(ref, lambda r: let(block, lambda b: told(r, b)))  # given as expressions, both are normalised once


def combine_title(ref: Column, block: Column, ratio: Column, overlap: Column) -> Column:
    return F.when((ref == "") | (block == ""), F.lit(0.0)).when(ref == block, F.lit(1.0)).otherwise(F.greatest(ratio, 0.65 * ratio + 0.35 * overlap))


def score_title(ref_title: Column, block_title: Column) -> Column:
    ref, block = normalize_text(ref_title), normalize_text(block_title)
    return combine_title(ref, block, sequence_ratio(ref, block), token_overlap(ref, block))


def surnames(authors: Column, most: int = DEFAULT.thresholds.surnames) -> Column:
    """Normalised surnames of `Last, F; Last, F`, distinct in order, the first few."""
    names = F.transform(F.split(F.coalesce(authors, F.lit("")), ";"), lambda a: normalize_text(F.substring_index(strip(a), ",", 1)))
    return F.slice(F.array_distinct(F.filter(names, lambda n: n != "")), 1, most)


def score_authors(names: Column, block_text: Column) -> Column:
    """Share of the surnames that stand in the block as a substring, or with all their tokens of 3 letters or more."""
    def found(n: Column, text: Column) -> Column:
        own = F.filter(F.split(n, " "), lambda w: F.length(w) >= 3)
        return F.contains(text, n) | ((F.size(own) > 0) & F.forall(own, lambda w: F.contains(text, F.concat(F.lit(" "), w, F.lit(" ")))))

    def share(names: Column) -> Column:
        # the block is normalised once, not once for each surname; between spaces its words are found without a set of them
        hits = let(F.concat(F.lit(" "), normalize_text(block_text), F.lit(" ")), lambda text: F.size(F.filter(names, lambda n: found(n, text))))
        # a name of one word stands in an ASCII text as in the normalised one, which only puts spaces for what is between words
        simple = (F.octet_length(block_text) == F.char_length(block_text)) & ~F.exists(names, lambda n: F.contains(n, F.lit(" ")))
        same = let(F.lower(block_text), lambda low: F.size(F.filter(names, lambda n: F.contains(low, n))))
        return F.when(F.size(names) > 0, F.when(simple, same).otherwise(hits) / F.size(names)).otherwise(F.lit(0.0))

    return let(names, share)


def match_score(title: Column, author: Column, t: Thresholds = DEFAULT.thresholds) -> Column:
    return t.title_weight * title + (1 - t.title_weight) * author


def accepted(title: Column, author: Column, match: Column, t: Thresholds = DEFAULT.thresholds) -> Column:
    return (title >= t.title_alone) | ((title >= t.title_with_author) & (author >= t.author) & (match >= t.match))
