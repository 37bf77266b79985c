"""Column functions on text; all of them stay inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python counts as white space, for Java's regular expressions.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The same, one by one.
SPACES = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_LOW_SPACES, _HIGH_SPACES = ("".join(x for x in SPACES if x != " " and (x < "\u0100") == low) for low in (True, False))
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
#: What is no letter or digit of a normalised text; a class that names its characters is looked up, not compared range by range.
_GAP = "[^abcdefghijklmnopqrstuvwxyz0123456789]"
#: Runs of these but for single spaces, which stay.
_GAPS = rf"{_GAP}(?:(?<! )|{_GAP}){_GAP}*"


@lru_cache
def _ascii_table() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions within the basic plane: single characters by translate(), the others (ligatures, fractions) one by one.

    Letters of the first alphabets that have none end the first text, so that translate() drops them.
    """
    single_from, single_to, several, dropped = [], [], {}, []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single_from.append(chr(code))
            single_to.append(plain)
        elif plain and not any(c.isalnum() for c in plain):
            single_from.append(chr(code))
            single_to.append(" ")
        elif plain and (code < 0x250 or 0xFB00 <= code <= 0xFB06 or 0x2100 <= code < 0x2190):
            several[chr(code)] = plain
        elif not plain and code < 0x530:
            dropped.append(chr(code))
    return "".join(single_from + dropped), "".join(single_to), several


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(SPACES))  # looks at the ends only, which a pattern for the right one doesn't


def collapse_space(c: Column) -> Column:
    """Runs of white space become one space; the pattern is run only over texts that hold anything but single spaces."""
    wide = F.octet_length(c) != F.char_length(c)
    odd = F.contains(c, F.lit("  ")) | c.rlike(f"[{_LOW_SPACES}]") | (wide & c.rlike(f"(?=[^\\x00-\\xff])[{_HIGH_SPACES}]"))
    return F.trim(F.when(odd, F.regexp_replace(c, rf"{SPACE}{{2,}}|[\t-\r\x1c-\x1f\x85\p{{Z}}&&[^ ]]", " ")).otherwise(c))


def split_lines(c: Column) -> Column:
    """The text's lines by LINE_BREAK, which is sought only in texts that hold a break other than a line feed."""
    wide = F.octet_length(c) != F.char_length(c)
    other = c.rlike(r"[\r\x0b\x0c\x1c\x1d\x1e\x85]") | (wide & c.rlike(r"(?=[^\x00-\xff])[\u2028\u2029]"))
    return F.when(other, F.split(c, LINE_BREAK)).otherwise(F.split(c, "\n"))


def is_blank(c: Column) -> Column:
    """Whether nothing but white space is in it; looks no further than the first other character."""
    return F.ltrim(c, F.lit(SPACES)) == ""


def normalize_text(c: Column) -> Column:
    """Lower-case ASCII words joined by single spaces; accents are dropped. Null counts as empty."""
    source, target, several = _ascii_table()
    text = F.coalesce(c, F.lit(""))
    ascii_only = lambda c: F.octet_length(c) == F.char_length(c)  # noqa: E731  cheap, and true of most texts at one of the two steps

    table = F.str_to_map(F.lit("\x01".join(f"{char}\x02{plain}" for char, plain in several.items())), F.lit("\x01"), F.lit("\x02"))

    def letters(c: Column) -> Column:
        return F.transform(F.split(c, ""), lambda x: F.when(x < "\x80", x).otherwise(F.coalesce(F.try_element_at(table, x), F.lit(""))))

    def spelled(c: Column) -> Column:
        # what has no spelling goes at once; letters are looked up one by one only where one that has is left
        known = F.regexp_replace(c, "(?=[^\\x00-\\x7f])[^" + "".join(several) + "]", "")
        return F.when(ascii_only(c), c).otherwise(let(known, lambda k: F.when(ascii_only(k), k).otherwise(F.array_join(letters(k), ""))))

    # the lambda keeps the translated text from being computed for each use
    folded = F.when(ascii_only(text), text).otherwise(F.get(F.transform(F.array(F.translate(text, source, target)), spelled), F.lit(0)))
    return F.trim(F.regexp_replace(F.lower(folded), _GAPS, " "))


def words(c: Column) -> Column:
    """Words of a normalised text."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def token_set(c: Column, min_len: int = 3, normalized: bool = False) -> Column:
    return F.array_distinct(F.filter(F.split(c if normalized else normalize_text(c), " "), lambda w: F.length(w) >= min_len))


def control_char_count(c: Column) -> Column:
    """Control characters other than line feed, carriage return and tab."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(CONTROL))


def any_marker(c: Column, markers: Iterable[str]) -> Column:
    """Whether any marker is a substring."""
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(c, F.lit(m))
    return out


def count_markers(c: Column, markers: Iterable[str]) -> Column:
    """How many of the markers are substrings."""
    out = F.lit(0)
    for m in markers:
        out = out + F.contains(c, F.lit(m)).cast("int")
    return out


def page_marked_text(pages: Column) -> Column:
    """Pages in array order, each under a line that names its number; blank pages are skipped."""
    shown = F.transform(pages, lambda p: F.struct((F.coalesce(p["page_index"], F.lit(0)) + 1).alias("n"), strip(F.coalesce(p["text"], F.lit(""))).alias("t")))
    return strip(F.array_join(F.transform(F.filter(shown, lambda p: p["t"] != ""), lambda p: F.concat(F.lit("[Page "), p["n"].cast("string"), F.lit("]\n"), p["t"])), "\n\n"))


def bool_text(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), F.lit("true")).otherwise(F.lit("false"))


def falsy_text(c: Column, kind: str) -> Column:
    """Text of a value, empty for null, 0, false and the empty string; true is `True`."""
    if kind == "boolean":
        return F.when(c, F.lit("True")).otherwise(F.lit(""))
    if kind in ("int", "bigint", "double", "float", "smallint", "tinyint"):
        return F.when(F.coalesce(c, F.lit(0)) == 0, F.lit("")).otherwise(c.cast("string"))
    return F.coalesce(c.cast("string"), F.lit(""))


def join_values(arr: Column, sep: str = " | ", keep_blank: bool = False) -> Column:
    return F.array_join(arr if keep_blank else F.filter(arr, lambda x: x != ""), sep)


def stem(path: Column) -> Column:
    """File name without its directory and last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def id_prefix(filename: Column) -> Column:
    """What stands before the first underscore of a file's stem."""
    return F.substring_index(stem(filename), "_", 1)


def relative_path(path: Column, root: str) -> Column:
    """Path under root, or as it is if it lies elsewhere."""
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def utc_iso(c: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
