"""The relational part of acquiring files: names, link classification, what is left to fetch, cards of a listing page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import strip, utc_iso
from leafmill.schemas import MANIFEST_DDL

#: id, label -> what is known of the file: status and any of the manifest's other fields
Fetcher = Callable[[str, str], dict]

LINK_TEXT = r"(?i)\.pdf\b"
LINK_HREF = r"(?i)(\.pdf\b|application%2fpdf)"


def sanitize_filename(c: Column) -> Column:
    """Characters that file systems reject become underscores; `.pdf` is ensured."""
    clean = F.regexp_replace(strip(F.regexp_replace(c, r'[<>:"/\\|?*]', "_")), r"\.+$", "")
    return F.when(F.lower(clean).endswith(".pdf"), clean).otherwise(F.concat(clean, F.lit(".pdf")))


def is_pdf_link(text: Column, href: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(LINK_TEXT) | F.coalesce(href, F.lit("")).rlike(LINK_HREF)


def absolute_url(page_url: Column, href: Column) -> Column:
    """href resolved against the page: absolute, host-relative or relative to the page's directory."""
    href = strip(F.coalesce(href, F.lit("")))
    host = F.regexp_extract(page_url, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(page_url, r"[?#].*$", ""), r"^([a-zA-Z][\w+.-]*://.*/)", 1)
    return (
        F.when(href == "", page_url)
        .when(href.rlike(r"^[a-zA-Z][\w+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(page_url, r"^([a-zA-Z][\w+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(host, href))
        .otherwise(F.concat(F.when(folder == "", F.concat(host, F.lit("/"))).otherwise(folder), href))
    )


def link_filename(text: Column, url: Column) -> Column:
    """The link's text if it names a PDF, else the last part of the URL's path."""
    name = F.substring_index(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][\w+.-]*://[^/]*", ""), "/", -1)
    text = strip(F.coalesce(text, F.lit("")))
    return sanitize_filename(F.when(text.rlike(LINK_TEXT), text).otherwise(F.try_url_decode(name)))


def links(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Anchors of HTML pages: (id, pos, text, href, url, filename, is_pdf)."""
    anchor = r"(?is)<a\b[^>]*?href\s*=\s*[\"']?([^\"'\s>]*)[^>]*>(.*?)</a>"
    found = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("_page"), F.posexplode(F.arrays_zip(F.regexp_extract_all(html_col, F.lit(anchor), F.lit(1)).alias("href"), F.regexp_extract_all(html_col, F.lit(anchor), F.lit(2)).alias("raw"))).alias("pos", "a"))
    told = found.select("id", "pos", "_page", F.col("a.href").alias("href"), strip(F.regexp_replace("a.raw", "<[^>]*>", "")).alias("text"))
    told = told.withColumn("url", absolute_url(F.col("_page"), F.col("href")))
    return told.select("id", "pos", "text", "href", "url", link_filename(F.col("text"), F.col("url")).alias("filename"), is_pdf_link(F.col("text"), F.col("href")).alias("is_pdf"))


def card_label(lines: Column) -> Column:
    """First line that is no id, control, file name or year, cut to 240 characters."""
    ignore = r"(?i)^#\s*\d+|^view full text$|\.pdf$|^\d{4}$"
    return F.coalesce(F.substring(F.get(F.filter(lines, lambda x: (x != "") & ~x.rlike(ignore)), F.lit(0)), 1, 240), F.lit(""))


def cards(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """covidence_id and label of card texts, the first for each id."""
    lines = F.filter(F.transform(F.split(text_col, r"\r?\n"), strip), lambda x: x != "")
    told = texts.select(F.col(id_col).alias("_at"), F.regexp_extract(text_col, r"#\s*(\d{2,})\b", 1).alias("covidence_id"), card_label(lines).alias("label")).where("covidence_id <> ''")
    return told.groupBy("covidence_id").agg(F.min_by("label", "_at").alias("label"))


def to_fetch(cards_df: DataFrame, present: DataFrame, ids: list[str] = (), limit: int = 0) -> DataFrame:
    """Cards without a file (present: id), restricted to ids and limited."""
    todo = cards_df.where(F.col("covidence_id").isin(list(ids))) if ids else cards_df
    todo = todo.join(present.select(F.col("id").alias("covidence_id")).distinct(), "covidence_id", "left_anti").orderBy("covidence_id")
    return todo.limit(limit) if limit > 0 else todo


def skipped_rows(cards_df: DataFrame, present: DataFrame) -> DataFrame:
    """Manifest rows of cards whose file is already there."""
    first = present.select(F.col("id").alias("covidence_id"), F.element_at("paths", 1).alias("saved_path"))
    return cards_df.join(first, "covidence_id").select("covidence_id", "label", F.lit("skipped_existing").alias("status"), "saved_path", F.substring_index("saved_path", "/", -1).alias("source_filename"), F.lit("").alias("download_url"), F.lit("").alias("error"))


def attempts(cards_df: DataFrame, fetcher: Fetcher) -> DataFrame:
    """A manifest row for each of (covidence_id, label), of a table or a stream. An exception of the fetcher is a failed row with its text."""
    fields = ("status", "saved_path", "source_filename", "download_url", "method", "error")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for i, label in zip(pdf["covidence_id"], pdf["label"], strict=True):
                begun = pd.Timestamp.now("UTC")
                try:
                    told = fetcher(i, label)
                except Exception as exc:  # noqa: BLE001  an attempt's error is its result
                    told = {"status": "failed", "error": str(exc) or type(exc).__name__}
                rows.append((i, label, *[told.get(f) if f == "method" else told.get(f, "") for f in fields], begun, pd.Timestamp.now("UTC")))
            yield pd.DataFrame(rows, columns=["covidence_id", "label", *fields, "started", "finished"])

    out = cards_df.select("covidence_id", "label").mapInPandas(run, "covidence_id string, label string, " + ", ".join(f"{f} string" for f in fields) + ", started timestamp, finished timestamp")
    out = out.withColumn("started_at_utc", utc_iso(F.col("started"))).withColumn("finished_at_utc", utc_iso(F.col("finished")))
    return out.select(*[c.split()[0] for c in MANIFEST_DDL.split(", ")])
