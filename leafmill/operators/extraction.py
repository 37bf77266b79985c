"""Providers: what parses files, runs OCR or extracts snippets is injected and runs in mapInPandas.

A provider is a picklable callable made once a task. An exception in it becomes an error of its row, so one bad document
never stops a batch.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import SPACE, id_prefix, page_marked_text, strip, utc_iso
from leafmill.operators.quality import finish_record, ocr_decision
from leafmill.schemas import EXTRACTION

#: bytes of a file -> texts of its pages
PageReader = Callable[[bytes], list[str]]
#: bytes of a file, mode -> bytes of a searchable copy
Ocr = Callable[[bytes, str], bytes]
#: text, prompt -> extractions (dicts with extraction_class, extraction_text, alignment_status)
Extractor = Callable[[str, str], list[dict]]

_PAGES = "pages array<struct<page_index:int,text:string>>, page_char_counts array<int>"


@dataclass(frozen=True)
class PlainPages:
    """Pages of text files, divided by form feeds."""

    encoding: str = "utf-8"

    def __call__(self, content: bytes) -> list[str]:
        return content.decode(self.encoding, "replace").split("\f")


@dataclass(frozen=True)
class RuleExtractor:
    """Deterministic extractor for tests and dry deployments: each pattern of a class yields its matches in order."""

    rules: tuple[tuple[str, str], ...]

    def __call__(self, text: str, prompt: str) -> list[dict]:
        return [{"extraction_class": name, "extraction_text": m.group(0), "alignment_status": "match_exact"} for name, rule in self.rules for m in re.finditer(rule, text)]


def _pages(texts: list[str]) -> tuple[list[dict], list[int]]:
    clean = [t.replace(" ", " ").strip() for t in texts]
    return [{"page_index": i, "text": t} for i, t in enumerate(clean)], [len(t) for t in clean]


def read_pages(files: DataFrame, reader: PageReader) -> DataFrame:
    """binaryFile rows with pages, page_char_counts and error."""
    keep = files.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + f", {_PAGES}, error string"

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            pages, counts, errors = [], [], []
            for content in pdf["content"]:
                try:
                    p, c = _pages(reader(bytes(content)))
                    e = None
                except Exception as exc:  # noqa: BLE001  a row's error is its result
                    p, c, e = [], [], str(exc) or type(exc).__name__
                pages.append(p)
                counts.append(c)
                errors.append(e)
            yield pdf[keep].assign(pages=pages, page_char_counts=counts, error=errors)

    return files.mapInPandas(run, schema)


def apply_ocr(records: DataFrame, reader: PageReader, ocr: Ocr | None) -> DataFrame:
    """Pages replaced by those of the OCR copy where ocr_mode asks for it; ocr_applied and ocr_error tell the outcome."""
    if ocr is None:
        return records.withColumn("ocr_applied", F.lit(False)).withColumn("ocr_error", F.lit(None).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema) + ", ocr_applied boolean, ocr_error string"

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            applied, errors = [], []
            pages, counts = list(pdf["pages"]), list(pdf["page_char_counts"])
            for i, (mode, content) in enumerate(zip(pdf["ocr_mode"], pdf["content"], strict=True)):
                done, err = False, None
                if mode:
                    try:
                        pages[i], counts[i] = _pages(reader(ocr(bytes(content), mode)))
                        done = True
                    except Exception as exc:  # noqa: BLE001
                        err = str(exc) or type(exc).__name__
                applied.append(done)
                errors.append(err)
            yield pdf.assign(pages=pages, page_char_counts=counts, ocr_applied=applied, ocr_error=errors)

    return records.mapInPandas(run, schema)


def text_records(files: DataFrame, reader: PageReader, ocr: Ocr | None = None, extractor: str = "pages") -> DataFrame:
    """Text records of binaryFile rows (path, content), with `error` for files that could not be read."""
    named = files.select(id_prefix(F.col("path")).alias("paper_id"), F.substring_index("path", "/", -1).alias("source_filename"), F.sha2("content", 256).alias("source_sha256"), "content")
    done = finish_record(apply_ocr(ocr_decision(read_pages(named, reader)), reader, ocr)).drop("content")
    return done.withColumn("extractor", F.lit(extractor)).withColumn("extracted_at_utc", utc_iso(F.current_timestamp()))


@dataclass(frozen=True)
class Chunking:
    """How an extractor is asked: spans of at most max_chars that end at sentence ends, batch_length of them at once, `passes` times; 0 tasks: as many as shuffle partitions."""

    max_chars: int = 1200
    batch_length: int = 8
    passes: int = 2
    tasks: int = 0


#: A sentence's end with the white space after it, or a line's end.
_SENTENCE_END = re.compile(r"""[.!?\u2026\u3002]+["'\u201d\u2019)\]]*\s+|\n+""")


def text_spans(text: str, max_chars: int) -> Iterator[tuple[int, int]]:
    """(start, end) of spans that cover the text in order: as many whole sentences as fit; a longer sentence is cut at its last blank that fits, or hard."""
    start = fits = 0
    for end in [m.end() for m in _SENTENCE_END.finditer(text)] + [len(text)]:
        if end - start > max_chars and fits > start:
            yield start, fits
            start = fits
        while end - start > max_chars:
            cut = max(text.rfind(" ", start + 1, start + max_chars), text.rfind("\n", start + 1, start + max_chars)) + 1
            cut = cut if cut > start + 1 else start + max_chars
            yield start, cut
            start = cut
        fits = end
    if start < len(text):
        yield start, len(text)


def _located(items: list[dict], span: str, base: int) -> list[dict]:
    """Finds with their offsets in the document: of a text that is found again the next occurrence; none where the span does not hold it."""
    out, after = [], {}
    for x in items:
        e = {k: (None if x.get(k) is None else str(x[k])) for k in ("extraction_class", "extraction_text", "alignment_status")}
        t = e["extraction_text"] or ""
        at = span.find(t, after.get(t, 0)) if t else -1
        at = span.find(t) if t and at < 0 else at
        after[t] = at + len(t)
        out.append(e | {"char_start": base + at if at >= 0 else None, "char_end": base + at + len(t) if at >= 0 else None})
    return out


def first_finds(passes: list[list[dict]]) -> list[tuple[int, dict]]:
    """(pass, find) of the first pass's finds, and of later ones that overlap none kept before; without offsets, that equal none."""
    kept: list[tuple[int, dict]] = []
    for n, items in enumerate(passes):
        before = [e for _, e in kept]
        spans = sorted((e["char_start"], e["char_end"]) for e in before if e["char_start"] is not None)
        starts, ends = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))  # furthest end of all that start no later
        known = {(e["extraction_class"], e["extraction_text"]) for e in before}
        for e in items:
            if n and e["char_start"] is None and (e["extraction_class"], e["extraction_text"]) in known:
                continue
            if n and e["char_start"] is not None and (i := bisect_left(starts, e["char_end"])) and ends[i - 1] > e["char_start"]:
                continue
            kept.append((n, e))
    return kept


def ask(extractor: Extractor, spans: list[tuple[str, str]]) -> list[list[dict] | Exception]:
    """Answers to (text, prompt)s. An extractor with a method `batch` is asked for all at once, and for each alone if that fails."""
    if hasattr(extractor, "batch"):
        try:
            return list(extractor.batch(spans))
        except Exception:  # noqa: BLE001  one span's error is not that of its neighbours
            pass
    out: list[list[dict] | Exception] = []
    for text, prompt in spans:
        try:
            out.append(list(extractor(text, prompt)))
        except Exception as exc:  # noqa: BLE001
            out.append(exc)
    return out


_FIND = pa.struct([("extraction_class", pa.string()), ("extraction_text", pa.string()), ("alignment_status", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32())])
_SPANS = pa.schema([("paper_id", pa.string()), ("span", pa.int32()), ("start", pa.int32()), ("text", pa.string()), ("prompt", pa.string())])
_ANSWERS = pa.schema([("paper_id", pa.string()), ("span", pa.int32()), ("error", pa.string()), ("found", pa.list_(pa.struct([("pass", pa.int32()), ("k", pa.int32()), ("e", _FIND)])))])
#: Characters and rows of a batch of spans.
_BATCH_CHARS, _BATCH_ROWS = 1 << 22, 5000


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def extract(records: DataFrame, extractor: Extractor, prompt: str | Column, dry_run: bool = False, chunking: Chunking = Chunking()) -> DataFrame:
    """paper_id, status (`processed`, `validated` in a dry run, `failed`), error, extractions of records with pages; a prompt for all or a column.

    Texts are cut into spans, and spans, not documents, are dealt to tasks, so that a volume is asked by many. Finds carry their offsets
    in the page-marked text; those of a later pass that overlap an earlier find are dropped; order is by pass, span and answer. A document
    whose text is blank fails, and so does one with a failing span, with the error of the first. Texts, prompts and answers of one document
    are bounded by the document; nothing else meets in one task.
    """
    asked = F.lit(prompt) if isinstance(prompt, str) else prompt
    pages = F.coalesce("pages", F.array().cast("array<struct<page_index:int,text:string>>"))
    blank = ~F.exists(pages, lambda p: F.coalesce(p["text"], F.lit("")).rlike(f"(?!{SPACE})(?s:.)"))  # ends at the first character shown; the page-marked text is made once
    empties = records.select("paper_id", blank.alias("_empty"))
    if dry_run:
        return empties.select("paper_id", F.when(F.col("_empty"), "failed").otherwise("validated").alias("status"), F.when(F.col("_empty"), "no extractable text").alias("error"), F.array().cast(f"array<{EXTRACTION}>").alias("extractions"))
    texts = records.select(F.col("paper_id").cast("string").alias("paper_id"), page_marked_text(pages).alias("text"), asked.cast("string").alias("prompt"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for batch in batches:
            for pid, text, asked in zip(*(batch.column(c).to_pylist() for c in ("paper_id", "text", "prompt")), strict=True):
                for n, (s, e) in enumerate(text_spans(text, chunking.max_chars) if text else ()):
                    rows.append((pid, n, s, text[s:e], asked))
                    chars += e - s + len(asked or "")
                    if chars > _BATCH_CHARS or len(rows) >= _BATCH_ROWS:  # many short documents fill a batch, a long one several
                        yield _batch(rows, _SPANS)
                        rows, chars = [], 0
        if rows:
            yield _batch(rows, _SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = list(zip(*(batch.column(c).to_pylist() for c in _SPANS.names), strict=True))
            rows = []
            for lo in range(0, len(told), chunking.batch_length):
                part = told[lo : lo + chunking.batch_length]
                asked = [(text, prompt) for _, _, _, text, prompt in part]
                answers = [ask(extractor, asked) for _ in range(chunking.passes)]
                for i, (pid, span, start, text, _) in enumerate(part):
                    mine = [a[i] for a in answers]
                    error = next((str(x) or type(x).__name__ for x in mine if isinstance(x, Exception)), None)
                    found = [] if error is not None else first_finds([_located(x, text, start) for x in mine])
                    rows.append((pid, span, error, [{"pass": n, "k": k, "e": e} for k, (n, e) in enumerate(found)]))
            if rows:
                yield _batch(rows, _ANSWERS)

    spans = texts.mapInArrow(cut, "paper_id string, span int, start int, text string, prompt string")
    dealt = spans.repartition(chunking.tasks or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "paper_id", "span")
    answers = dealt.mapInArrow(run, f"paper_id string, span int, error string, found array<struct<pass:int,k:int,e:{EXTRACTION}>>")
    ordered = F.array_sort(F.flatten(F.collect_list(F.transform("found", lambda f: F.struct(f["pass"].alias("pass"), F.col("span"), f["k"].alias("k"), f["e"].alias("e"))))))
    told = answers.groupBy("paper_id").agg(F.min_by(F.when(F.col("error").isNotNull(), F.col("error")), F.when(F.col("error").isNotNull(), F.col("span"))).alias("_error"), ordered.alias("_found"))
    both = empties.join(told, "paper_id", "left")
    error = F.when(F.col("_empty"), F.lit("no extractable text")).otherwise(F.col("_error"))
    found = F.when(error.isNull(), F.transform("_found", lambda f: f["e"])).otherwise(F.array().cast(f"array<{EXTRACTION}>"))
    return both.select("paper_id", F.when(error.isNull(), "processed").otherwise("failed").alias("status"), error.alias("error"), found.alias("extractions"))


def exploded(extracted: DataFrame) -> DataFrame:
    """(paper_id, pos, extraction_class, extraction_text) of an array of extractions."""
    return extracted.select("paper_id", F.posexplode("extractions").alias("pos", "x")).select("paper_id", "pos", "x.extraction_class", strip(F.coalesce("x.extraction_text", F.lit(""))).alias("extraction_text"))
