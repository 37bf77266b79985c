"""Chunked extraction against a plain loop over documents."""

import random
import re
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.operators import extraction
from leafmill.operators.extraction import Chunking

PAGES = "paper_id string, pages array<struct<page_index int, text string>>"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab .!?\n\"…"), max_size=200), st.integers(1, 30))
def test_spans_cover_the_text(text, most):
    spans = list(extraction.text_spans(text, most))
    assert "".join(text[a:b] for a, b in spans) == text and all(0 < b - a <= most for a, b in spans)
    ends = [0] + [m.end() for m in re.finditer(r"[.!?…]+[\"]*\s+|\n+", text)] + [len(text)]
    for (_, e), (_, f) in zip(spans, spans[1:]):  # a span ends with a sentence, unless the sentence is too long for one
        if e not in ends:
            a, b = max(x for x in ends if x < e), min(x for x in ends if x >= e)
            assert b - a > most
        assert f - _start(spans, e) > most or any(e < x for x in ends)


def _start(spans, end):
    return next(a for a, b in spans if b == end)


def marked(pages):
    return "\n\n".join(f"[Page {i + 1}]\n{t.strip()}" for i, t in pages if t.strip())


def plain(records, extractor, prompt, c):
    """One document after the other, with finds compared pairwise."""
    out = {}
    for pid, pages in records:
        text = marked(pages or [])
        if not text:
            out[pid] = ("failed", "no extractable text", [])
            continue
        found, error = [], None
        for n in range(c.passes):
            for a, b in extraction.text_spans(text, c.max_chars):
                try:
                    answer = extractor(text[a:b], prompt)
                except Exception as e:  # noqa: BLE001
                    error = error or (a, str(e) or type(e).__name__)
                    error = min(error, (a, str(e) or type(e).__name__))
                    continue
                seen = {}
                for x in answer:
                    t = x["extraction_text"] or ""
                    at = text.find(t, a + seen.get(t, 0), b) if t else -1
                    at = text.find(t, a, b) if t and at < 0 else at
                    seen[t] = at - a + len(t)
                    span = (at, at + len(t)) if at >= 0 else None
                    earlier = [f for f in found if f[0] < n and a <= f[4] < b]
                    if n and any(span is None and f[3] is None and f[1:3] == (x["extraction_class"], x["extraction_text"]) or span and f[3] and f[3][0] < span[1] and span[0] < f[3][1] for f in earlier):
                        continue
                    found.append((n, x["extraction_class"], x["extraction_text"], span, a))
        out[pid] = ("failed", error[1], []) if error else ("processed", None, [(f[1], f[2], *(f[3] or (None, None))) for f in found])
    return out


def got(df):
    return {r["paper_id"]: (r["status"], r["error"], [(e["extraction_class"], e["extraction_text"], e["char_start"], e["char_end"]) for e in r["extractions"]]) for r in df.collect()}


class Fickle:
    """Answers that depend on the text only, but differ with the pass: the second one tells longer, overlapping, new and unplaced finds."""

    def __init__(self):
        self.seen = {}

    def __call__(self, text, prompt):
        if "explode" in text:
            raise ValueError(f"bad {text[:12]}")
        n = self.seen[text] = self.seen.get(text, 0) + 1
        words = re.findall(r"w\d+", text)
        mine = words[:3] if n % 2 else words[1:6] + words[:1] + ["not there", ""]
        pairs = [f"{a} {b}" for a, b in zip(words[4:], words[5:])][:2] if not n % 2 else ["absent", "w0 w0"]
        return [{"extraction_class": f"c{i % 2}", "extraction_text": t, "alignment_status": None} for i, t in enumerate(mine + pairs)]


def documents():
    r = random.Random(1)
    text = lambda n: " ".join(f"w{r.randrange(30)}" + r.choice(["", "", "", ".", "!", ".\n"]) for _ in range(n))
    docs = [(str(k), [(i, text(r.randrange(0, 60))) for i in range(r.randrange(0, 6))]) for k in range(25)]
    return [*docs, ("none", None), ("blank", [(0, " \n ")]), ("bad", [(0, text(40)), (1, "then explode here. " + text(30)), (2, "explode again")]), ("long", [(0, "".join(f"x{i:03d}" for i in range(220)) + " w1. " + "".join(f"y{i:03d}" for i in range(120)))])]


def test_equals_a_plain_loop(spark):
    docs = documents()
    df = spark.createDataFrame(docs, PAGES).repartition(3)
    for c in (Chunking(max_chars=80, batch_length=3, passes=1), Chunking(max_chars=150, batch_length=4, passes=2, tasks=3)):
        assert got(extraction.extract(df, Fickle(), "p", chunking=c)) == plain(docs, Fickle(), "p", c)


def test_a_volume_is_spread_over_tasks(spark, tmp_path):
    """280 pages of one document: batches of at most 8, in several tasks, each span once a pass."""
    from pyspark import TaskContext

    pages = [(i, f"Page {i} says value {i}. " * 60) for i in range(280)]
    df = spark.createDataFrame([("v", pages)], PAGES)

    class Here(extraction.RuleExtractor):
        def batch(self, spans):
            (tmp_path / f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}").write_text(str(len(spans)))
            return [self(t, p) for t, p in spans]

    rules = Here((("value", r"value \d+"),))
    c = Chunking(tasks=4)
    (r,) = extraction.extract(df, rules, "", chunking=c).collect()
    text = marked(pages)
    assert [(e["char_start"], e["char_end"]) for e in r["extractions"]] == [m.span() for m in re.finditer(r"value \d+", text)]
    spans = len(list(extraction.text_spans(text, 1200)))
    asked = [(f.name.split("-")[0], int(f.read_text())) for f in tmp_path.iterdir()]
    assert sum(n for _, n in asked) == 2 * spans and max(n for _, n in asked) == 8
    by_task = {t: sum(n for x, n in asked if x == t) for t, _ in asked}
    assert len(by_task) == 4 and max(by_task.values()) < spans


def test_the_page_marked_text_is_made_once(spark):
    """Blank documents are told apart without it, and the spans of many short documents share a batch."""
    rows = [(str(i), [(0, "Ab. " if i % 3 else " \u2003\n")]) for i in range(60)] + [("n", None), ("z", [(0, None), (1, "x")])]
    got = extraction.extract(spark.createDataFrame(rows, PAGES).coalesce(1), extraction.RuleExtractor((("w", "Ab"),)), "", chunking=Chunking(tasks=1))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("[Page ") == 1
    told = {r["paper_id"]: (r["status"], len(r["extractions"])) for r in got.collect()}
    assert told == {str(i): ("processed", 1) if i % 3 else ("failed", 0) for i in range(60)} | {"n": ("failed", 0), "z": ("processed", 0)}
