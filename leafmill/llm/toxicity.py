"""Op 10. Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a weighted lexicon, how near its words stand to second-person words, capitals,
punctuation and obfuscation rates. The lexicon (words and word beginnings) is learned from the labelled sample, in two
folds, so that the trees see features from a lexicon that has not seen their row; the calibration sees scores of trees
that have not seen its rows.

Everything is fitted on a bounded sample of labelled rows, PER_CLASS rows of each label in the mean, chosen by a hash
of the id; classes are weighted back to their true share.

Defined cases: a null or empty text has zero features and still gets a score; without labelled rows of both kinds every
score is the share of label 1 (0 if there is none); repeated rows get the same score; an empty table gives an empty
result; columns besides id and text are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import table
from leafmill.llm.language import held_out
from leafmill.llm.passages import column_chunks

PER_CLASS = 5000
LEXICON_ENTRIES = 1000
NEAR_WORDS = 5
#: Bytes of text that are taken out of a batch at once.
TEXT_BYTES = 1 << 20
STEMS = (3, 4, 5, 6)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur ya thou tu te toi ton ta tes vous votre vos tú ti tuyo tuya usted ustedes vosotros os du dich dir dein deine deiner deinen ihr euch euer eure sie ihnen".split()
)
_WORD = re.compile(r"[^\W_]+")
#: From the start of a run of letters on and without giving back, so that the time is linear in the text.
_MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$*!|+._-]++[^\W\d_]++)+")
_SPACED = re.compile(r"\b(?:[^\W\d_][ .*_-]){3,}[^\W\d_]\b")
_LONG_RUN = re.compile(r"([^\W\d_])\1\1")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"} | dict.fromkeys("*._- ", None))
FEATURES = 15


def terms(text: str) -> set[str]:
    """Distinct words, and word beginnings marked by a trailing `*`, of a lower-cased text."""
    words = set(_WORD.findall(text.lower()))
    return {w for w in words if len(w) >= 3} | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


class Lexicon:
    def __init__(self, weights: dict[str, float]) -> None:
        self.words = {t: w for t, w in weights.items() if not t.endswith("*")}
        self.stems = {t[:-1]: w for t, w in weights.items() if t.endswith("*")}
        self.first = {t[:3] for t in (*self.words, *self.stems)}

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def features(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * FEATURES
        low = text.lower()
        words = _WORD.findall(low)
        n, first = len(words), self.first
        hits = [(i, x) for i in [i for i, w in enumerate(words) if w[:3] in first] if (x := self.weight(words[i])) > 0]
        near = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR_WORDS) : i + NEAR_WORDS + 1]) for i, _ in hits)
        masked = _MASKED.findall(low)
        hidden = [x for m in (*masked, *_SPACED.findall(low)) if (x := self.weight(m.translate(_PLAIN))) > 0]
        raw = text.encode()
        size = len(raw)
        upper = size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        letters = upper + size - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
        points = size - len(raw.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
        total = sum(x for _, x in hits)
        return [
            len(hits) / max(n, 1), math.log1p(len(hits)), total / (n + 20), max((x for _, x in hits), default=0.0), float(len({words[i] for i, _ in hits})), near / max(len(hits), 1), near / max(n, 1),
            upper / max(letters, 1), raw.count(b"!") / size, raw.count(b"?") / size, points / size, len(masked) / max(n, 1), max(hidden, default=0.0), math.log1p(n), len(_LONG_RUN.findall(low)) / max(n, 1),
        ]


@dataclass
class Trees:
    """Boosted trees of one depth, each level with one feature and threshold for each node."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            while node.size and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
    """Newton boosting of the weighted logistic loss on histograms."""
    w = w * len(w) / w.sum()
    share = min(max(float((w * y).sum() / w.sum()), 1e-4), 1 - 1e-4)
    out = Trees(math.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    # rare features are nearly always 0: their cuts come from the other values too
    cuts = [np.unique(np.concatenate([[0.0], c, np.quantile(v[v > 0], np.linspace(0, 1, bins // 2)[:-1]) if (v > 0).any() else []])) for c, v in zip(cuts, x.T, strict=True)]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
    width = max(len(c) for c in cuts) + 1
    margin = np.full(len(y), out.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p) + 1e-9
        inner = 2**depth - 1
        feature, cut, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for level in range(depth):
            start, many = 2**level - 1, 2**level
            at = node - start
            total = np.stack([np.bincount(at, v, many) for v in (g, h)])
            base, best = total[0] ** 2 / (total[1] + l2), np.full(many, 1e-6)
            split = np.full(many, width)
            for f in range(x.shape[1]):
                gl, hl = (np.bincount(at * width + binned[:, f], v, many * width).reshape(many, width).cumsum(1)[:, :-1] for v in (g, h))
                gain = gl**2 / (hl + l2) + (total[0][:, None] - gl) ** 2 / (total[1][:, None] - hl + l2) - base[:, None]
                gain[:, len(cuts[f]) :] = -1
                k = gain.argmax(1)
                better = gain[np.arange(many), k] > best
                best[better], split[better] = gain[np.arange(many), k][better], k[better]
                feature[start : start + many][better] = f
                cut[start : start + many][better] = cuts[f][k[better]]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > split[at])
        leaf_at = node - inner
        leaf = -rate * np.bincount(leaf_at, g, 2**depth) / (np.bincount(leaf_at, h, 2**depth) + l2)
        out.trees.append((feature, cut, leaf))
        margin += leaf[leaf_at]
    return out


def isotonic(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising margins and their calibrated probabilities."""
    blocks: list[list[float]] = []
    order = np.argsort(margin, kind="stable")
    for m, v, k in zip(margin[order], y[order], w[order], strict=True):
        blocks.append([m * k, v * k, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    at: np.ndarray
    value: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        margin = self.trees.margin(np.array([self.lexicon.features(t) for t in texts]).reshape(len(texts), FEATURES))
        smooth = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return np.clip(0.98 * np.interp(margin, self.at, self.value) + 0.02 * smooth, 0, 1)  # the smooth part orders what the steps leave tied


def _select(counts: list[tuple[str, float, float]], pos: float, neg: float) -> Lexicon:
    """Terms whose log odds of standing in a toxic text are surely high, the surest ones first."""
    found = []
    for t, p, n in counts:
        odds = math.log((p + 0.5) / (pos + 1)) - math.log((n + 0.5) / (neg + 1))
        sure = odds - 1.5 * math.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
        if sure > 0.5 and p >= 2:
            found.append((sure, t, odds))
    return Lexicon({t: odds for _, t, odds in sorted(found, reverse=True)[:LEXICON_ENTRIES]})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Fit on per_class rows of each label in the mean. Terms are counted and features made on the executors; the driver
    gets the sure terms, at most LEXICON_ENTRIES * 20 of them, and a row of FEATURES numbers for each sampled text.

    docs holds the rows that may be learned from. A label other than 0 and 1, or null, is not learned from; of repeated
    ids one row is learned from.
    """
    known = docs.select(F.col(id_col).alias("i")).distinct().join(labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).alias("y")), "i")
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Model(Lexicon({}), Trees(), np.array([0.0]), np.array([1.0 if pos else 0.0]))
    share = F.when(F.col("y") == 1, min(1.0, per_class / pos)).otherwise(min(1.0, per_class / neg))
    u = F.shiftrightunsigned(F.xxhash64(F.lit("tox-sample"), "i"), 11).cast("double") * (2.0**-53)
    picked = known.where(u < share)  # a bounded number of (id, label) rows
    sample = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(picked), "i").select("i", "t", F.col("y").cast("long").alias("y"), F.pmod(F.xxhash64(F.lit("fold"), "i"), F.lit(2)).alias("fold"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: tuple[Counter, ...] = (Counter(), Counter(), Counter(), Counter())
        for b in batches:
            labels, fold = b.column(2).to_pylist(), b.column(3).to_pylist()
            for at, texts in column_chunks(b.column(1), TEXT_BYTES):
                for i, t in enumerate(texts, at):
                    tally[2 * fold[i] + labels[i]].update(terms(t or ""))
        seen = sorted(set().union(*tally))
        for k in range(0, len(seen), 20_000):
            part = seen[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[t] for t in part], pa.int64()) for c in tally)], ["term", "n0", "p0", "n1", "p1"])

    counted = sample.mapInArrow(count, "term string, n0 long, p0 long, n1 long, p1 long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n0", "p0", "n1", "p1")))
    totals = {(r["fold"], r["y"]): r["count"] for r in sample.groupBy("fold", "y").count().collect()}
    n = [[totals.get((f, y), 0) for y in (0, 1)] for f in (0, 1)]
    odds = F.log((F.col("p0") + F.col("p1") + 0.5) / (n[0][1] + n[1][1] + 1)) - F.log((F.col("n0") + F.col("n1") + 0.5) / (n[0][0] + n[1][0] + 1))
    top = counted.where((F.col("p0") + F.col("p1") >= 2) & (odds > 0.5)).orderBy((F.col("p0") + F.col("p1")) * odds, "term", ascending=False).limit(LEXICON_ENTRIES * 20).collect()
    folds = [_select([(r["term"], r[f"p{f}"], r[f"n{f}"]) for r in top], n[f][1], n[f][0]) for f in (0, 1)]
    whole = _select([(r["term"], r["p0"] + r["p1"], r["n0"] + r["n1"]) for r in top], n[0][1] + n[1][1], n[0][0] + n[1][0])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, y, f = (b.column(k).to_pylist() for k in (0, 2, 3))
            x = [folds[1 - f[i]].features(t) for at, texts in column_chunks(b.column(1), TEXT_BYTES) for i, t in enumerate(texts, at)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(y, pa.int64()), pa.array(f, pa.int64()), pa.array(x, pa.list_(pa.float64()))], ["i", "y", "fold", "x"])

    rows = sample.withColumn("i", F.col("i").cast("string")).mapInArrow(measure, "i string, y long, fold long, x array<double>").collect()
    rows.sort(key=lambda r: (r["i"], r["x"]))
    x, y, f = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float), np.array([r["fold"] for r in rows])
    w = np.where(y == 1, max(1.0, pos / per_class), max(1.0, neg / per_class))
    crossed = np.zeros(len(y))
    for k in (0, 1):
        crossed[f == k] = fit_trees(x[f != k], y[f != k], w[f != k]).margin(x[f == k]) if 0 < y[f != k].sum() < (f != k).sum() else math.log((pos + 1) / (neg + 1))
    return Model(whole, fit_trees(x, y, w), *isotonic(crossed, y, w))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in column_chunks(b.column(1), TEXT_BYTES):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(model.score(texts), pa.float64())], ["doc_id", "score"])

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    return plain.mapInArrow(run, plain.withColumn("score", F.lit(0.0)).select("doc_id", "score").schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs.where(~held_out(F.col("doc_id"), 5, 0)), labels.where(~held_out(F.col("doc_id"), 5, 0)))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
