"""Op 8. Language identification by error-correcting output codes.

Every language has a binary codeword. For each bit a logistic model on hashed byte trigrams of the lower-cased text
tells on which side the text falls; the codeword with the least logistic loss against the margins wins, weighted by the
margins' size. A text whose two nearest codewords are close is flagged as ambiguous.

The models are fitted on a bounded sample of labelled rows: PER_LANGUAGE rows of each language in the mean, and SAMPLE_ROWS
of all, chosen by a hash of the id. Their features are made on the executors; the driver gets at most 4 * FEATURES bytes a
row, whatever the texts' lengths. Scoring reads whole texts.

Defined cases: a text that is null or has no letter is `und` with score 0; with no labelled row at all every text is
`und`; with one language every other text gets it; repeated rows get the same answer; an empty table gives an empty
result; columns besides id, text and (for fitting) language are left out; identify() takes all others along, but for
those named _lang_..., which it replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import table
from leafmill.llm.passages import column_chunks

UNDETERMINED = "und"
#: Sampled rows of each language in the mean, and of all languages together.
PER_LANGUAGE, SAMPLE_ROWS = 800, 6000
FEATURES = 1 << 13
AMBIGUOUS_GAP = 0.15
#: Bytes of text that are taken out of a batch at once.
TEXT_BYTES = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
#: Lower-cases ASCII letters; other ASCII becomes a space; bytes of longer characters stay.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def lettered(text: bytes | None) -> bool:
    """Whether a character of Unicode's letter categories stands in the text; numerals such as ½ are none."""
    return text is not None and any(m[0].isalpha() for m in _LETTER.finditer(text.decode("utf-8", "replace")))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and 1: the exhaustive code for up to 6 languages, else the widest of 200 random ones."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        return np.array([[1 if (bit >> i) & 1 else -1 for bit in range(1, 2 ** (n - 1))] for i in range(n - 1)] + [[-1] * (2 ** (n - 1) - 1)], float)
    rng, best, width = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, 15 * int(np.ceil(np.log2(n)))))
        near = int(((code[:, None] != code[None]).sum(2) + np.eye(n, dtype=int) * 10**6).min())
        if near > width and (np.abs(code.sum(0)) < n).all():
            best, width = code, near
    return best


def features(texts: list[bytes]) -> np.ndarray:
    """Square roots of hashed trigram counts, of unit length."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, t in enumerate(texts):
        b = _FOLD[np.frombuffer(b" " + t + b" ", np.uint8)].astype(np.uint32)
        if len(b) > 2:
            h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
            row = np.sqrt(np.bincount(h >> np.uint32(19), minlength=FEATURES))
            out[i] = row / max(np.sqrt((row**2).sum()), 1e-9)
    return out


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (FEATURES + 1) x bits

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is ambiguous."""
        known = [bool(self.languages) and lettered(t) for t in texts]
        langs, score, vague = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for lo in range(0, len(texts), 256):
            at = [i for i in range(lo, min(lo + 256, len(texts))) if known[i]]
            if not at:
                continue
            margins = features([texts[i] for i in at]) @ self.weights[:-1] + self.weights[-1]
            loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).mean(2)
            p = np.exp(-(loss - loss.min(1, keepdims=True)) * self.code.shape[1])
            p /= p.sum(1, keepdims=True)
            best = loss.argmin(1)
            second = np.sort(loss, 1)[:, 1] if loss.shape[1] > 1 else loss[:, 0] + 1
            for j, i in enumerate(at):
                langs[i], score[i], vague[i] = self.languages[best[j]], p[j, best[j]], second[j] - loss[j, best[j]] < AMBIGUOUS_GAP
        return langs, score, vague


def fit_codes(x: np.ndarray, langs: list[str], steps: int = 150, l2: float = 1e-5) -> Model:
    """One logistic model for each bit, by accelerated gradient steps; languages weigh the same."""
    names = sorted(set(langs))
    code = codewords(len(names))
    weights = np.zeros((FEATURES + 1, code.shape[1]), np.float32)
    if not names:
        return Model(names, code, weights)
    y = np.array([names.index(x) for x in langs])
    target = code[y].astype(np.float32)
    share = (1.0 / np.bincount(y)[y] / len(names)).astype(np.float32)[:, None]
    ahead, rate, last = weights.copy(), np.float32(6.0), weights
    for k in range(steps):
        margin = x @ ahead[:-1] + ahead[-1]
        g = -share * target / (1 + np.exp(np.clip(target * margin, -30, 30)))
        grad = np.vstack([x.T @ g + l2 * ahead[:-1], g.sum(0, keepdims=True)])
        weights = ahead - rate * grad
        ahead = weights + np.float32(k / (k + 3)) * (weights - last)
        last = weights
    return Model(names, code, last)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of df's labelled rows: per_language rows of each language in the mean.

    A row is in the sample if a hash of its id falls below its language's share, so the sample neither depends on the
    partitioning nor needs a sort.
    """
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = labelled.groupBy(F.col(lang_col).alias("k")).count().collect()
    per_language = min(per_language, SAMPLE_ROWS // max(1, len(sizes)))
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col(lang_col) == r["k"], F.lit(min(1.0, per_language / r["count"]))).otherwise(share)
    u = F.shiftrightunsigned(F.xxhash64(F.lit("lang-sample"), F.col(id_col)), 11).cast("double") * (2.0**-53)
    picked = labelled.where(u < share).select(F.col(text_col).cast("binary").alias("t"), F.col(lang_col).alias("k"), F.xxhash64(id_col).alias("h"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in column_chunks(b.column(0), TEXT_BYTES):
                for lo in range(0, len(texts), 256):
                    x = features(texts[lo : lo + 256])
                    cells = [np.flatnonzero(row).astype(np.uint16) for row in x]
                    yield pa.RecordBatch.from_arrays([*(b.column(k).slice(at + lo, len(x)) for k in (1, 2)), pa.array([c.tobytes() for c in cells], pa.binary()), pa.array([row[c].astype(np.float16).tobytes() for row, c in zip(x, cells, strict=True)], pa.binary())], ["k", "h", "at", "v"])

    rows = picked.mapInArrow(measure, "k string, h long, at binary, v binary").collect()
    rows.sort(key=lambda r: (r["h"], r["k"], r["at"], r["v"]))
    x = np.zeros((len(rows), FEATURES), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["v"], np.float16)
    return fit_codes(x, [r["k"] for r in rows])


def identify(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns keep (all by default) with _lang_pred, _lang_score, _lang_ambiguous and _lang_lettered (whether the text has a letter)."""
    keep = [c for c in df.columns if not c.startswith("_lang_")] if keep is None else keep
    plain = df.select(*keep, F.col(text_col).cast("binary").alias("_lang_text"))
    schema = plain.drop("_lang_text").withColumns({"_lang_pred": F.lit(""), "_lang_score": F.lit(0.0), "_lang_ambiguous": F.lit(True), "_lang_lettered": F.lit(True)}).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in column_chunks(b.column(b.num_columns - 1), TEXT_BYTES):
                langs, scores, vague = model.predict(texts)
                kept = [c.slice(at, len(texts)) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(vague, pa.bool_()), pa.array([lettered(t) for t in texts], pa.bool_())], [*b.schema.names[:-1], "_lang_pred", "_lang_score", "_lang_ambiguous", "_lang_lettered"])

    return plain.mapInArrow(score, schema)


def held_out(id_col: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text, mod `mod`, is `rest`; a null id counts as the empty string."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod == rest


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    out = identify(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"), F.col("_lang_ambiguous").alias("ambiguous"))
