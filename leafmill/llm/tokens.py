"""Op 7. Token counts with a digest cache.

A text's key is the digest of the tokenizer's version and of the normalised text. Keys are joined to the counts stored
in the cache table; only distinct misses are encoded, and their counts are appended to it. Normalising must not change
a count: "blank" merges runs of ASCII white space and trims them, which holds for tokenizers that drop white space;
"none" takes texts as they are.

Pieces between ASCII white space are encoded once for each worker while they stay in a bounded memo ("blank" only: there no
token crosses white space, so a text's count is the sum over its pieces). Where the tokenizer's rules also keep marks apart
from letters and digits and fold case, a piece is counted as its stem and its last marks, and stems are encoded many at once.

Defined cases: a null text counts as empty (0 tokens, 0 bytes); a null id is kept; rows that repeat an id or a text each
get a row; texts are encoded whole, without truncation; an empty table gives an empty result; columns besides id and
text are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import HUB_LEAST, HUB_SHARE, materialise, scratch_root, table
from leafmill.llm.passages import column_chunks

MEMO_PIECES = 300_000
MEMO_PIECE_BYTES = 48
#: Bytes of text that are taken out of a batch at once.
TEXT_BYTES = 4 << 20


#: Marks at the end of a piece, which is counted as two if an ASCII letter or digit, or a letter of these two bytes, stands before them.
MARKS, LATIN_LETTER = b".,;:!?#$%&*", re.compile(rb"\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]\Z")
#: Pieces of letters only, which stay one word each when they are joined by blanks.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Pieces that are joined for one call of the tokenizer.
JOINED = 256
#: Rules under which the above holds: no token crosses the border between letters, digits and marks, and case makes no difference.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def splits_at_marks(rules: dict) -> bool:
    """Whether a tokenizer (its JSON) has these rules, marks the ends of words, and added tokens all begin with "<|"."""
    pre = rules.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers") or [{}]
    bytes_only = [x.get("type") == "ByteLevel" and not x.get("use_regex") and not x.get("add_prefix_space") for x in steps[1:]] == [True]
    added = all(x["content"].startswith("<|") for x in rules.get("added_tokens") or [])
    return rules.get("normalizer") == _NORMALIZER and steps[0] == _SPLIT and bytes_only and added and rules["model"].get("end_of_word_suffix") == "</w>"


class Memo:
    """Counts of pieces, remembered in two generations of bounded size."""

    def __init__(self, count: Callable[[list[bytes]], list[int]]) -> None:
        self.count, self.young, self.old, self.long = count, {}, {}, []

    def of(self, pieces: set[bytes]) -> dict[bytes, int]:
        """A table that holds the counts of these pieces, until the next call."""
        for w in self.long:
            self.young.pop(w, None)
        new = pieces.difference(self.young)
        found = {w: self.old[w] for w in new if w in self.old}
        todo = [w for w in new if w not in found]
        found.update(zip(todo, self.count(todo), strict=True))
        if len(self.young) + len(found) > MEMO_PIECES:
            known = {w: self.young[w] for w in pieces if w in self.young} | found
            self.old = self.young
            self.young, self.long = {w: n for w, n in known.items() if len(w) <= MEMO_PIECE_BYTES}, []
            return known
        self.young.update(found)
        self.long = [w for w in todo if len(w) > MEMO_PIECE_BYTES]
        return self.young


class PieceCounter:
    """Token counts of texts, whole or by pieces between blanks, which are remembered."""

    def __init__(self, tokenizer_path: str, by_piece: bool) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.by_piece, self.ends = by_piece, None
        if tokenizer_path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(tokenizer_path)
            self.encode = lambda texts: [len(x.ids) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
            self.ids = lambda texts: [np.array(x.ids, np.int64) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
            if by_piece and splits_at_marks(json.loads(tok.to_str())):
                vocab = tok.get_vocab()
                self.ends = np.zeros(max(vocab.values()) + 1, bool)
                self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.stems = Memo(self._stems)
        self.pieces = Memo(self._plain if self.ends is None else self._pieces)

    def _plain(self, pieces: list[bytes]) -> list[int]:
        return [n for i in range(0, len(pieces), 4096) for n in self.encode([w.decode() for w in pieces[i : i + 4096]])]

    def _stems(self, stems: list[bytes]) -> list[int]:
        """Stems of letters are encoded JOINED at once: each is one word, and the last token of a word, no other one, says so."""
        out, words, others = [0] * len(stems), [], []
        for i, w in enumerate(map(bytes.decode, stems)):
            (words if LETTERS.fullmatch(w) else others).append((i, w))
        for lo in range(0, len(words), 16 * JOINED):
            parts = [words[k : k + JOINED] for k in range(lo, min(len(words), lo + 16 * JOINED), JOINED)]
            for part, ids in zip(parts, self.ids([" ".join(w for _, w in part) for part in parts]), strict=True):
                last = np.flatnonzero(self.ends[ids])
                if len(last) != len(part) or last[-1] != len(ids) - 1:  # a letter that the vocabulary lacks
                    others += part
                    continue
                for (i, _), n in zip(part, np.diff(last, prepend=-1).tolist(), strict=True):
                    out[i] = n
        for (i, _), n in zip(others, self._plain([stems[i] for i, _ in others]), strict=True):
            out[i] = n
        return out

    def _pieces(self, pieces: list[bytes]) -> list[int]:
        """A piece as its stem, in lower case if it is ASCII (else case can decide what combines), and its last marks."""
        stems, marks = [], []
        for w in pieces:
            stem = w.rstrip(MARKS)
            if b"<|" in w or (stem is not w and not stem[-1:].isalnum() and not LATIN_LETTER.match(stem[-2:])):
                stem = w
            marks.append(w[len(stem) :])
            stems.append(stem.lower() if stem.isascii() and b"<|" not in stem else stem)
        known = self.stems.of({*stems, *marks})
        return list(map(add, map(known.__getitem__, stems), map(known.__getitem__, marks)))

    def counts(self, texts: list[bytes]) -> list[int]:
        if not self.by_piece:
            return self.encode([t.decode() for t in texts])
        split = [t.split() for t in texts]
        known = self.pieces.of(set().union(*split))
        return [sum(map(known.__getitem__, words)) for words in split]


@lru_cache(maxsize=1)
def piece_counter(tokenizer_path: str, by_piece: bool, version: str) -> PieceCounter:
    """The counter of a Python worker, which keeps its memo from task to task; version: of the tokenizer's file."""
    return PieceCounter(tokenizer_path, by_piece)


def tokenizer_version(path: str, normalise: str) -> str:
    """Digest of the tokenizer's file and of the way texts are normalised."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + normalise.encode()).hexdigest()


def normalised(text, normalise: str):
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, "[\\x09-\\x0D\\x20]+", " ")) if normalise == "blank" else text


def _read_cache(spark: SparkSession, cache: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("digest binary, n_tokens long").parquet(cache)


def store_counts(keyed: DataFrame, tokenizer_path: str, cache: str, by_piece: bool) -> None:
    """Encodes the texts of (digest, _text) whose digests the cache lacks, each once, and appends their counts.

    Texts are grouped by digest, partial minimum first, so that a hot text is shuffled once a task and encoded once. A job that dies half
    way leaves the cache as it was or with whole files; a count that is stored twice is the same number, and the lookup takes one.
    """
    distinct = keyed.groupBy("digest").agg(F.min("_text").alias("_text"))
    stored = _read_cache(keyed.sparkSession, cache)
    version = tokenizer_version(tokenizer_path, "")
    misses = distinct if stored is None else distinct.join(stored, "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counter = piece_counter(tokenizer_path, by_piece, version)
            for at, texts in column_chunks(b.column(1), TEXT_BYTES):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(counter.counts(texts), pa.int64())], ["digest", "n_tokens"])

    misses.select("digest", F.col("_text").cast("binary").alias("t")).mapInArrow(encode, "digest binary, n_tokens long").write.mode("append").parquet(cache)


def count_tokens(df: DataFrame, tokenizer_path: str, cache: str, normalise: str = "none", id_col: str = "doc_id", text_col: str = "text", batches: int = 1) -> DataFrame:
    """doc_id, n_bytes, digest, n_tokens for every row of df; counts that the cache lacks are appended to it.

    df is taken in batches by a hash of the id, one after the other: what a batch repeats of earlier ones is found in the cache, not
    encoded. Counts are looked up once, after the last batch.
    """
    spark = df.sparkSession
    version = tokenizer_version(tokenizer_path, normalise)
    text = normalised(F.col(text_col), normalise)
    keyed = df.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(F.concat(F.lit(version), text), 256)).alias("digest"),
        text.alias("_text"),
        F.pmod(F.xxhash64(F.lit("batch"), F.col(id_col)), F.lit(batches)).alias("_batch"),
    )
    rows = materialise(keyed.drop("_text", "_batch"), "keyed")
    for k in range(batches):
        store_counts(keyed.where(F.col("_batch") == k) if batches > 1 else keyed, tokenizer_path, cache, normalise == "blank")
    counts = spark.read.schema("digest binary, n_tokens long").parquet(cache).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    copies = rows.groupBy("digest").count()
    often = max(HUB_LEAST, rows.count() // HUB_SHARE)
    hot = materialise(copies.where(F.col("count") > often).join(counts, "digest").select("digest", "n_tokens"), "hot")  # HUB_SHARE rows at most
    if hot.isEmpty():
        out = rows.join(counts, "digest", "left")
    else:  # rows of a very frequent text don't meet in one task
        hot = F.broadcast(hot)
        out = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(counts, "digest", "left"))
    return out.select("doc_id", "n_bytes", "digest", "n_tokens")


#: Names a folder in which counts are kept for later runs; where it is unset, a run has its own cache.
CACHE_CONF = "leafmill.tokens.cache"
#: Tokenizers, by file name, that drop white space, so that texts may be normalised; others take texts as they are.
NORMALISE = {"word_bpe_49k.json": "blank"}
#: Batches of the registered query.
BATCHES = 2


def op7_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, limit: int = 2048) -> DataFrame:
    import public_tokenizers

    path = str(tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    cache = spark.conf.get(CACHE_CONF, None) or f"{scratch_root(spark)}/token-cache-{uuid.uuid4().hex}"
    counts = count_tokens(table(spark, sf_dir, "documents"), path, cache, NORMALISE.get(path.rsplit("/", 1)[-1], "none"), batches=BATCHES)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
