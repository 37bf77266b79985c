import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leafmill.llm import registry, tokens

WORD = str(public_tokenizers.path("word_bpe_49k.json"))


def test_query_equals_encoding(spark, sf, doc_rows):
    tok = Tokenizer.from_file(WORD)
    got = {r["doc_id"]: tuple(r)[1:] for r in registry.queries()["op7_token_counts"](spark, sf).collect()}
    for i, t in doc_rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048)


TRICKY = ["a<|endoftext|>b <|startoftext|>", "é ́x á", "x\x1cy\x85z w v", "don't  STOP\t\n it's 12345", "ΑΣ ΣΑ", "İstanbul ǅ", "", "   ", "\u0000"]


@pytest.mark.parametrize(("name", "how"), [("word_bpe_49k.json", "blank"), ("byte_bpe_50k.json", "none"), ("piece_bpe_32k.model", "none")])
def test_tricky_texts(spark, tmp_path, odd, name, how):
    path = str(public_tokenizers.path(name))
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string"))
    rows = df.collect()
    got = tokens.count_tokens(df, path, f"file://{tmp_path}/cache", how).collect()
    if path.endswith(".json"):
        tok = Tokenizer.from_file(path)
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    key = lambda x: (str(x[0]), x[1], x[2])
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=key) == sorted(((r["doc_id"], len((r["text"] or "").encode()), count(r["text"] or "")) for r in rows), key=key)


def test_cache_holds_each_digest_once(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    df = spark.createDataFrame([(1, "a b"), (2, " a  b "), (3, "c")], "doc_id long, text string")
    tokens.count_tokens(df, WORD, cache, "blank").collect()
    assert spark.read.parquet(cache).count() == 2
    more = df.unionByName(spark.createDataFrame([(4, "d e f")], "doc_id long, text string"))
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(more, WORD, cache, "blank").collect()} == {1: 2, 2: 2, 3: 1, 4: 3}
    assert spark.read.parquet(cache).count() == 3
    assert tokens.tokenizer_version(WORD, "blank") != tokens.tokenizer_version(WORD, "none")


def test_memo_generations(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 5)
    c = tokens.PieceCounter(WORD, True)
    tok = Tokenizer.from_file(WORD)
    for _ in range(3):
        texts = ["one two three", "four five six seven eight", "nine two", "x" * 100]
        assert c.counts([t.encode() for t in texts]) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


ATOMS = ["a", "B", "e", "s", "word", "Word", "STOP", "é", "É", "ß", "ÿ", "À", "×", "÷", "ª", "ñ", "7", "42", "²", "ٳ", ".", ",", "...", "!?", "$$$", "###", "&", "*", "%", "'", "'s", "'LL", "-", "“", "”", "—", "\u0301", "\u0331", "\u0338", "H", "İ", "Σ", "ς", "K", "ﬁ", "漢", "각", "\u1100", "\u200d", "\x00", "\x85", "\u2028", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>.", "<|", "|>", "<", "😀", "ǅ"]


@pytest.mark.parametrize("pieces", [40, 300_000])
def test_stems_and_marks_count_as_whole_pieces(pieces, monkeypatch):
    """Pieces of everything that could combine, fold or be split otherwise with what is next to it."""
    monkeypatch.setattr(tokens, "MEMO_PIECES", pieces)
    tok, c, r = Tokenizer.from_file(WORD), tokens.PieceCounter(WORD, True), random.Random(5)
    assert c.ends is not None
    for _ in range(20):
        texts = [" ".join("".join(r.choice(ATOMS) for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 60))) for _ in range(40)]
        assert c.counts([t.encode() for t in texts]) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_a_word_is_encoded_once_whatever_its_case_and_marks():
    c, asked = tokens.PieceCounter(WORD, True), []
    encode, ids = c.encode, c.ids
    c.encode = lambda texts: asked.extend(texts) or encode(texts)
    c.ids = lambda texts: asked.extend(w for t in texts for w in t.split()) or ids(texts)
    words = [f"{w}{m}" for w in ("Karvonel", "karvonel", "KARVONEL", "strean") for m in ("", ".", ",", "!?", "$$$")]
    want = [len(x.ids) for x in Tokenizer.from_file(WORD).encode_batch(words, add_special_tokens=False)]
    assert c.counts([w.encode() for w in words]) == want
    assert sorted(x for x in asked if x) == sorted(["karvonel", "strean", ".", ",", "!?", "$$$"])


def test_only_known_rules_split_at_marks(tmp_path):
    rules = json.loads(Tokenizer.from_file(WORD).to_str())
    assert tokens.splits_at_marks(rules)
    assert not tokens.splits_at_marks(json.loads(Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))).to_str()))
    assert not tokens.splits_at_marks(rules | {"normalizer": None})
    assert not tokens.splits_at_marks(rules | {"pre_tokenizer": None})
    assert not tokens.splits_at_marks(rules | {"added_tokens": [{"content": "a."}]})


def test_a_worker_keeps_its_memo_from_task_to_task():
    version = tokens.tokenizer_version(WORD, "")
    assert tokens.piece_counter(WORD, True, version) is tokens.piece_counter(WORD, True, version)
    assert tokens.piece_counter(WORD, True, version) is not tokens.piece_counter(WORD, True, "other")


def test_long_pieces_are_not_remembered():
    c = tokens.PieceCounter(WORD, True)
    for _ in range(2):
        assert c.counts([b"x" * 1000 + b"! a"]) == [len(Tokenizer.from_file(WORD).encode("x" * 1000 + "! a", add_special_tokens=False).ids)]
    c.counts([b"b"])
    assert set(c.pieces.young) == {b"a", b"b"}


def test_empty(spark, tmp_path, empty):
    assert tokens.count_tokens(empty, WORD, f"file://{tmp_path}/cache", "blank").count() == 0


def test_query_with_a_warm_cache(spark, sf, tmp_path, monkeypatch):
    """With a cache that holds a part of the digests only the others are encoded, and with all of them none."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cache = f"file://{tmp_path}/cache"
    stored = lambda: spark.read.parquet(cache).count()
    tokens.count_tokens(docs.where("doc_id % 3 = 0"), WORD, cache, "blank").count()
    part = stored()
    spark.conf.set(tokens.CACHE_CONF, cache)
    try:
        want = None
        for _ in range(2):
            monkeypatch.setattr(tokens, "HUB_LEAST", 0)  # second run: with texts that count as frequent
            got = sorted(map(tuple, registry.queries()["op7_token_counts"](spark, sf).collect()))
            want = want or got
            assert got == want
            assert 0 < part < stored() == docs.select("text").distinct().count()
    finally:
        spark.conf.unset(tokens.CACHE_CONF)
    assert got == sorted(map(tuple, registry.queries()["op7_token_counts"](spark, sf).collect()))


def test_a_batch_finds_the_counts_of_earlier_ones(spark, sf, tmp_path, monkeypatch):
    """Copies in a later batch are not encoded again; every batch adds only what no earlier one held."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    every, seen = docs.unionByName(docs.withColumn("doc_id", docs["doc_id"] + 10_000)), []
    one = tokens.store_counts

    def stored(keyed, path, cache, by_piece):
        one(keyed, path, cache, by_piece)
        seen.append((spark.read.parquet(cache).count(), keyed.select("digest").distinct().count()))

    monkeypatch.setattr(tokens, "store_counts", stored)
    got = tokens.count_tokens(every, WORD, f"file://{tmp_path}/cache", "blank", batches=2)
    assert got.where("n_tokens is not null").count() == every.count()
    (first, texts), (both, later) = seen
    assert first == texts and both == docs.select("text").distinct().count() and both - first < later


def test_other_tokenizers_take_texts_as_they_are(spark, sf, doc_rows):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tok = Tokenizer.from_file(path)
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.op7_token_counts(spark, sf, tokenizer=path).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in doc_rows}
