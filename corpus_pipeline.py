"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return the
columns of documents. run() writes each stage's result to the shared scratch folder and reads it again.

Cases: every stage takes null and empty texts. Language ID drops texts without a letter and those whose language cannot be
told, and sets lang to the predicted language. Among near duplicates (five-word
shingles, Jaccard 0.8 or more, linked through others too) the document with the least id stays, and of rows that repeat
its id and text one; rows with a null id are no known copies of each other and all stay. Decontamination drops documents
that share a ten-word window, or a whole shorter item, with the benchmark; of rows that share an id, null too, only those with
such a text. Mixing repeats or leaves out documents by its draw.
Sharding returns a row for each copy, without the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, jaccard, language, mixing, sharding
from leafmill.llm.common import materialise, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with the language their text is in as lang.

    Those without a letter go, and those whose two nearest codewords nearly tie, unless their label says the same as the nearest. What
    stays takes its predicted language over its label (which may be missing or wrong); without any label to learn from labels stay.
    """
    model = language.fit(docs)
    found = language.identify(docs, model)
    told = found.where(F.col("_lang_lettered") & (~F.col("_lang_ambiguous") | F.col("lang").eqNullSafe(F.col("_lang_pred"))))
    lang = F.col("_lang_pred") if model.languages else F.col("lang")
    return told.withColumn("lang", lang).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates, once where its row repeats; rows with a null id stay."""
    parts = jaccard.near_components(docs, shingle=5, percent=80)
    gone = parts.where(F.col("component_id") != F.col("doc_id")).select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = materialise(again, "again")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").unionByName(once).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark. A document is told by its id, null or not, and its text."""
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"))
    gone = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_text"))
    same = docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_text"])
    return docs.join(gone, same, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate, in shuffled order."""
    return mixing.mix(docs).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs, n_shards=8)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The learned classifier of the first stage has no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
