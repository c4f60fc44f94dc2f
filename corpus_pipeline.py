"""A training corpus from raw documents: language ID, near dedup, substring dedup, mixing, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import exact, language, mixing, pieces, simhash
from loomgraph.llm.common import aside, gone_at_exit, remove, shared_dir

#: The least part of a text's n-grams that its language's filter must know, and characters below which that says nothing; bytes of a repeated passage (50 words).
COVERAGE, SHORT, PASSAGE = 0.1, 20, 200


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, with it as their lang; texts without a letter (null and empty ones too) go, and those of SHORT characters or more in none of the languages.

    Repeated rows each stay; where no row has a lang, nothing can be learned and no row stays.
    """
    docs, named = aside(docs, "doc_id", "text", "lang")
    model = language.fit(docs)
    others = [c for c in docs.columns if c not in ("text", "doc_id", "lang")]
    found = language.predict(docs, model, *others, keep_text=True)
    kept = found.where((F.col("lang_pred") != "und") & ((F.col("coverage") >= COVERAGE) | (F.length("text") < SHORT)))
    return named(kept.withColumnRenamed("lang_pred", "lang"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least doc_id (null last), of each group of near copies, also where rows repeat a doc_id or have none; null, empty and wordless texts are one group."""
    return simhash.one_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of PASSAGE bytes that occur elsewhere; documents of which nothing is left go, null and empty texts stay as they are, repeated rows of that length lose all."""
    return exact.without_repeats(docs, PASSAGE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number: not at all, once or twice.

    Rows that share a doc_id (or have none) are taken equally often; wordless texts, which the mix has no words of, go.
    """
    docs, named = aside(docs, "doc_id", "text", "source")
    parts = mixing.takes(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).where("taken > 0")
    times = parts.select(F.col("doc_id").alias("taken_id"), F.round(F.col("taken") / F.col("size")).cast("int").alias("times")).where("times > 0")
    joined = docs.join(times, F.col("doc_id").eqNullSafe(F.col("taken_id")))
    return named(joined.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces, those of its next best segmentations, the scores of all of them, and whether decoding each gives its text back."""
    return pieces.encoded(docs, "n_chars", "n_pieces", "pieces", "alternatives", "scores", "decodes")


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", substring_dedup), ("mixing", mix), ("sentencepiece", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    gone_at_exit(spark, base)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if k:
            remove(spark, f"{base}/{STAGES[k - 1][0]}")
    return docs
