"""The package's queries: each applies an operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact, fingerprints, html, language, mixing, pieces, simhash, sql, tokens, topk, warc
from .common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out()))
    return language.predict(docs, model, language.held_out().alias("held_out")).select("doc_id", "held_out", "lang_pred", "score", "coverage")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), "n_chars", "n_pieces", "pieces_sha256", "alternatives_sha256", "n_paths", "best_score", "scores", "decoded_sha256", "decodes")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_exact_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.removals(table(spark, sf_dir, "documents"), length=400)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    warc.write(table(spark, sf_dir, "pages"), folder)
    done = warc.resolve(warc.read(spark, folder))
    return done.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_fingerprints, op2_token_counts, op3_language, op4_main_text, op5_top_k, op6_pieces, op7_near_duplicates, op8_exact_substrings, op9_mixing, op10_warc)
}
SQL = {"op5_top_k": sql.OP5, "op9_mixing": sql.OP9, "op10_warc": sql.OP10}
