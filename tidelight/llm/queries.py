"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelight.llm import bpe, hamming, importance, jaccard, langid, leaks, licenses, lines, mixing, oracles, quality, rtree, tokens, urls
from tidelight.session import cut, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL it must equal."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), urls.given_rules(spark))


@query()
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "rate")


@query(oracles.JACCARD)
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"), size=4, percent=85)


@query(oracles.LINES)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


@query()
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predicted(docs, langid.fit(docs))


@query()
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(licenses.oracle())
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = "/opt/tokenizers") -> DataFrame:
    """Load all documents, take later copies out again, and count other languages than English anew with the multilingual version; the load is sent twice."""
    docs = table(spark, sf_dir, "documents")
    old = cut(tokens.counted(docs, f"{tokenizers}/byte_bpe_50k.tiktoken", "byte_bpe_50k"), "tokens")
    gone = cut(tokens.later_copies(old), "tokens")
    first = old.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))
    stays = cut(old.join(first, ["doc_id", "text_hash"], "left_semi").filter("lang is null or lang <> 'en'"), "tokens")
    # counted before the join, so that no texts are shuffled
    every = tokens.counted(docs.filter("lang is null or lang <> 'en'"), f"{tokenizers}/byte_bpe_multi_50k.tiktoken", "byte_bpe_multi_50k")
    anew = cut(every, "tokens").join(stays.select("doc_id", "text_hash").distinct(), ["doc_id", "text_hash"], "left_semi")
    rollup = tokens.Rollup(spark, f"{shared_folder(spark)}/tidelight/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", lambda: tokens.inserts(old))
    rollup.commit("load", lambda: tokens.inserts(old))
    rollup.commit("copies", lambda: tokens.deletes(gone))
    rollup.commit("other-languages", lambda: tokens.revisions(stays, anew))
    return rollup.totals()


@query(oracles.HAMMING)
def op9_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    base = cut(hamming.codes(vectors), "hamming")
    return hamming.nearest(base, base.filter("id % 50 = 0"), k=10)


@query()
def op11_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``path`` is a rank file; by default that of the installed public tokenizers."""
    if path is None:
        import public_tokenizers

        path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    shared = bpe.vocabulary(spark, path)
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), shared, pattern or tokens.PATTERN), shared)
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query(oracles.HARD_NEGATIVES)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rtree.points(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")))
    return rtree.mine(rows, rows.filter("id % 50 = 0"))


@query()
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
