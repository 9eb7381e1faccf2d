"""One named query for each operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behavior_spark.llm import (
    collocations,
    language_id,
    line_dedup,
    lm_scoring,
    mixing,
    nearest,
    oracle,
    periodic_runs,
    quality_gam,
    quality_rules,
    sentencepiece_codec,
    simhash_dedup,
    substring_dedup,
    token_files,
)
from behavior_spark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is on this machine and the executors; tasks open it themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_mix_curriculum")
def mix_curriculum(spark: SparkSession, folder: str) -> DataFrame:
    placed = mixing.scheduled(table(spark, folder, "documents"))
    return placed.select("doc_id", "size", "source_size", "target", "taken", "source", "offset", "first_position", "last_position", "first_rank")


@query("op2_language_fusion")
def language_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """All pages, with markup and address, and all documents, with their source as host."""
    docs, pages = table(spark, folder, "documents"), table(spark, folder, "pages")
    named = language_id.fused(language_id.rows_of(pages, docs), language_id.train(docs))
    is_page = F.col("kind") == "page"
    ids = F.when(~is_page, F.col("id")).alias("doc_id"), F.when(is_page, F.col("id")).alias("page_id")
    return named.select(*ids, "language", "confidence", "text_language", "declared", "host")


@query("op3_line_alignment")
def line_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.report(table(spark, folder, "documents"), line_dedup.Alignment(farther=True)).drop("text")


@query("op4_simhash_classes")
def simhash_classes(spark: SparkSession, folder: str) -> DataFrame:
    named = simhash_dedup.classes(table(spark, folder, "documents"))
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_token_files")
def tokens(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.read(token_files.write(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json")))


@query("op6_pseudo_likelihood")
def pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score(table(spark, folder, "documents"))


@query("op7_quality_cascade", oracle.QUALITY)
def quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_rules.judge(docs, quality_rules.plan(docs)).drop("rejected_by")


@query("op8_recompression", oracle.SUBSTRINGS)
def recompression(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.removed(table(spark, folder, "documents"))


@query("op9_cross_polytope")
def cross_polytope(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.search(table(spark, folder, "embeddings"), F.col("id") % 50 == 0, 5)


@query("op10_sentencepiece")
def sentencepiece_ids(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op11_periodic_runs")
def periodic(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.found(periodic_runs.planted(table(spark, folder, "documents").select("doc_id", "text")))
    best = periodic_runs.strongest(F.col("runs"))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_quality_gam")
def gam(spark: SparkSession, folder: str) -> DataFrame:
    return quality_gam.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_collocations", oracle.COLLOCATIONS)
def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))
