"""The registered queries of this subpackage, over the given tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm import (
    bpe,
    exact_dedup,
    jaccard_join,
    licenses,
    main_text,
    mixing,
    packing,
    reputation,
    runs,
    token_files,
    topk,
    toxicity,
    variants,
)
from patronage.llm import queries_sql as sql
from patronage.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

# The rules that the URL query applies.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
CATEGORIES = ("low_quality", "toxic")


def category_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The labels as toxicity categories: (doc_id, low_quality, toxic)."""
    labels = table(spark, folder, "labels")
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op1_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the same id are the outcomes of pages; a page is bad if it is of low quality or toxic."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = table(spark, folder, "labels").select(
        F.col("doc_id").alias("page_id"), F.coalesce(bad, F.lit(False)).alias("bad")
    )
    found = reputation.filter_urls(table(spark, folder, "pages"), outcomes, URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op2_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(table(spark, folder, "pages"))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op4_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.write_and_read(table(spark, folder, "documents"))


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.link(table(spark, folder, "documents"))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.detect(docs, toxicity.fit(docs, category_labels(spark, folder), CATEGORIES), "toxic")


def op10_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"))


def op11_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.detect_runs(table(spark, folder, "documents"), plant=True)


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(table(spark, folder, "documents"), damage=variants.DAMAGE)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_url_reputation,
        op2_main_text,
        op3_license_scan,
        op4_exact_top_k,
        op5_token_files,
        op6_jaccard_join,
        op7_exact_dedup,
        op8_best_fit_packing,
        op9_toxicity,
        op10_bpe_round_trip,
        op11_source_mix,
        op12_periodic_runs,
        op13_spelling_variants,
    )
}

SQL: dict[str, str] = {
    "op1_url_reputation": sql.OP1,
    "op4_exact_top_k": sql.OP4,
    "op6_jaccard_join": sql.OP6,
    "op7_exact_dedup": sql.OP7,
    "op13_spelling_variants": sql.OP13,
}
