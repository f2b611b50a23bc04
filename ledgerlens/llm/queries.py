"""Registered queries of the training-data operators: name -> (build, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (
    collocations, hilbert_ann, language_id, license_scan, merkle_manifest, mixing, piece_sampling, quality, simhash_dedup,
    token_planes, topk_inner_product, url_reputation, warc)
from ledgerlens.llm._util import table


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the rules, else by its host's reputation from the labelled texts that pages carry."""
    pages = table(spark, sf_dir, "pages")
    outcomes = url_reputation.outcomes_by_text(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return url_reputation.judge_pages(pages, outcomes)


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op3_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest inner products of every 100th vector."""
    return topk_inner_product.top_inner_products(_vectors(spark, sf_dir), F.col("vec_id") % 100 == 0)


def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, decoded again and compared."""
    return piece_sampling.encode_documents(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates found in every document."""
    return license_scan.find_licenses(table(spark, sf_dir, "documents"))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back through the index."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents (4-word shingles, 4 bits)."""
    return simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))


def op10_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found for every 50th vector."""
    return hilbert_ann.nearest(_vectors(spark, sf_dir), F.col("vec_id") % 50 == 0)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, refolded from the tampered texts."""
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as files of id planes and read back."""
    return token_planes.token_round_trip(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_url_reputation": (op1_url_reputation, url_reputation.SQL),
    "op2_pareto_mix": (op2_pareto_mix, mixing.SQL),
    "op3_co_training": (op3_co_training, None),
    "op4_language_id": (op4_language_id, None),
    "op5_exact_top_k": (op5_exact_top_k, topk_inner_product.SQL),
    "op6_piece_sampling": (op6_piece_sampling, None),
    "op7_license_scan": (op7_license_scan, None),
    "op8_warc_index": (op8_warc_index, warc.SQL),
    "op9_simhash_dedup": (op9_simhash_dedup, None),
    "op10_hilbert_ann": (op10_hilbert_ann, None),
    "op11_merkle_manifest": (op11_merkle_manifest, merkle_manifest.SQL),
    "op12_collocations": (op12_collocations, collocations.SQL),
    "op13_token_planes": (op13_token_planes, None),
}
