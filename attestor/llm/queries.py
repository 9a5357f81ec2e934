"""Registered queries of the language-model operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import best_fit, fill_in_middle, media, mixing, packing, pii, quality, secrets, simhash, token_counts, toxicity, url_rules, whitening


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base spans, spans that the method adds, and linked credentials."""
    return secrets.report(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the least id that links of four or fewer bits reach."""
    return simhash.report(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of toxicity and a verdict for every document, learned from the labels that aren't held out."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2,048 tokens, one row for each piece."""
    return packing.report(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and the verdict for the URL of every page."""
    return url_rules.report(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mixture takes."""
    return mixing.report(table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a WAV file, read back and fingerprinted."""
    return media.report(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans and those that checksums or nearby words confirm."""
    return pii.report(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, the base rule and the verdict of the trees."""
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of every document, and how much of it the limit holds."""
    return token_counts.report(table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in few sequences of at most 2,048 tokens, cut only where they are longer; one row for each piece."""
    return best_fit.report(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into prefix, middle and suffix and put together in another order, and the text it is restored to."""
    return fill_in_middle.report(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every embedding."""
    return whitening.report(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    found = [
        op1_secret_scan, op2_simhash_near_dedup, op3_toxicity, op4_packing, op5_url_filter, op6_mixing, op7_media, op8_pii, op9_quality_rules, op10_token_counts,
        op11_best_fit_packing, op12_fill_in_middle, op13_whitening,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    return {"op5_url_filter": url_rules.ORACLE, "op6_mixing": mixing.ORACLE, "op12_fill_in_middle": fill_in_middle.ORACLE}
