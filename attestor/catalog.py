"""All registered queries of the library and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import evidence, findings, joins, labels, live, nearest, policy, quantum, repairs, rules, scans, scope  # noqa: F401  they register their queries
from .plans.registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_evidence_ranking"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
