"""All registered queries of the library outside the training-text operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradeloom.plans import evaluation, grading, ingestion, progress, reviews
from gradeloom.plans.adapters import Views, plain

FAMILIES = (grading, progress, reviews, ingestion, evaluation)


def _query(plan: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plain(plan(Views(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(plan) for family in FAMILIES for name, plan in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for family in FAMILIES for name, text in family.SQL.items()}
