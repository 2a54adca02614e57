"""Registered queries of the library without its optional parts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.plans import domain, domain_sql, exchange, exchange_sql, problems, problems_sql


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return domain.flagship(spark, folder)


def queries() -> dict:
    return domain.QUERIES | exchange.QUERIES | problems.queries()


def oracle_sql() -> dict[str, str]:
    return domain_sql.ORACLES | exchange_sql.ORACLES | problems_sql.ORACLES
