"""All queries of the library with their SQL, gathered from the modules that define them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clademill.queries import inventory, more, relational, sequences, statistics
from clademill.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship", "inventory", "more", "relational", "sequences", "statistics"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.multiple_testing(spark, sf_dir)
