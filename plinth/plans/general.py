"""Queries of the general data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plinth.operators import timestamps
from plinth.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.archive_stamps(table(spark, d, "talks"), table(spark, d, "blog_pages"), table(spark, d, "feeds"))


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
