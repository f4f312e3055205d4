"""Queries given as SQL over named tables, with an oracle for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedge.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def sql_over(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """spark.sql over DataFrames by name; they are common table expressions, so no view stays behind."""
    text = text.strip()
    recursive = text.upper().startswith("WITH RECURSIVE")
    has_with = recursive or text.upper().startswith("WITH")
    body = text.split(None, 2 if recursive else 1)[-1] if has_with else text
    heads = ", ".join(f"{name} AS (SELECT * FROM {{{name}__}})" for name in tables)
    escaped = body.replace("{", "{{").replace("}", "}}")
    full = f"WITH {'RECURSIVE ' if recursive else ''}{heads}{', ' if has_with else ' '}{escaped}"
    return spark.sql(full, **{f"{name}__": df for name, df in tables.items()})


def plan(tables: str, spark_sql: str, oracle: str | None = None) -> tuple[Query, str]:
    """(query, oracle) of one SQL text that both engines read, or of one for each."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return sql_over(spark, spark_sql, **{name: table(spark, folder, name) for name in tables.split()})

    return run, oracle or spark_sql


def frame(tables: str, build: Callable[..., DataFrame], oracle: str | None = None) -> tuple[Query, str | None]:
    """(query, oracle) of a function that takes the tables in order."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(*(table(spark, folder, name) for name in tables.split()))

    return run, oracle
