"""Whole-table extract from a relational store over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_relational(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    lower: str | int,
    upper: str | int,
    partitions: int,
    fetch_size: int = 10_000,
    **properties: str,
) -> DataFrame:
    """All rows of ``table``, read by ``partitions`` tasks that each take a range of ``column``.

    ``column`` is a number, date or timestamp column with an even spread, such as the invoice date;
    ``lower`` and ``upper`` only place the cuts, rows beyond them and NULLs are read as well.
    """
    return (
        spark.read.format("jdbc")
        .options(
            **relational_options(url, table, column, lower, upper, partitions, fetch_size),
            **properties,
        )
        .load()
    )


def relational_options(
    url: str,
    table: str,
    column: str,
    lower: str | int,
    upper: str | int,
    partitions: int,
    fetch_size: int,
) -> dict[str, str]:
    """Spark's JDBC options for a partitioned extract."""
    if partitions < 1:
        raise ValueError("at least one partition is needed")
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
        # timestamp without zone, as the purchase schema has it
        "preferTimestampNTZ": "true",
    }
