"""Purchase lines: exact staging and spend per customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmart.schemas import USER_PURCHASE, USER_PURCHASE_LENGTHS


def _within(name: str, limit: int) -> Column:
    # Surplus trailing blanks are cut, any other surplus text is an error.
    value = F.col(name)
    return (
        F.when(F.length(value) <= limit, value)
        .when(F.length(F.rtrim(value)) <= limit, F.substring(value, 1, limit))
        .when(
            value.isNotNull(),
            F.raise_error(F.lit(f"{name} is longer than {limit} characters")),
        )
    )


def stage_user_purchase(raw: DataFrame) -> DataFrame:
    """The eight purchase columns under their declared types; over-long text raises."""
    return raw.select(
        *(
            (
                _within(field.name, USER_PURCHASE_LENGTHS[field.name])
                if field.name in USER_PURCHASE_LENGTHS
                else F.col(field.name)
            )
            .cast(field.dataType)
            .alias(field.name)
            for field in USER_PURCHASE.fields
        )
    )


def customer_spend(purchases: DataFrame) -> DataFrame:
    """Exact spend per customer.

    The key is widened before grouping, so that a join with the 64-bit review users can use the same
    partitioning.
    """
    spend = F.sum(F.col("quantity") * F.col("unit_price")).cast("decimal(18,5)")
    return purchases.groupBy(F.col("customer_id").cast("bigint").alias("customer_id")).agg(
        spend.alias("amount_spent")
    )


def customer_review_spend(spend: DataFrame, scores: DataFrame) -> DataFrame:
    """Customers who both bought and reviewed; one row on either side per customer."""
    return spend.join(scores, spend["customer_id"] == scores["user_id"], "inner").select(
        "customer_id", "amount_spent", "review_score", "review_count"
    )


def row_count_gate(table: DataFrame) -> DataFrame:
    """Row count of a table and whether it holds anything."""
    return table.agg(F.count("*").alias("total_rows")).withColumn(
        "is_loaded", F.col("total_rows") > 0
    )
