"""Staged tables laid out by the keys the fact joins on, so that building it shuffles none of them.

Purchases and reviews are bucketed by customer, reviews and logs by review, each pair into the same
number of buckets. Sums per customer, and the joins, then find all rows of a key in one bucket, and Spark
plans no exchange. The price is one shuffle per table when it is laid out; it pays when a fact is built
several times over the same staged rows, with other keywords, dimensions or dates.

A bucket is one task's work, so keys with very many rows do not go into buckets: the rows of keys
that are hot in either table of a pair are kept aside in a table of their own, and meet each other in a
``balanced_join``. Sums of hot customers are combined before their shuffle, as always.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable
from functools import partial
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmart.operators.dims import DIMENSIONS
from reelmart.operators.fact import CUSTOMER_BYTES, fact_columns
from reelmart.operators.lookup import BROADCAST_BYTES, broadcastable, dimension_bytes, lookup_ids
from reelmart.operators.purchases import customer_review_spend, customer_spend
from reelmart.operators.reviews import review_scores
from reelmart.operators.skew import HOT_ROWS, ROW, balanced_join, hot_keys, numbered_rows
from reelmart.plans.together import together
from reelmart.scratch import measured

# Rows of narrow columns that one task takes at a time.
ROWS_PER_BUCKET = 5_000_000

_LOG_KEYS = [key for key, _ in DIMENSIONS.values()]


class Layout(NamedTuple):
    """A table in buckets, and its rows of hot keys with their counts."""

    buckets: DataFrame
    aside: DataFrame
    hot: dict[Any, int]


class StagedLayout(NamedTuple):
    purchases: Layout
    reviews_by_user: Layout
    reviews_by_id: Layout
    logs: Layout


def _is_hot(key: str, hot: set) -> Column:
    return F.col(key).isin(*hot) if hot else F.lit(False)


def _lay_out(df: DataFrame, table: str, key: str, buckets: int, hot: set, counts: dict[Any, int]) -> Layout:
    """Writes ``table`` and ``table__hot``; rows without a key, which join nothing, are left out."""
    spark = df.sparkSession
    keyed = df.where(F.col(key).isNotNull())
    # Bucket and partition are the same hash, so a task writes one file.
    cold = keyed.where(~_is_hot(key, hot)).repartition(buckets, key)
    cold.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    keyed.where(_is_hot(key, hot)).write.mode("overwrite").format("parquet").saveAsTable(f"{table}__hot")
    return Layout(spark.table(table), spark.table(f"{table}__hot"), {k: counts[k] for k in counts if k in hot})


def lay_out(
    spark: SparkSession,
    database: str,
    purchases: DataFrame,
    reviews: DataFrame,
    logs: DataFrame,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    hot_rows: int = HOT_ROWS,
) -> StagedLayout:
    """The staged tables in buckets of ``database``; the inputs should be tables, as each is read again."""
    purchases = purchases.select(F.col("customer_id").cast("bigint").alias("customer_id"), "quantity", "unit_price")
    logs = logs.select("log_id", *_LOG_KEYS)
    of_purchases, of_reviews, of_logs, n_purchases, n_reviews, n_logs = together(
        lambda: hot_keys(purchases, "customer_id", hot_rows=hot_rows)["customer_id"],
        lambda: hot_keys(reviews, "user_id", "review_id", hot_rows=hot_rows),
        lambda: hot_keys(logs, "log_id", hot_rows=hot_rows)["log_id"],
        purchases.count,
        reviews.count,
        logs.count,
    )

    def buckets(*rows: int) -> int:
        return max(1, math.ceil(max(rows) / rows_per_bucket))

    users = {k for k in {*of_purchases, *of_reviews["user_id"]} if k is not None}
    ids = {k for k in {*of_logs, *of_reviews["review_id"]} if k is not None}
    by_user, by_id = buckets(n_purchases, n_reviews), buckets(n_reviews, n_logs)
    tables = [
        (purchases, "purchases_by_customer", "customer_id", by_user, users, of_purchases),
        (reviews, "reviews_by_user", "user_id", by_user, users, of_reviews["user_id"]),
        (reviews.select("review_id", "user_id"), "reviews_by_id", "review_id", by_id, ids, of_reviews["review_id"]),
        (logs, "logs_by_id", "log_id", by_id, ids, of_logs),
    ]
    return StagedLayout(
        *together(*(partial(_lay_out, df, f"{database}.{name}", *rest) for df, name, *rest in tables))
    )


def _totals(layout: StagedLayout) -> DataFrame:
    """Spend and scores of customers who have both, bucket by bucket."""
    cold = customer_review_spend(customer_spend(layout.purchases.buckets), review_scores(layout.reviews_by_user.buckets))
    hot = customer_review_spend(customer_spend(layout.purchases.aside), review_scores(layout.reviews_by_user.aside))
    return cold.unionAll(hot) if layout.purchases.hot or layout.reviews_by_user.hot else cold


def _links(layout: StagedLayout, number: bool, look_up: Callable[[DataFrame], DataFrame], hot_rows: int) -> DataFrame:
    """Users of reviews with the ids of their logs, bucket by bucket; rows are numbered if asked for."""
    reviews, logs = layout.reviews_by_id, layout.logs
    columns = ["user_id", *(id_col for _, id_col in DIMENSIONS.values()), *([ROW] if number else [])]
    read = reviews.buckets.select("review_id", "user_id")
    cold = (numbered_rows(read) if number else read).join(
        look_up(logs.buckets), F.col("review_id") == F.col("log_id")
    )
    if not (reviews.hot or logs.hot):
        return cold.select(*columns)
    hot = balanced_join(
        numbered_rows(reviews.aside),
        look_up(numbered_rows(logs.aside)),
        "review_id",
        "log_id",
        left_hot=reviews.hot,
        right_hot=logs.hot,
        hot_rows=hot_rows,
    )
    return cold.select(*columns).unionAll(hot.select(*columns))


def build_fact_over(
    layout: StagedLayout,
    dims: dict[str, DataFrame],
    as_of: dt.date | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The rows of ``build_fact``, from the layout.

    The totals are broadcast if dimensions leave room for them. If they are too many, the narrow rows of
    reviews and ids are shuffled by customer, hot customers split, but neither purchases nor logs.
    """
    totals, found = measured(_totals(layout), rows=F.count("*"))
    sizes = dimension_bytes(dims)
    used = sum(sizes[name] for name in broadcastable(sizes, broadcast_bytes))
    few_customers = found["rows"] * CUSTOMER_BYTES <= broadcast_bytes - used
    hot_users = {} if few_customers else layout.reviews_by_user.hot

    def look_up(logs: DataFrame) -> DataFrame:
        return lookup_ids(logs, dims, broadcast_bytes, hot_rows, sizes).drop(*_LOG_KEYS)

    joined = balanced_join(
        _links(layout, bool(hot_users), look_up, hot_rows),
        F.broadcast(totals) if few_customers else totals,
        "user_id",
        "customer_id",
        left_hot=hot_users,
        hot_rows=hot_rows,
    )
    return fact_columns(joined.withColumnRenamed("user_id", "customerid"), as_of)
