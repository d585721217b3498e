"""One explicit schema per table; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    DataType,
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def table_of(*columns: tuple[str, DataType]) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in columns])


# Fixed values that must match: names, order and declared types of all columns below.

# Raw inputs
LOG_REVIEWS = table_of(("id_review", LongType()), ("log", StringType()))

MOVIE_REVIEWS = table_of(("cid", LongType()), ("review_str", StringType()), ("id_review", LongType()))

USER_PURCHASE = table_of(
    ("invoice_number", StringType()),
    ("stock_code", StringType()),
    ("detail", StringType()),
    ("quantity", IntegerType()),
    ("invoice_date", TimestampNTZType()),
    ("unit_price", DecimalType(8, 3)),
    ("customer_id", IntegerType()),
    ("country", StringType()),
)

# Declared varchar lengths of USER_PURCHASE.
USER_PURCHASE_LENGTHS = {"invoice_number": 10, "stock_code": 20, "detail": 1000, "country": 20}

# Staged tables
LOG_REVIEWS_TRANSFORMED = table_of(
    ("log_id", LongType()),
    ("log_date", DateType()),
    ("device", StringType()),
    ("os", StringType()),
    ("location", StringType()),
    ("ip", StringType()),
    ("phone_number", StringType()),
)

CLASSIFIED_MOVIE_REVIEWS = table_of(
    ("user_id", LongType()), ("positive_review", IntegerType()), ("review_id", LongType())
)

# Warehouse tables
DIM_DATE = table_of(
    ("id_dim_date", LongType()),
    ("log_date", DateType()),
    ("day", StringType()),
    ("month", StringType()),
    ("year", StringType()),
    ("season", StringType()),
)
DIM_DEVICES = table_of(("id_dim_devices", LongType()), ("device", StringType()))
DIM_LOCATION = table_of(("id_dim_location", LongType()), ("location", StringType()))
DIM_OS = table_of(("id_dim_os", LongType()), ("os", StringType()))
DIM_BROWSER = table_of(("id_dim_browser", LongType()), ("browser", StringType()))

FACT_MOVIE_ANALYTICS = table_of(
    ("customerid", LongType()),
    ("id_dim_date", LongType()),
    ("id_dim_devices", LongType()),
    ("id_dim_location", LongType()),
    ("id_dim_os", LongType()),
    ("amount_spent", DecimalType(18, 5)),
    ("review_score", LongType()),
    ("review_count", LongType()),
    ("insert_date", DateType()),
)

STAGE_TABLES = {
    "log_reviews_transformed": LOG_REVIEWS_TRANSFORMED,
    "classified_movie_reviews": CLASSIFIED_MOVIE_REVIEWS,
    "user_purchase": USER_PURCHASE,
}

# dim_browser is part of the warehouse but no input carries a browser: it stays empty.
WAREHOUSE_TABLES = {
    "dim_date": DIM_DATE,
    "dim_devices": DIM_DEVICES,
    "dim_location": DIM_LOCATION,
    "dim_os": DIM_OS,
    "dim_browser": DIM_BROWSER,
    "fact_movie_analytics": FACT_MOVIE_ANALYTICS,
}
