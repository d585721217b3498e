"""Dimension tables from the parsed review log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmart.functions import calendar
from reelmart.operators.keys import dense_ids, number_in_one_task

# Log column and id column of each dimension.
DIMENSIONS = {
    "dim_date": ("log_date", "id_dim_date"),
    "dim_devices": ("device", "id_dim_devices"),
    "dim_location": ("location", "id_dim_location"),
    "dim_os": ("os", "id_dim_os"),
}


def build_dim_date(logs: DataFrame) -> DataFrame:
    """One row per log date. There are fewer than four million dates, so one task can number them."""
    dates = number_in_one_task(logs.select("log_date").distinct(), "log_date", "id_dim_date")
    date = F.col("log_date")
    return dates.select(
        "id_dim_date",
        "log_date",
        calendar.day_of_month(date).alias("day"),
        calendar.month_name(date).alias("month"),
        calendar.year_number(date).alias("year"),
        calendar.season(date).alias("season"),
    )


def build_dim(logs: DataFrame, key: str, id_col: str) -> DataFrame:
    """One row per distinct value of ``key``, NULL included, whatever their number."""
    return dense_ids(logs.select(key).distinct(), key, id_col)


def build_dimension(logs: DataFrame, name: str) -> DataFrame:
    """The dimension table called ``name``."""
    key, id_col = DIMENSIONS[name]
    return build_dim_date(logs) if name == "dim_date" else build_dim(logs, key, id_col)


def extend_dimension(stored: DataFrame, logs: DataFrame, name: str) -> DataFrame:
    """The rows that ``logs`` add to a ``stored`` dimension; those it has keep their ids.

    New keys, NULL among them, are numbered in key order from the highest stored id on. Running it
    again after its rows are stored gives none.
    """
    key, id_col = DIMENSIONS[name]
    known = stored.select(F.col(key).alias("_known"))
    new = logs.select(key).distinct().join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")
    highest = stored.agg(F.max(id_col)).first()[0] or 0
    return build_dimension(new, name).withColumn(id_col, F.col(id_col) + F.lit(highest).cast("bigint"))
