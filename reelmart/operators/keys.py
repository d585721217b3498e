"""Dense surrogate keys: 1..N in key order, NULL first."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmart.scratch import measured, written

# Keys that one task numbers on its own.
KEYS_PER_TASK = 1_000_000


def number_in_one_task(keys: DataFrame, key: str, id_col: str) -> DataFrame:
    """``row_number`` over all keys at once, for key sets of a known small size."""
    order = Window.orderBy(F.col(key).asc_nulls_first())
    return keys.select(F.row_number().over(order).cast("bigint").alias(id_col), key)


def number_by_ranges(keys: DataFrame, key: str, id_col: str, ranges: int) -> DataFrame:
    """The same numbers from ``ranges`` tasks.

    The keys are cut into key ranges and written, so that counting and numbering see the same cut.
    Each range numbers its own keys and adds the number of keys in the ranges before it.
    """
    cut = written(
        keys.select(key)
        .repartitionByRange(ranges, F.col(key).asc_nulls_first())
        .withColumn("_range", F.spark_partition_id())
    )
    # One row per range.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy("_range")
        .agg(F.count("*").alias("_keys"))
        .select("_range", F.coalesce(F.sum("_keys").over(before), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy("_range").orderBy(F.col(key).asc_nulls_first())
    return (
        cut.withColumn("_place", F.row_number().over(within))
        .join(F.broadcast(offsets) if ranges <= KEYS_PER_TASK else offsets, "_range")
        .select((F.col("_before") + F.col("_place")).alias(id_col), key)
    )


def dense_ids(
    keys: DataFrame, key: str, id_col: str, keys_per_task: int = KEYS_PER_TASK
) -> DataFrame:
    """``(id_col, key)`` for distinct ``keys``; the number of tasks follows the number of keys."""
    keys, found = measured(keys.select(key), rows=F.count("*"))
    ranges = math.ceil(found["rows"] / keys_per_task)
    if ranges <= 1:
        return number_in_one_task(keys, key, id_col)
    return number_by_ranges(keys, key, id_col, ranges)
