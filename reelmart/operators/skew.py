"""Equi-joins that stay balanced when single keys hold a large part of the rows.

The hot keys are found by a bounded sketch, their rows are spread over as many salts as their count
asks for, and the partner rows of those keys, only those, are repeated once per salt. Every pair meets
exactly once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import chain
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it has more than this share of the rows; fewer than 1 / HOT_SHARE keys can be.
HOT_SHARE = 1 / 500
# Rows of one key that a single task takes without trouble; below it no key is hot.
HOT_ROWS = 5_000_000
# Counters per sketch: 2000 of them miss no key with more than 0.17 % of the rows (twice the error
# bound, 3.5 / 4096), which is below HOT_SHARE.
_COUNTERS = 2000
# First-level sketches that are merged independently before the last merge.
_SKETCH_GROUPS = 256

ROW = "_row"


def numbered_rows(df: DataFrame) -> DataFrame:
    """``df`` with a row number that tells even equal rows apart.

    To be called on a table scan, before any shuffle: there a repeated task sees its rows in the same
    order, so a row keeps its number. The number then travels with the row.
    """
    return df.withColumn(ROW, F.monotonically_increasing_id())


def hot_keys(df: DataFrame, *columns: str, hot_rows: int = HOT_ROWS) -> dict[str, dict[Any, int]]:
    """The hot values of each column with their counts, ``None`` among them when NULL is hot.

    One pass over the key columns. Tasks keep fixed-size sketches, which are merged in two steps, so
    what reaches the driver is bounded whatever the number of rows or keys. A table with no more than
    ``hot_rows`` rows is only counted.
    """
    rows = df.count()
    if rows <= hot_rows:
        return {c: {} for c in columns}
    least = max(hot_rows, HOT_SHARE * rows)
    sketch = "approx_top_k_accumulate(`{c}`, {n})"
    merged = "approx_top_k_estimate(approx_top_k_combine(`_sketch_{c}`, {n}), {k})"
    partial = df.groupBy((F.spark_partition_id() % _SKETCH_GROUPS).alias("_group")).agg(
        *(F.expr(sketch.format(c=c, n=_COUNTERS)).alias(f"_sketch_{c}") for c in columns),
        *(F.count_if(F.col(c).isNull()).alias(f"_nulls_{c}") for c in columns),
    )
    found = partial.agg(
        *(
            F.expr(merged.format(c=c, n=_COUNTERS, k=int(1 / HOT_SHARE))).alias(c)
            for c in columns
        ),
        *(F.sum(f"_nulls_{c}").alias(f"_nulls_{c}") for c in columns),
    ).first()
    hot = {}
    for c in columns:
        tops = {top["item"]: top["count"] for top in found[c] or [] if top["item"] is not None}
        tops[None] = found[f"_nulls_{c}"]
        hot[c] = {key: count for key, count in tops.items() if count > least}
    return hot


def with_hot_keys(
    table: DataFrame, *columns: str, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, dict[str, dict[Any, int]]]:
    """A table scan ready for ``balanced_join`` on ``columns``, and the hot keys of each of them."""
    hot = hot_keys(table, *columns, hot_rows=hot_rows)
    return (numbered_rows(table) if any(hot.values()) else table), hot


def salts_of(hot: Mapping[Any, int], hot_rows: int, most: int) -> dict[Any, int]:
    """Salts per key: one for every ``hot_rows`` of its rows, two at least and ``most`` at most."""
    return {
        key: max(2, min(most, math.ceil(count / max(1, hot_rows)))) for key, count in hot.items()
    }


def _shared_out(
    left: dict[Any, int], right: dict[Any, int], most: int
) -> tuple[dict[Any, int], dict[Any, int]]:
    """Fewer salts on both sides for keys that are hot on both, so that their product is ``most``."""
    left, right = dict(left), dict(right)
    for key in left.keys() & right.keys():
        product = left[key] * right[key]
        if product > most:
            down = math.sqrt(most / product)
            left[key] = max(1, int(left[key] * down))
            right[key] = max(1, int(right[key] * down))
    return left, right


def _salts(key: str, salts: Mapping[Any, int]) -> Column:
    """Number of salts of the row's key; one for keys that are not hot, and for NULL keys."""
    known = {value: n for value, n in salts.items() if value is not None}
    if not known:
        return F.lit(1)
    pairs = F.create_map(*(F.lit(x) for x in chain.from_iterable(known.items())))
    return F.coalesce(F.try_element_at(pairs, F.col(key)), F.lit(1))


def _own_salt(salts: Column) -> Column:
    return F.pmod(F.xxhash64(ROW), salts).cast("int")


def _every_salt(salts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), salts - 1))


def balanced_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "inner",
    left_hot: Mapping[Any, int] | None = None,
    right_hot: Mapping[Any, int] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``left`` joined to ``right`` on ``left_key = right_key``, hot keys split.

    ``left_hot`` and ``right_hot`` are the keys that are hot on each side with their row counts (from
    ``hot_keys``). A key gets a salt for every ``hot_rows`` of its rows, no more than there are shuffle
    partitions; where it is hot on both sides, the product of its salts is held to that. A side
    with hot keys must carry the ``numbered_rows`` column. ``how`` is ``inner`` or ``left``; in a
    left join ``None`` in ``left_hot`` spreads the left rows without a key, which would otherwise
    share one task. The right key and the right row number are dropped; all other column
    names must differ between the sides.

    Without hot keys this is the plain join, left to Catalyst and adaptive execution.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how!r}")
    if how == "left" and right_hot:
        # A left row repeated per right salt would stay unmatched once per salt without a partner.
        raise ValueError("a left join splits hot keys of the left side only")
    most = max(2, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left_salts = salts_of(left_hot or {}, hot_rows, most)
    right_salts = salts_of(right_hot or {}, hot_rows, most)
    null_salts = left_salts.pop(None, None) if how == "left" else None
    for salts in (left_salts, right_salts):
        salts.pop(None, None)
    left_salts, right_salts = _shared_out(left_salts, right_salts, most)
    right = right.withColumnRenamed(right_key, "_right_key")
    condition = F.col(left_key) == F.col("_right_key")
    if left_salts or null_salts:
        own = _salts(left_key, left_salts)
        if null_salts:
            own = F.when(F.col(left_key).isNull(), F.lit(null_salts)).otherwise(own)
        left = left.withColumn("_left_salt", _own_salt(own))
        right = right.withColumn("_left_salt_of", _every_salt(_salts("_right_key", left_salts)))
        condition &= F.col("_left_salt") == F.col("_left_salt_of")
    if right_salts:
        right = right.withColumn("_right_salt", _own_salt(_salts("_right_key", right_salts)))
        left = left.withColumn("_right_salt_of", _every_salt(_salts(left_key, right_salts)))
        condition &= F.col("_right_salt") == F.col("_right_salt_of")
    return left.join(right.drop(ROW), condition, how).drop(
        "_right_key", "_left_salt", "_left_salt_of", "_right_salt", "_right_salt_of"
    )
