"""Surrogate-key lookup of log rows in the dimension tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from reelmart.operators.dims import DIMENSIONS
from reelmart.operators.skew import HOT_ROWS, ROW, balanced_join, with_hot_keys

# What all dimensions sent to every executor may take, and what a row costs there beside its key text.
BROADCAST_BYTES = 64 * 1024 * 1024
_ROW_BYTES = 64
# What any other side of a join may take there.
SIDE_BYTES = 8 * 1024 * 1024


def dimension_bytes(dims: dict[str, DataFrame]) -> dict[str, int]:
    """Memory each dimension takes when broadcast, measured over the whole table."""
    sizes = [
        dim.agg(
            F.lit(name).alias("name"),
            F.sum(
                F.coalesce(F.octet_length(F.col(DIMENSIONS[name][0]).cast("string")), F.lit(0))
                + _ROW_BYTES
            ).alias("bytes"),
        )
        for name, dim in dims.items()
    ]
    # One row per dimension.
    return {r["name"]: r["bytes"] or 0 for r in reduce(DataFrame.unionAll, sizes).collect()}


def broadcastable(sizes: dict[str, int], limit: int) -> set[str]:
    """The smallest dimensions that together stay within ``limit`` bytes."""
    chosen, used = set(), 0
    for name in sorted(sizes, key=lambda n: (sizes[n], n)):
        used += sizes[name]
        if used <= limit:
            chosen.add(name)
    return chosen


def sides_by_size(sides: dict[str, DataFrame], limit: int = SIDE_BYTES) -> dict[str, DataFrame]:
    """Sides of joins, those whose rows take up to ``limit`` bytes to be broadcast, the others not to be.

    Left to itself Spark goes by the size of the files. These are compressed: rows of a file below its bound
    may take many times as much at the driver, which collects them, and whose memory they end. Where all
    sides are within the limit, it is left to itself.
    """
    sizes = []
    for name, side in sides.items():
        texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in side.schema if f.dataType == StringType()]
        row = reduce(Column.__add__, texts, F.lit(_ROW_BYTES))
        sizes.append(side.agg(F.lit(name).alias("name"), F.sum(row).alias("bytes")))
    # One row per side.
    found = {r["name"]: r["bytes"] or 0 for r in reduce(DataFrame.unionAll, sizes).collect()}
    if max(found.values()) <= limit:
        return sides
    return {
        name: F.broadcast(side) if found[name] <= limit else side.hint("merge") for name, side in sides.items()
    }


def _single_ids(dim: DataFrame, key: str, id_col: str) -> DataFrame:
    return dim.groupBy(F.col(key).alias("_key")).agg(
        F.min(id_col).alias("_id"), F.count("*").alias("_matches")
    )


def lookup_ids(
    logs: DataFrame,
    dims: dict[str, DataFrame],
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
    sizes: dict[str, int] | None = None,
) -> DataFrame:
    """``logs`` with one id column per dimension.

    A key without a match, or no key at all, gives a NULL id and keeps the row; a key that has two
    ids in its dimension fails the job. ``logs`` and ``dims`` should be tables, as both are read more
    than once. Dimensions are broadcast, the smallest first, as far as their measured ``sizes`` (from
    ``dimension_bytes``) allow it together; larger ones are joined by shuffle, with the log rows of
    hot keys split.
    """
    small = broadcastable(sizes or dimension_bytes(dims), broadcast_bytes)
    large = [name for name in dims if name not in small]
    numbered = ROW in logs.columns
    hot = {}
    if large:
        large_keys = [DIMENSIONS[name][0] for name in large]
        found, hot = with_hot_keys(logs.drop(ROW), *large_keys, hot_rows=hot_rows)
        logs = logs if numbered else found
    for name, dim in dims.items():
        key, id_col = DIMENSIONS[name]
        ids = _single_ids(dim, key, id_col)
        if name in large:
            logs = balanced_join(logs, ids, key, "_key", "left", left_hot=hot[key], hot_rows=hot_rows)
        else:
            logs = logs.join(F.broadcast(ids), F.col(key) == F.col("_key"), "left").drop("_key")
        two_ids = F.raise_error(F.lit(f"{name}: more than one {id_col} for one {key}"))
        logs = logs.withColumn(
            id_col, F.when(F.col("_matches") > 1, two_ids).otherwise(F.col("_id"))
        ).drop("_id", "_matches")
    return logs if numbered else logs.drop(ROW)
