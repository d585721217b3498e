"""Column types of CSV files, found from all their records in one pass.

Every value is of the narrowest kind that reads it; the kinds form a lattice, and a column has the
smallest type that holds all kinds of its values:

    int < bigint < decimal < double < string,   date < timestamp < string,   boolean < string

Per column, kind and file the tasks keep the number of values and the place of the first one, so what
is merged is as long as columns times kinds times files, and the first record that widened each type
comes out of the same pass. Empty fields tell nothing; a column without any value is a string.

Kinds are those of Spark's own inference, with three differences, none of which loses a value: the result
does not depend on the order of the rows (years beside dates make a string), whole numbers are written
with ASCII digits only, and whole numbers with a decimal point or an exponent are doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from reelmart.scratch import written

_WHOLE = r"^[+-]?[0-9]+$"
_FRACTION = (
    r"^[\x00-\x20]*(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[dDfF]?|[+-]?(?:NaN|Infinity)|-?Inf)[\x00-\x20]*$"
)
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
# What a time stamp may begin with; the cast decides.
_TIME = r"^\s*[+-]?T?[0-9]"

# Digits that a whole number needs beside those of its own type, when it meets decimals.
_DIGITS = {"int": 10, "bigint": 20}
_MOST_DIGITS = 38

_NUMBERS = ("int", "bigint", "decimal", "double")
_TIMES = ("date", "timestamp")


class Widening(NamedTuple):
    """The first record that made a column's type wider."""

    column: str
    before: str
    after: str
    file: str
    offset: int
    line: int


class Inferred(NamedTuple):
    schema: StructType
    widenings: list[Widening]


def kind_of(value: Column) -> Column:
    """The kind of a text value, NULL for none."""
    as_whole = F.when(value.try_cast("int").isNotNull(), "int").when(
        value.try_cast("bigint").isNotNull(), "bigint"
    ).when(digits_of(value) <= _MOST_DIGITS, "decimal").otherwise("double")
    return (
        F.when(value.isNull() | (value == ""), F.lit(None))
        .when(value.rlike(_WHOLE), as_whole)
        .when(value.rlike(_FRACTION), "double")
        .when(value.rlike(_DATE) & value.try_cast("date").isNotNull(), "date")
        .when(value.rlike(_TIME) & value.try_cast("timestamp").isNotNull(), "timestamp")
        .when(F.lower(value).isin("true", "false"), "boolean")
        .otherwise("string")
    )


def digits_of(value: Column) -> Column:
    """Digits of a whole number, leading zeros apart."""
    return F.length(F.regexp_replace(value, "^[+-]?0*", ""))


def joined_type(kinds: set[str], digits: int = 0) -> DataType:
    """The type that holds all ``kinds``; ``digits`` are the most that a decimal value has."""
    if not kinds:
        return StringType()
    if kinds <= {"boolean"}:
        return BooleanType()
    if kinds <= set(_TIMES):
        return TimestampType() if "timestamp" in kinds else DateType()
    if not kinds <= set(_NUMBERS):
        return StringType()
    if "double" in kinds:
        return DoubleType()
    if "decimal" in kinds:
        most = max([digits, *(_DIGITS[k] for k in kinds if k in _DIGITS)])
        return DecimalType(most, 0)
    return LongType() if "bigint" in kinds else IntegerType()


def kinds_by_file(records: DataFrame, names: list[str], options: dict[str, str]) -> DataFrame:
    """``(place, kind, file, n_values, offset, line, digits)`` of the columns in ``records``.

    ``records`` has file, offset, line and value. Counts, first places and digits are numbers, so tasks
    keep them in hash tables and shuffle a row per column, kind and file.
    """
    fields = ", ".join(f"_{i} string" for i in range(len(names)))
    values = F.array(*(F.col(f"row._{i}") for i in range(len(names))))
    split = records.select("file", "offset", "line", F.from_csv("value", fields, options).alias("row"))
    valued = split.select("file", "offset", "line", F.posexplode(values).alias("place", "value"))
    kind = kind_of(F.col("value"))
    return (
        valued.withColumn("kind", kind)
        .withColumn("digits", F.when(F.col("kind") == "decimal", digits_of(F.col("value"))).otherwise(F.lit(0)))
        .groupBy("place", "kind", "file")
        .agg(
            F.count("*").alias("n_values"),
            F.min("offset").alias("offset"),
            F.min("line").alias("line"),
            F.max("digits").alias("digits"),
        )
    )


def first_kinds(by_file: DataFrame) -> DataFrame:
    """The same per column and kind: values in all files, and the first of them in file order."""
    return by_file.groupBy("place", "kind").agg(
        F.sum("n_values").alias("n_values"),
        F.max("digits").alias("digits"),
        F.min(F.struct("file", "offset", "line")).alias("first"),
    )


def _types(rows: list[Row], names: list[str]) -> Iterator[tuple[str, DataType, list[Widening]]]:
    """Per column its type and widenings, from the rows of ``first_kinds``, which are columns times kinds."""
    for place, name in enumerate(names):
        kinds: set[str] = set()
        digits, before = 0, None
        widenings = []
        found = [r for r in rows if r["place"] == place and r["kind"] is not None]
        for row in sorted(found, key=lambda r: tuple(r["first"])):
            kinds.add(row["kind"])
            digits = max(digits, row["digits"])
            after = joined_type(kinds, digits)
            if before is not None and after != before:
                widenings.append(Widening(name, before.simpleString(), after.simpleString(), *row["first"]))
            before = after
        yield name, before or StringType(), widenings


def infer_types(spark: SparkSession, records: DataFrame, names: list[str], options: dict[str, str]) -> Inferred:
    """Schema of ``records`` under the column ``names``, and what widened it.

    Columns times kinds rows reach the driver.
    """
    rows = first_kinds(kinds_by_file(records, names, options)).collect()
    found = list(_types(rows, names))
    schema = StructType([StructField(name, kind, True) for name, kind, _ in found])
    return Inferred(schema, [w for *_, widenings in found for w in widenings])


def column_kinds(records: DataFrame, names: list[str], options: dict[str, str]) -> DataFrame:
    """Per column and kind the number of values, and the column's type."""
    kinds = written(first_kinds(kinds_by_file(records, names, options)))
    types = [(i, name, kind.simpleString()) for i, (name, kind, _) in enumerate(_types(kinds.collect(), names))]
    columns = records.sparkSession.createDataFrame(types, "place int, column string, type string")
    valued = kinds.where("kind IS NOT NULL").select("place", "kind", "n_values")
    counted = F.coalesce("n_values", F.lit(0)).alias("n_values")
    return columns.join(valued, "place", "left").select("column", "kind", counted, "type")
