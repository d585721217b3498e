"""Headered CSV files under explicit or inferred schemas.

Fields may hold quotes (doubled), commas and line breaks. Spark's own reader handles line breaks by
giving a file to one task. That is right for many files of a moderate size; a larger file is cut into
records by ``quoted_records``, which spreads one file over many tasks by the same rules. Where no
field holds a line break, ``multiline=False`` lets Spark's reader split every file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelmart import schemas
from reelmart.scratch import written
from reelmart.sources.csv_records import all_records, by_line_break
from reelmart.sources.csv_types import Inferred, column_kinds, infer_types

# An unquoted empty field is NULL, a quoted one ("") an empty string: the NULL marker
# must be something that no text holds.
_NO_TEXT = "\u0000"

_OPTIONS = {"sep": ",", "quote": '"', "escape": '"', "nullValue": _NO_TEXT}

# Column of what could not be read, and of the place where it stands.
_REJECTED = "_rejected"
REJECT_COLUMNS = ["file", "offset", "line", "value", "reason"]

# Largest file that one task reads.
FILE_BYTES_PER_TASK = 1024 * 1024 * 1024


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | None = None,
    multiline: bool = True,
    fail_on_bad_rows: bool = False,
    file_bytes_per_task: int = FILE_BYTES_PER_TASK,
) -> DataFrame:
    """Files with a header row as ``schema``; a field that does not fit is NULL or fails the job.

    Without a schema the types are those that ``infer_csv`` finds.
    """
    if schema is None:
        schema = infer_csv(spark, path).schema
    options = {
        **_OPTIONS,
        "multiLine": str(multiline).lower(),
        "mode": "FAILFAST" if fail_on_bad_rows else "PERMISSIVE",
    }
    plain = spark.read.schema(schema).option("header", True).options(**options)
    if not multiline:
        return plain.csv(path)
    found = by_line_break(spark, path, file_bytes_per_task)
    if not any(found.by_break()):
        return plain.csv(path)
    row = F.from_csv("value", _ddl(schema), options)
    records = all_records(spark, found).select(row.alias("row")).select("row.*")
    return records.unionAll(plain.csv(found.others)) if found.others else records


def _records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The records of all files, small and compressed ones too, with their places."""
    return all_records(spark, by_line_break(spark, path, -1, whole_only=True))


def _names(spark: SparkSession, path: str | list[str]) -> list[str]:
    return spark.read.option("header", True).options(**_OPTIONS, multiLine="true").csv(path).columns


def csv_column_kinds(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per column and kind of value how many there are, and the type of the column: column, kind, n_values, type.

    Empty fields are no values; a column of nothing else has one row, without a kind.
    """
    names = _names(spark, path)
    return column_kinds(_records(spark, path), names, {**_OPTIONS, "multiLine": "true"})


def infer_csv(spark: SparkSession, path: str | list[str]) -> Inferred:
    """Names from the header, types from every record, and the first record that widened each type."""
    names = _names(spark, path)
    if not names:
        return Inferred(StructType(), [])
    return infer_types(spark, _records(spark, path), names, {**_OPTIONS, "multiLine": "true"})


def read_csv_and_rejects(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType,
    lengths: dict[str, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The rows that fit ``schema``, and the records that do not, with their places.

    A record is rejected whole if it has another number of fields than the schema, a field that is no
    value of its type, or a text beyond its limit in ``lengths`` (trailing blanks apart). Rejects have
    file, offset (of the first byte), line, value (the record as it stands) and reason. The files are
    parsed once, into a scratch table that both results are read from.
    """
    options = {**_OPTIONS, "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _REJECTED}
    row = F.from_csv("value", f"{_ddl(schema)}, {_REJECTED} string", options)
    parsed = _records(spark, path).withColumn("row", row).withColumn("reason", _reason(lengths or {}))
    # Names of the schema may be those of the places, so the row stays a column of its own.
    fields = F.struct(*(F.col("row")[name].alias(name) for name in schema.names))
    is_good = F.col("reason").isNull()
    held = written(
        parsed.select(
            F.when(is_good, fields).alias("row"),
            # The record's text is kept where it is wanted.
            *(F.when(~is_good, F.col(name)).alias(name) for name in REJECT_COLUMNS),
        )
    )
    return held.where("reason IS NULL").select("row.*"), held.where("reason IS NOT NULL").select(*REJECT_COLUMNS)


def _reason(lengths: dict[str, int]) -> Column:
    """Why a parsed record is rejected; NULL for a good one."""
    reason = F.when(F.col("row")[_REJECTED].isNotNull(), F.lit("fields"))
    for name, limit in lengths.items():
        reason = reason.when(F.length(F.rtrim(F.col("row")[name])) > limit, F.lit(f"length of {name}"))
    return reason


def read_log_reviews(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Raw review logs."""
    return read_csv(spark, path, schemas.LOG_REVIEWS, **options)


def read_movie_reviews(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Raw movie reviews."""
    return read_csv(spark, path, schemas.MOVIE_REVIEWS, **options)


def read_user_purchase(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Purchase lines as a bulk load reads them: one bad row fails the whole load."""
    return read_csv(spark, path, schemas.USER_PURCHASE, fail_on_bad_rows=True, **options)


def read_user_purchase_and_rejects(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """The purchase lines that the table takes, and the records that it does not, with their places."""
    return read_csv_and_rejects(spark, path, schemas.USER_PURCHASE, schemas.USER_PURCHASE_LENGTHS)


def read_stage_table(spark: SparkSession, path: str | list[str], table: str, **options) -> DataFrame:
    """A staged CSV (``log_reviews_transformed``, ``classified_movie_reviews``, ``user_purchase``)."""
    return read_csv(spark, path, schemas.STAGE_TABLES[table], **options)
