"""Registered queries: every operator over the whole test tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmart import schemas
from reelmart.operators.dims import DIMENSIONS, build_dimension, extend_dimension
from reelmart.operators.fact import build_fact
from reelmart.operators.keys import number_by_ranges
from reelmart.operators.logs import log_quality, parse_review_logs
from reelmart.operators.lookup import lookup_ids
from reelmart.operators.prefilter import FILTER_BYTES
from reelmart.operators.purchases import (
    customer_review_spend,
    customer_spend,
    row_count_gate,
    stage_user_purchase,
)
from reelmart.operators.reviews import classify_reviews, review_scores, review_tokens
from reelmart.operators.skew import HOT_ROWS
from reelmart.plans.colocated import build_fact_over, lay_out
from reelmart.plans.increments import CUSTOMER_TOTALS, load_increment, merged_totals, new_totals
from reelmart.plans.together import together
from reelmart.plans.warehouse import build_warehouse, load_stage_tables, refresh_at_once
from reelmart.scratch import scratch_folder, written
from reelmart.sinks.csv_files import write_csv
from reelmart.sinks.tables import append_rows, create_table, has_rows, replace_rows
from reelmart.sources.csv_files import (
    csv_column_kinds,
    read_csv,
    read_log_reviews,
    read_movie_reviews,
    read_stage_table,
    read_user_purchase,
    read_user_purchase_and_rejects,
)
from testbed import inputs

# Load date of the fact, fixed so that runs can be compared.
AS_OF = dt.date(2024, 6, 30)

Query = Callable[[SparkSession, str], DataFrame]


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_review_logs(inputs.log_reviews(spark, sf_dir))


def _staged_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(_logs(spark, sf_dir))


def _written_dimension(logs: DataFrame, name: str) -> DataFrame:
    return written(build_dimension(logs, name))


def _dims(logs: DataFrame) -> dict[str, DataFrame]:
    tables = together(*(partial(_written_dimension, logs, name) for name in DIMENSIONS))
    return dict(zip(DIMENSIONS, tables))


def _purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_user_purchase(inputs.user_purchase(spark, sf_dir))


def _reviews(spark: SparkSession, sf_dir: str, keyword: str = "good") -> DataFrame:
    return classify_reviews(inputs.movie_reviews(spark, sf_dir), keyword)


def _classify(keyword: str) -> Query:
    return lambda spark, sf_dir: _reviews(spark, sf_dir, keyword)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_scores(_reviews(spark, sf_dir, "data"))


def _dimension(name: str) -> Query:
    # The date dimension reads the log once; the others write their distinct keys.
    return lambda spark, sf_dir: build_dimension(_logs(spark, sf_dir), name)


def _dim_location_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _logs(spark, sf_dir).select("location").distinct()
    return number_by_ranges(keys, "location", "id_dim_location", ranges=8)


def _dim_lookup(spark: SparkSession, sf_dir: str, **limits: int) -> DataFrame:
    logs = _staged_logs(spark, sf_dir)
    ids = [id_col for _, id_col in DIMENSIONS.values()]
    return lookup_ids(logs, _dims(logs), **limits).select("log_id", *ids)


def _dim_lookup_by_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As with dimensions too large to broadcast; every device, system and place counts as hot.
    return _dim_lookup(spark, sf_dir, broadcast_bytes=0, hot_rows=0)


def _fact(spark: SparkSession, sf_dir: str, **limits: int) -> DataFrame:
    logs, reviews = together(
        lambda: _staged_logs(spark, sf_dir),
        lambda: written(_reviews(spark, sf_dir, "data")),
    )
    return build_fact(
        _purchases(spark, sf_dir), reviews, logs, _dims(logs), AS_OF, **limits
    )


def _fact_with_hot_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As with too many customers to broadcast. The 150 users hold more than one review in 500 each:
    # all of them are split.
    return _fact(spark, sf_dir, hot_rows=0, broadcast_bytes=0)


def _fact_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As with too many customers to broadcast, but few enough for a filter.
    return _fact(spark, sf_dir, broadcast_bytes=0, filter_bytes=FILTER_BYTES)


def _fact_over_buckets(spark: SparkSession, sf_dir: str, **limits: int) -> DataFrame:
    # Staged rows by customer and by review in eight buckets or so.
    logs, reviews, purchases = together(
        lambda: _staged_logs(spark, sf_dir),
        lambda: written(_reviews(spark, sf_dir, "data")),
        lambda: written(_purchases(spark, sf_dir)),
    )
    rows = {"rows_per_bucket": max(1, logs.count() // 8)}
    layout = lay_out(spark, _database(spark), purchases, reviews, logs, **rows, hot_rows=limits.get("hot_rows", HOT_ROWS))
    return build_fact_over(layout, _dims(logs), AS_OF, **limits)


def _fact_over_buckets_with_hot_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As with too many customers to broadcast; all users are kept out of the buckets and split.
    return _fact_over_buckets(spark, sf_dir, hot_rows=0, broadcast_bytes=0)


def _csv_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, stage = scratch_folder(spark), scratch_folder(spark)
    write_csv(inputs.log_reviews(spark, sf_dir), raw)
    write_csv(parse_review_logs(read_log_reviews(spark, raw)), stage, trim=True)
    return read_stage_table(spark, stage, "log_reviews_transformed")


def _csv_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, stage = scratch_folder(spark), scratch_folder(spark)
    write_csv(inputs.movie_reviews(spark, sf_dir), raw)
    write_csv(classify_reviews(read_movie_reviews(spark, raw), "data"), stage, trim=True)
    return read_stage_table(spark, stage, "classified_movie_reviews")


def _csv_review_text(spark: SparkSession, sf_dir: str, **limits: int) -> DataFrame:
    raw = scratch_folder(spark)
    write_csv(inputs.movie_reviews(spark, sf_dir), raw)
    return read_movie_reviews(spark, raw, **limits)


def _csv_large_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As with files too large for one task each.
    return _csv_review_text(spark, sf_dir, file_bytes_per_task=0)


def _csv_stray_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Whole lines as the only column, so that the writer leaves their quotes alone.
    reviews = inputs.reviews_with_stray_quotes(spark, sf_dir)
    field = F.when(
        F.col("id_review") % 2 == 0, F.col("review_str")
    ).otherwise(F.concat(F.lit('"'), F.replace("review_str", F.lit('"'), F.lit('""')), F.lit('"')))
    lines = reviews.select(F.concat_ws(",", "cid", field, "id_review").alias("cid,review_str,id_review"))
    raw = scratch_folder(spark)
    lines.write.option("header", True).option("sep", "\u0001").option("quote", "").csv(raw)
    return read_movie_reviews(spark, raw, file_bytes_per_task=0)


def _loaded_stage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = {name: scratch_folder(spark) for name in schemas.STAGE_TABLES}
    write_csv(_logs(spark, sf_dir), folders["log_reviews_transformed"], trim=True)
    write_csv(_reviews(spark, sf_dir, "data"), folders["classified_movie_reviews"], trim=True)
    write_csv(_purchases(spark, sf_dir), folders["user_purchase"])
    database = _database(spark)
    load_stage_tables(spark, database, folders)
    # One row per review with what its log and its user's purchases say: all three tables take part.
    purchases = spark.table(f"{database}.user_purchase").groupBy("customer_id").agg(F.count("*").alias("lines"))
    reviews = spark.table(f"{database}.classified_movie_reviews")
    logs = spark.table(f"{database}.log_reviews_transformed").select("log_id", "device")
    return (
        reviews.join(logs, F.col("review_id") == F.col("log_id"))
        .join(purchases, F.col("user_id") == F.col("customer_id"), "left")
        .select("review_id", "positive_review", "device", "lines")
    )


def _csv_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark)
    write_csv(_purchases(spark, sf_dir), path)
    return stage_user_purchase(read_user_purchase(spark, path))


def _database(spark: SparkSession) -> str:
    name = f"reelmart_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_folder(spark)}'")
    return name


def _purchase_table(spark: SparkSession, sf_dir: str) -> str:
    table = f"{_database(spark)}.user_purchase"
    create_table(spark, table, schemas.USER_PURCHASE, schemas.USER_PURCHASE_LENGTHS)
    return table


def _replaced_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _purchase_table(spark, sf_dir)
    purchases = _purchases(spark, sf_dir)
    append_rows(purchases, table)
    if has_rows(spark.table(table)):
        replace_rows(purchases, table)
    return spark.table(table)


def _appended_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = f"{_database(spark)}.dim_devices"
    create_table(spark, table, schemas.DIM_DEVICES)
    devices = build_dimension(_logs(spark, sf_dir), "dim_devices")
    append_rows(devices.select("device", "id_dim_devices"), table)
    return spark.table(table)


def _refreshed_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = _database(spark)
    build_warehouse(
        spark,
        database,
        inputs.log_reviews(spark, sf_dir),
        inputs.movie_reviews(spark, sf_dir),
        inputs.user_purchase(spark, sf_dir),
        as_of=AS_OF,
        keyword="data",
    )
    return spark.table(f"{database}.fact_movie_analytics")


def _csv_returns_and_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Lone carriage returns in compressed files that are read block by block.
    raw = scratch_folder(spark)
    reviews = inputs.movie_reviews(spark, sf_dir)
    writer = reviews.write.option("header", True).option("escape", '"').option("lineSep", "\r")
    writer.option("compression", "bzip2").csv(raw)
    return read_movie_reviews(spark, raw, file_bytes_per_task=0)


def _column_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Per column what its values are, and the type that holds them all.
    raw = scratch_folder(spark)
    write_csv(inputs.mixed_values(spark, sf_dir), raw)
    return csv_column_kinds(spark, raw).withColumn("kind", F.coalesce("kind", F.lit("none")))


def _inferred_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = scratch_folder(spark)
    write_csv(_purchases(spark, sf_dir), raw)
    return read_csv(spark, raw).withColumn("invoice_date", F.col("invoice_date").cast("timestamp_ntz"))


def _purchase_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = scratch_folder(spark)
    write_csv(inputs.rejected_purchase_lines(spark, sf_dir), raw)
    good, rejects = read_user_purchase_and_rejects(spark, raw)
    # All records, the good ones by what was read of them.
    read = F.concat_ws(",", "invoice_number", "detail", F.col("quantity").cast("string"), "country")
    return good.select(read.alias("record"), F.lit("none").alias("reason")).unionAll(
        rejects.select(F.col("value").alias("record"), "reason")
    )


def _refreshed_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Two refreshes: readers of the first one keep it while the second one is what others see.
    database = _database(spark)
    raw = inputs.log_reviews(spark, sf_dir), inputs.movie_reviews(spark, sf_dir), inputs.user_purchase(spark, sf_dir)
    refresh_at_once(spark, database, *raw, as_of=AS_OF, keyword="good")
    before = spark.table(f"{database}.fact_movie_analytics")
    refresh_at_once(spark, database, *raw, as_of=AS_OF, keyword="data")
    now = spark.table(f"{database}.fact_movie_analytics")
    return before.withColumn("seen", F.lit("before")).unionAll(now.withColumn("seen", F.lit("now")))


def _loaded_in_turn(spark: SparkSession, sf_dir: str) -> str:
    database = _database(spark)
    for load in range(inputs.LOADS):
        load_increment(spark, database, *inputs.arriving(spark, sf_dir, load), as_of=AS_OF, keyword="data")
    return database


def _incremental_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(f"{_loaded_in_turn(spark, sf_dir)}.fact_movie_analytics")


def _incremental_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The partial sums alone, merged load by load.
    stored = spark.createDataFrame([], CUSTOMER_TOTALS)
    for load in range(inputs.LOADS):
        _, reviews, purchases = inputs.arriving(spark, sf_dir, load)
        new = new_totals(stage_user_purchase(purchases), classify_reviews(reviews, "data"))
        stored = written(merged_totals(stored, new).withColumn("load_date", F.lit(AS_OF)).select(*CUSTOMER_TOTALS.names))
    return stored.drop("load_date")


def _extended_dimension(name: str) -> Query:
    """A stored table to which each load adds its new keys."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = f"{_database(spark)}.{name}"
        create_table(spark, table, schemas.WAREHOUSE_TABLES[name])
        for load in range(inputs.LOADS):
            logs = written(parse_review_logs(inputs.arriving(spark, sf_dir, load)[0]))
            # The second turn finds nothing new.
            for _ in range(2):
                append_rows(extend_dimension(spark.table(table), logs, name), table)
        return spark.table(table)

    return query


def catalogue() -> dict[str, Query]:
    return {
        "stage_user_purchase": _purchases,
        "row_count_gate": lambda spark, sf_dir: row_count_gate(_purchases(spark, sf_dir)),
        "customer_spend": lambda spark, sf_dir: customer_spend(_purchases(spark, sf_dir)),
        "review_tokens": lambda spark, sf_dir: review_tokens(inputs.movie_reviews(spark, sf_dir)),
        "classify_reviews": _classify("good"),
        "classify_reviews_data": _classify("data"),
        "classify_reviews_the": _classify("the"),
        "review_scores": _scores,
        "customer_review_spend": lambda spark, sf_dir: customer_review_spend(
            customer_spend(_purchases(spark, sf_dir)), _scores(spark, sf_dir)
        ),
        "parse_review_logs": _logs,
        "parse_review_logs_mixed": lambda spark, sf_dir: parse_review_logs(
            inputs.mixed_log_reviews(spark, sf_dir)
        ),
        "log_quality": lambda spark, sf_dir: log_quality(inputs.mixed_log_reviews(spark, sf_dir)),
        "dim_date": _dimension("dim_date"),
        "dim_devices": _dimension("dim_devices"),
        "dim_location": _dimension("dim_location"),
        "dim_location_by_ranges": _dim_location_by_ranges,
        "dim_os": _dimension("dim_os"),
        "dim_lookup": _dim_lookup,
        "dim_lookup_by_shuffle": _dim_lookup_by_shuffle,
        "fact_movie_analytics": _fact,
        "fact_with_hot_users": _fact_with_hot_users,
        "fact_prefiltered": _fact_prefiltered,
        "fact_over_buckets": _fact_over_buckets,
        "fact_over_buckets_hot_users": _fact_over_buckets_with_hot_users,
        "csv_review_logs": _csv_logs,
        "csv_movie_reviews": _csv_review_text,
        "csv_large_files": _csv_large_files,
        "csv_stray_quotes": _csv_stray_quotes,
        "csv_classified_reviews": _csv_reviews,
        "csv_user_purchase": _csv_purchases,
        "replace_user_purchase": _replaced_purchases,
        "append_dim_devices": _appended_devices,
        "load_stage_tables": _loaded_stage_table,
        "refresh_warehouse": _refreshed_fact,
        "csv_returns_and_blocks": _csv_returns_and_blocks,
        "csv_column_kinds": _column_kinds,
        "csv_inferred_purchases": _inferred_purchases,
        "purchase_rejects": _purchase_rejects,
        "refresh_at_once": _refreshed_at_once,
        "extend_dim_date": _extended_dimension("dim_date"),
        "extend_dim_location": _extended_dimension("dim_location"),
        "incremental_totals": _incremental_totals,
        "incremental_fact": _incremental_fact,
    }
