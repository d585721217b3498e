"""Loads on top of a filled warehouse: each reads the new rows of the three inputs, and no old ones.

What a load leaves is a version of every table (see ``sinks.versions``), published in one step:

* staged tables, dimensions, ``log_ids`` and ``fact_links`` only grow; a load adds its rows to them. Ids
  stay: new keys are numbered after the stored ones.
* ``log_ids`` has the ids of each log, ``fact_links`` a row for each review and log that belong
  together, with the user. A load joins its new reviews with all logs, and its new logs with the old
  reviews; of the old ones two numbers per row are read.
* ``customer_totals`` has exact partial sums per customer. A load sums up its own lines and reviews and
  merges them with the sums before; sums of sums are the same in any order.

``fact_movie_analytics`` is a view that joins links with the totals, as totals of a customer change with
every load while links do not. After any number of loads its rows are those of a full refresh over all
the rows, but for the ids, which are numbered by load.
"""

from __future__ import annotations

import datetime as dt
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, LongType

from reelmart import schemas
from reelmart.operators.dims import DIMENSIONS, extend_dimension
from reelmart.operators.lookup import lookup_ids
from reelmart.operators.skew import HOT_ROWS, balanced_join, with_hot_keys
from reelmart.plans.together import together
from reelmart.plans.warehouse import Tables, stage, version_tables
from reelmart.scratch import cleared_scratch
from reelmart.sinks.versions import begin_version, create_versioned_tables, publish, published, read_up_to

_IDS = [(id_col, LongType()) for _, id_col in DIMENSIONS.values()]

LOG_IDS = schemas.table_of(("log_id", LongType()), *_IDS)
FACT_LINKS = schemas.table_of(("user_id", LongType()), *_IDS)
CUSTOMER_TOTALS = schemas.table_of(
    ("customer_id", LongType()),
    ("amount_spent", DecimalType(38, 3)),
    ("purchase_lines", LongType()),
    ("review_score", LongType()),
    ("review_count", LongType()),
    ("reviews", LongType()),
    ("load_date", DateType()),
)

GROWING = {
    **schemas.STAGE_TABLES,
    **{name: schemas.WAREHOUSE_TABLES[name] for name in DIMENSIONS},
    "log_ids": LOG_IDS,
    "fact_links": FACT_LINKS,
}
TABLES = {**GROWING, "customer_totals": CUSTOMER_TOTALS}

_FACT = "fact_movie_analytics"


def create_incremental_tables(spark: SparkSession, database: str) -> None:
    """The tables, empty, and the view of the fact, unless they are there already."""
    lengths = {"user_purchase": schemas.USER_PURCHASE_LENGTHS}
    create_versioned_tables(spark, database, TABLES, growing=GROWING, lengths=lengths)
    ids = ", ".join(f"links.{id_col}" for id_col, _ in _IDS)
    spark.sql(
        f"CREATE VIEW IF NOT EXISTS {database}.{_FACT} AS "
        f"SELECT links.user_id AS customerid, {ids}, CAST(totals.amount_spent AS DECIMAL(18,5)) AS amount_spent, "
        f"totals.review_score, totals.review_count, totals.load_date AS insert_date "
        f"FROM {database}.fact_links links JOIN {database}.customer_totals totals "
        f"ON links.user_id = totals.customer_id WHERE totals.purchase_lines > 0"
    )


def new_totals(purchases: DataFrame, reviews: DataFrame) -> DataFrame:
    """Partial sums of new lines and reviews, up to two rows per customer; rows without one count nowhere."""
    spent = (
        purchases.where("customer_id IS NOT NULL")
        .groupBy(F.col("customer_id").cast("bigint").alias("customer_id"))
        .agg(
            F.sum(F.col("quantity") * F.col("unit_price")).cast("decimal(38,3)").alias("amount_spent"),
            F.count("*").alias("purchase_lines"),
        )
    )
    scored = (
        reviews.where("user_id IS NOT NULL")
        .groupBy(F.col("user_id").alias("customer_id"))
        .agg(
            F.sum("positive_review").alias("review_score"),
            F.count("review_id").alias("review_count"),
            F.count("*").alias("reviews"),
        )
    )
    return spent.unionByName(scored, allowMissingColumns=True)


def merged_totals(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Sums of partial sums; a sum stays NULL until there is something to add up."""
    counts = ("purchase_lines", "reviews")
    both = stored.drop("load_date").unionByName(new)
    return both.groupBy("customer_id").agg(
        F.sum("amount_spent").cast("decimal(38,3)").alias("amount_spent"),
        *(F.sum(c).alias(c) for c in ("review_score", "review_count")),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts),
    )


def links_between(reviews: DataFrame, logs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """A row for each review and log of the same id; users, reviews and logs without one have none."""
    reviews, review_hot = with_hot_keys(
        reviews.where("user_id IS NOT NULL").select("user_id", "review_id"), "review_id", hot_rows=hot_rows
    )
    logs, log_hot = with_hot_keys(logs, "log_id", hot_rows=hot_rows)
    joined = balanced_join(
        reviews,
        logs,
        "review_id",
        "log_id",
        left_hot=review_hot["review_id"],
        right_hot=log_hot["log_id"],
        hot_rows=hot_rows,
    )
    return joined.select(*FACT_LINKS.names)


def _extend(tables: Tables, stored: DataFrame, logs: DataFrame, name: str) -> None:
    tables.write(extend_dimension(stored, logs, name), name)


def load_increment(
    spark: SparkSession,
    database: str,
    log_reviews: DataFrame,
    movie_reviews: DataFrame,
    user_purchase: DataFrame,
    as_of: dt.date | None = None,
    keyword: str = "good",
    date_format: str = "yyyy-MM-dd",
    fail_on_malformed: bool = False,
    hot_rows: int = HOT_ROWS,
) -> dict[str, int]:
    """Adds the new rows of the three inputs to the warehouse; any of them may be empty.

    Returns what was read and rejected of them, see ``stage``. Readers see the load as a whole or not
    at all. A load that dies is run again with the same inputs; one that was published must not be, as
    its rows would count twice.
    """
    create_incremental_tables(spark, database)
    current, _ = published(spark, database)
    version = begin_version(spark, database, TABLES)
    new = version_tables(spark, database, version)
    with cleared_scratch(spark):
        report = stage(
            new, log_reviews, movie_reviews, user_purchase, keyword, date_format, fail_on_malformed
        )
        logs, reviews = new.read("log_reviews_transformed"), new.read("classified_movie_reviews")
        together(
            *(
                partial(_extend, new, read_up_to(spark, database, name, current), logs, name)
                for name in DIMENSIONS
            )
        )
        dims = {name: read_up_to(spark, database, name, version) for name in DIMENSIONS}
        new.write(lookup_ids(logs, dims, hot_rows=hot_rows), "log_ids")

        old_reviews = read_up_to(spark, database, "classified_movie_reviews", current)
        links = links_between(reviews, read_up_to(spark, database, "log_ids", version), hot_rows).unionAll(
            links_between(old_reviews, new.read("log_ids"), hot_rows)
        )
        stored = spark.table(f"{database}.customer_totals")
        totals = merged_totals(stored, new_totals(new.read("user_purchase"), reviews)).withColumn(
            "load_date", F.lit(as_of) if as_of else F.current_date()
        )
        together(lambda: new.write(links, "fact_links"), lambda: new.write(totals, "customer_totals"))
    publish(spark, database, TABLES, version, growing=GROWING)
    return report
