"""Raw inputs as views over the supplied parquet tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmart.operators.lookup import sides_by_size
from reelmart.operators.skew import HOT_ROWS, balanced_join, with_hot_keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def movie_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 150).alias("cid"),
        F.col("text").alias("review_str"),
        F.col("doc_id").alias("id_review"),
    )


def reviews_with_stray_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews on one line each; those of even ids hold an inch mark and no comma."""
    flat = F.regexp_replace("review_str", "[\\r\\n]", " ")
    plain = F.concat(F.regexp_replace(flat, '[,"]', " "), F.lit(' 5" screen'))
    even = F.col("id_review") % 2 == 0
    return movie_reviews(spark, sf_dir).withColumn("review_str", F.when(even, plain).otherwise(flat))


def _element(name: str, value: Column) -> list[Column]:
    return [F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>")]


# Tasks per core that make documents and parse them.
_TASKS_PER_CORE = 4


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # A file's block, the least that a task reads, has so many small rows that a few tasks would make and
    # parse all documents: the rows are shared out, evenly and while they are small.
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    tasks = max(_TASKS_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return events.repartition(tasks).join(nation, F.col("n_nationkey") == F.col("user_id") % 25)


def _document(device: list[Column]) -> Column:
    moved = F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 365).cast("int"))
    return F.concat(
        F.lit("<reviewlog><log>"),
        *_element("logDate", F.date_format(moved, "yyyy-MM-dd")),
        *device,
        *_element("os", F.concat(F.lit("os_"), F.col("event_id") % 4)),
        *_element("location", F.col("n_name")),
        *_element("ipAddress", F.concat(F.lit("10.0.0."), F.col("user_id"))),
        *_element("phoneNumber", F.concat(F.lit("555-"), F.col("user_id"))),
        F.lit("</log></reviewlog>"),
    )


def log_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = _document(_element("device", F.col("event_type")))
    return _events(spark, sf_dir).select(F.col("event_id").alias("id_review"), document.alias("log"))


def mixed_log_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs that lack, repeat, pad or re-case the device, bear a doctype, or are broken, by event_id."""
    device = F.col("event_type")
    whole = _document(_element("device", device))
    forms = [
        whole,
        _document([]),
        _document([*_element("device", device), *_element("device", F.lit("second"))]),
        _document(_element("device", F.concat(F.lit("  "), device, F.lit(" ")))),
        _document(_element("Device", device)),
        _document([*_element("Device", F.lit("other")), *_element("device", device)]),
        whole.substr(F.lit(1), F.length(whole) - 15),
        F.concat(F.lit('<!DOCTYPE reviewlog [<!ENTITY e "v">]>'), whole),
        F.concat(whole, F.lit("<!-- end --> rest")),
        F.regexp_replace(whole, "<logDate>", "<logDate>on "),
    ]
    kind = F.col("event_id") % len(forms)
    log = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        log = F.when(kind == i, form).otherwise(log)
    return _events(spark, sf_dir).select(F.col("event_id").alias("id_review"), log.alias("log"))


def user_purchase(spark: SparkSession, sf_dir: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    buyers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))

    lineitem, line_hot = with_hot_keys(lineitem, "l_orderkey", "l_partkey", hot_rows=hot_rows)
    orders, order_hot = with_hot_keys(orders, "o_custkey", hot_rows=hot_rows)
    sides = sides_by_size({"lineitem": lineitem, "part": part, "buyers": buyers})
    # Orders, parts and customers are unique under their keys: only the other side can be hot.
    bought = balanced_join(
        orders, sides["buyers"], "o_custkey", "c_custkey", left_hot=order_hot["o_custkey"], hot_rows=hot_rows
    )
    lines = balanced_join(
        sides["lineitem"], bought, "l_orderkey", "o_orderkey", left_hot=line_hot["l_orderkey"], hot_rows=hot_rows
    )
    sold = balanced_join(
        lines, sides["part"], "l_partkey", "p_partkey", left_hot=line_hot["l_partkey"], hot_rows=hot_rows
    )
    return sold.select(
        F.col("l_orderkey").cast("string").alias("invoice_number"),
        F.col("l_partkey").cast("string").alias("stock_code"),
        F.col("p_name").alias("detail"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("invoice_date"),
        F.col("p_retailprice").cast("decimal(8,3)").alias("unit_price"),
        F.col("o_custkey").cast("int").alias("customer_id"),
        F.col("n_name").alias("country"),
    )


# Loads in which the rows arrive, one after the other.
LOADS = 3


def arriving(spark: SparkSession, sf_dir: str, load: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Logs, reviews and purchases of one load, from 0: ids in blocks of 100 in turn, purchases by year."""

    def block(column: str) -> Column:
        return F.floor(F.col(column) / 100) % LOADS == load

    return (
        log_reviews(spark, sf_dir).where(block("id_review")),
        movie_reviews(spark, sf_dir).where(block("id_review")),
        user_purchase(spark, sf_dir).where(F.year("invoice_date") % LOADS == load),
    )


def mixed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of orders whose values are of several kinds."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return orders.select(
        key.cast("string").alias("whole"),
        F.when(key % 10 == 0, key * 3_000_000_000).otherwise(key).cast("string").alias("large"),
        F.when(key % 10 == 1, F.concat(key.cast("string"), F.lit("." ), F.lit("25"))).otherwise(key.cast("string")).alias("fraction"),
        F.when(key % 10 == 2, F.concat(key.cast("string"), F.lit("0" * 20))).otherwise(key.cast("string")).alias("huge"),
        F.col("o_orderdate").cast("date").cast("string").alias("day"),
        F.when(key % 10 == 3, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("time"),
        F.when(key % 10 == 4, F.lit(None)).otherwise((key % 2 == 0).cast("string")).alias("flag"),
        F.when(key % 10 == 5, F.concat(F.lit("no, "), F.lit('"none"\n'), key)).otherwise(key.cast("string")).alias("text"),
        F.lit(None).cast("string").alias("nothing"),
    )


def rejected_purchase_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase lines as text: of every seven orders one has a word for a number, one too long a country,
    one no date, and the details of all hold quotes and a line break."""
    lines = user_purchase(spark, sf_dir)
    kind = F.col("invoice_number").cast("bigint") % 7
    date = F.date_format("invoice_date", "yyyy-MM-dd HH:mm:ss")
    changed = {
        "detail": F.concat("detail", F.lit(', "boxed"\nin two')),
        "quantity": F.when(kind == 1, F.lit("many")).otherwise(F.col("quantity").cast("string")),
        "country": F.concat("country", F.when(kind == 3, F.lit(" and its overseas territories")).otherwise("")),
        "invoice_date": F.concat(F.when(kind == 5, F.lit("on ")).otherwise(""), date),
    }
    return lines.select(*(changed.get(c, F.col(c)).cast("string").alias(c) for c in lines.columns))
