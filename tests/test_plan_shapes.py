"""What the optimizer makes of the registered queries."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from testbed.catalogue import catalogue

SF_DIR = "/root/testdata/sf0.001"


def _plan(spark, name):
    return catalogue()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


# Large CSV files, and those whose records need their places, are read line by line in Python, as batches.
BY_LINES = {
    "csv_large_files",
    "csv_stray_quotes",
    "csv_returns_and_blocks",
    "csv_column_kinds",
    "csv_inferred_purchases",
    "purchase_rejects",
}


@pytest.mark.parametrize("name", list(catalogue()))
def test_no_cross_join_no_python_no_row_loop(spark, name, monkeypatch):
    """Neither in what is returned nor in any frame that is written on the way."""
    plans = []
    write = DataFrameWriter.parquet

    def recorded(self, *args, **options):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    plans.append(_plan(spark, name))
    for plan in plans:
        for unwanted in ("CartesianProduct", "NestedLoop", "EvalPython", "InPandas", "Limit"):
            assert unwanted not in plan
        assert name in BY_LINES or "MapInArrow" not in plan


def _scan(plan, table):
    return next(x for x in plan.splitlines() if "FileScan" in x and f"/{table}.parquet" in x)


def _scanned(plan, table):
    return _scan(plan, table).split("ReadSchema: struct<")[1].rstrip(">")


def _pushed(plan, table):
    return set(_scan(plan, table).split("PushedFilters: [")[1].split("]")[0].split(", "))


def test_scans_read_only_the_columns_they_need(spark):
    plan = _plan(spark, "customer_spend")
    assert _scanned(plan, "lineitem") == "l_orderkey:bigint,l_partkey:bigint,l_quantity:double"
    assert _scanned(plan, "part") == "p_partkey:bigint,p_retailprice:double"
    assert _scanned(plan, "orders") == "o_orderkey:bigint,o_custkey:bigint"
    assert _pushed(plan, "orders") == {"IsNotNull(o_orderkey)", "IsNotNull(o_custkey)"}
    assert _pushed(plan, "lineitem") == {"IsNotNull(l_orderkey)", "IsNotNull(l_partkey)"}


def test_a_dimension_parses_each_document_once(spark):
    assert _plan(spark, "dim_date").count("from_xml(") == 1


def test_aggregates_combine_before_the_shuffle(spark):
    for name in ("customer_spend", "review_scores", "row_count_gate"):
        plan = _plan(spark, name)
        assert "partial_" in plan


def test_staging_is_narrow(spark):
    for name in ("parse_review_logs", "classify_reviews", "review_tokens"):
        plan = _plan(spark, name)
        assert "Exchange hashpartitioning" not in plan and "SinglePartition" not in plan


def test_logs_of_one_block_are_parsed_by_all_cores(spark):
    for name in ("parse_review_logs", "parse_review_logs_mixed"):
        rows = catalogue()[name](spark, SF_DIR).groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(rows) >= spark.sparkContext.defaultParallelism
        assert max(r["count"] for r in rows) <= 2 * min(r["count"] for r in rows)


def test_a_document_is_looked_at_once_by_xpath(spark):
    assert _plan(spark, "parse_review_logs_mixed").count("XPathStringEvaluator(") == 1
