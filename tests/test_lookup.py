import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from reelmart.operators.lookup import broadcastable, dimension_bytes, lookup_ids, sides_by_size
from reelmart.operators.skew import ROW
from reelmart.scratch import written
from testbed import inputs

DAY = dt.date(2021, 3, 1)


@pytest.fixture(scope="module")
def dims(spark):
    def table(rows, schema):
        return written(spark.createDataFrame(rows, schema))

    return {
        "dim_date": table([(1, DAY)], "id_dim_date long, log_date date"),
        "dim_devices": table([(1, None), (2, "A"), (3, "B")], "id_dim_devices long, device string"),
        "dim_location": table([(1, "Texas")], "id_dim_location long, location string"),
        "dim_os": table([(1, "X"), (2, "Y"), (9, "Y")], "id_dim_os long, os string"),
    }


def _logs(spark, rows):
    return written(
        spark.createDataFrame(rows, "log_id long, log_date date, device string, location string, os string")
    )


ROUTES = [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "hot_rows": 0}]


@pytest.mark.parametrize("limits", ROUTES)
def test_match_miss_and_null_keep_the_row(spark, dims, limits):
    rows = [(1, DAY, "A", "Texas", "X"), (2, None, None, "Ohio", None), (3, DAY, "B", None, "Q")] * 20
    found = lookup_ids(_logs(spark, rows), dims, **limits)
    assert ROW not in found.columns
    ids = found.select("log_id", "id_dim_date", "id_dim_devices", "id_dim_location", "id_dim_os")
    expected = [(1, 1, 2, 1, 1), (2, None, None, None, None), (3, 1, 3, None, None)] * 20
    assert sorted(map(tuple, ids.collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("limits", ROUTES)
def test_key_with_two_ids_fails_when_it_is_looked_up(spark, dims, limits):
    with pytest.raises(Exception, match="dim_os: more than one id_dim_os"):
        lookup_ids(_logs(spark, [(1, DAY, "A", "Texas", "Y")]), dims, **limits).collect()


def test_size_is_measured(dims):
    sizes = dimension_bytes(dims)
    assert sizes["dim_devices"] == 3 * 64 + 2
    assert sizes["dim_location"] == 64 + 5


def test_small_dimensions_are_broadcast_and_large_ones_are_not(spark, dims):
    logs = _logs(spark, [(1, DAY, "A", "Texas", "X")])

    def plan(**limits):
        frame = lookup_ids(logs, dims, **limits)
        return frame._jdf.queryExecution().executedPlan().toString()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert plan().count("BroadcastHashJoin") == 4
        assert "SortMergeJoin" not in plan()
        assert plan(broadcast_bytes=0).count("SortMergeJoin") == 4
        assert "Broadcast" not in plan(broadcast_bytes=0)
        for text in (plan(), plan(broadcast_bytes=0)):
            assert "NestedLoop" not in text and "Cartesian" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dimensions_share_one_bound():
    sizes = {"a": 50, "b": 30, "c": 40, "d": 10}
    assert broadcastable(sizes, 0) == set()
    assert broadcastable(sizes, 80) == {"d", "b", "c"}
    assert broadcastable(sizes, 130) == set(sizes)


def test_sides_that_are_large_but_for_their_files_are_not_broadcast(spark, tmp_path):
    """Two hundred thousand parts with long equal names: a small file, 30 MB at the driver."""
    tables = "/root/testdata/sf0.001"
    for table in ("customer", "lineitem", "nation", "orders"):
        os.symlink(f"{tables}/{table}.parquet", tmp_path / f"{table}.parquet")
    parts = spark.read.parquet(f"{tables}/part.parquet")
    more = spark.range(200_000).select(
        (F.col("id") + 1_000_000).alias("p_partkey"), F.lit("n" * 100).alias("p_name"), F.lit(1.0).alias("p_retailprice")
    )
    parts.select(*more.columns).unionAll(more).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    files = sum(f.stat().st_size for f in (tmp_path / "part.parquet").glob("*.parquet"))
    assert files < 4 * 1024 * 1024
    found, plain = inputs.user_purchase(spark, str(tmp_path)), inputs.user_purchase(spark, tables)

    def joins(frame):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.splitlines() if "Join [l_partkey" in line]

    assert ["SortMergeJoin" in line for line in joins(found)] == [True]
    assert ["BroadcastHashJoin" in line for line in joins(plain)] == [True]
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()


def test_text_counts_in_the_size_of_a_side(spark):
    side = written(spark.createDataFrame([(1, "abc"), (2, None)], "k long, t string"))
    other = side.select(F.col("k").alias("j"))

    def plan(limit):
        sides = sides_by_size({"a": side, "none": side.limit(0), "more": side.union(side)}, limit)
        joined = other.join(sides["a"], F.col("j") == F.col("k"))
        return joined._jdf.queryExecution().optimizedPlan().toString()

    assert "strategy=broadcast" in plan(2 * 64 + 3)
    assert "strategy=merge" in plan(2 * 64 + 2)
