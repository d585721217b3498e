import random

import pytest
from pyspark.sql import functions as F

from reelmart.operators.skew import (
    _every_salt,
    _salts,
    _shared_out,
    balanced_join,
    hot_keys,
    numbered_rows,
    salts_of,
)
from reelmart.scratch import written
from testbed import inputs


def _rows(rng, n, hot, null_share=0.1):
    values = []
    for _ in range(n):
        draw = rng.random()
        values.append(None if draw < null_share else hot if draw < 0.45 else rng.randint(0, 400))
    return values


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    # equal rows on purpose: the payload repeats
    left = spark.createDataFrame([(k, "x") for k in _rows(rng, 3000, 7)], "lk long, lv string")
    right = spark.createDataFrame([(k, "y") for k in _rows(rng, 600, 9)], "rk long, rv string")
    unique = spark.createDataFrame([(k, k * 10) for k in range(0, 300)], "rk long, rv long")
    return written(left), written(right), written(unique)


def _bag(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def test_hot_keys_are_found_with_null(tables):
    left, _, _ = tables
    hot = hot_keys(left, "lk", "lv", hot_rows=100)
    assert hot["lk"] == {7: left.where("lk = 7").count(), None: left.where("lk IS NULL").count()}
    assert hot["lv"] == {"x": 3000}


def test_no_hot_key_is_missed_among_many_rare_ones(spark):
    # Twenty keys with 0.25 % of the rows each, among a million keys of one row.
    rows = spark.range(0, 1_000_000, 1, 16).selectExpr(
        "if(id % 400 < 20, -1 - id % 400 % 20, xxhash64(id)) AS k", "cast(id % 3 as string) AS s"
    )
    hot = hot_keys(written(rows), "k", "s", hot_rows=0)
    assert sorted(hot["k"]) == list(range(-20, 0))
    assert sorted(hot["s"]) == ["0", "1", "2"]


def test_small_tables_have_no_hot_keys(tables):
    assert hot_keys(tables[0], "lk") == {"lk": {}}


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("left_hot", [{}, {7: 1100}, {7: 1100, 9: 5, None: 300}, {None: 300}])
@pytest.mark.parametrize("right_hot", [{}, {9: 270}, {7: 2, 9: 270}])
def test_balanced_join_equals_plain_join(tables, how, left_hot, right_hot):
    left, right, _ = tables
    plain = left.join(right, F.col("lk") == F.col("rk"), how).select("lk", "lv", "rv")
    if how == "left" and right_hot:
        # A left row repeated per right salt could stay unmatched more than once.
        with pytest.raises(ValueError):
            balanced_join(left, right, "lk", "rk", how, left_hot, right_hot)
        return
    salted = balanced_join(
        numbered_rows(left), numbered_rows(right), "lk", "rk", how, left_hot, right_hot, hot_rows=100
    ).select("lk", "lv", "rv")
    assert _bag(salted) == _bag(plain)


def test_hot_rows_are_spread_over_the_tasks(spark, tables):
    left, _, unique = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        def largest(df):
            sizes = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
            return max(r["count"] for r in sizes)

        plain = left.join(unique, F.col("lk") == F.col("rk"))
        salted = balanced_join(numbered_rows(left), unique, "lk", "rk", left_hot={7: 1100}, hot_rows=20)
        rows = left.where("lk < 300").count()
        assert largest(plain) > 0.4 * rows
        assert largest(salted) < 0.3 * rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_partner_rows_are_repeated_as_the_count_asks(spark, tables):
    left, _, unique = tables
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2000)
    try:
        hot = hot_keys(left, "lk", hot_rows=200)["lk"]
        asked = -(-hot[7] // 200)
        joined = balanced_join(numbered_rows(left), unique, "lk", "rk", left_hot=hot, hot_rows=200)
        assert _bag(joined.select("lk", "rv")) == _bag(
            left.join(unique, F.col("lk") == F.col("rk")).select("lk", "rv")
        )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    salts = salts_of(hot, 200, 2000)
    assert salts[7] == asked < 10
    repeated = unique.withColumn("salt", _every_salt(_salts("rk", salts)))
    assert repeated.count() == unique.count() - 1 + asked
    assert salts_of({1: 10**9}, 200, 2000) == {1: 2000}
    left_salts, right_salts = _shared_out({7: 1500, 8: 3}, {7: 1000, 9: 4}, 2000)
    assert left_salts[7] * right_salts[7] <= 2000 and left_salts[8] == 3 and right_salts[9] == 4


def test_without_hot_keys_the_join_is_plain(tables):
    left, right, _ = tables
    plan = balanced_join(left, right, "lk", "rk")._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" not in plan and "Generate" not in plan


def test_other_join_types_are_refused(tables):
    with pytest.raises(ValueError):
        balanced_join(tables[0], tables[1], "lk", "rk", "full")


def test_purchase_lines_do_not_depend_on_which_keys_are_hot(spark):
    sf_dir = "/root/testdata/sf0.001"
    plain = inputs.user_purchase(spark, sf_dir)
    split = inputs.user_purchase(spark, sf_dir, hot_rows=0)
    assert "salt" in split._jdf.queryExecution().optimizedPlan().toString()
    assert _bag(split) == _bag(plain)
