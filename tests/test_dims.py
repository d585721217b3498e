import datetime as dt
import random

import pytest

from reelmart.operators.dims import DIMENSIONS, build_dim, build_dim_date, build_dimension
from reelmart.operators.keys import dense_ids, number_by_ranges, number_in_one_task


def test_dim_date_seasons_and_null(spark):
    days = ["2021-12-31", "2021-01-15", "2021-02-28", "2021-03-01", "2021-05-31", "2021-06-01",
            "2021-08-31", "2021-09-01", "2021-11-30"]
    dates = [dt.date.fromisoformat(d) for d in days] + [None]
    logs = spark.createDataFrame([(d,) for d in dates * 3], "log_date date")
    rows = build_dim_date(logs).orderBy("id_dim_date").collect()
    assert [r.id_dim_date for r in rows] == list(range(1, 11))
    assert rows[0].asDict() == {
        "id_dim_date": 1, "log_date": None, "day": None, "month": None, "year": None, "season": "Fall",
    }
    assert [r.log_date for r in rows[1:]] == sorted(d for d in dates if d)
    assert [r.season for r in rows[1:]] == [
        "Winter", "Winter", "Spring", "Spring", "Summer", "Summer", "Fall", "Fall", "Winter",
    ]
    march = rows[3]
    assert (march.day, march.month, march.year) == ("01", "Mar", "2021")


def test_key_dimension_is_dense_and_keeps_null_first(spark):
    logs = spark.createDataFrame([(v,) for v in ["b", None, "a", "b", None, "B", ""]], "device string")
    rows = build_dim(logs, "device", "id_dim_devices").orderBy("id_dim_devices").collect()
    assert [tuple(r) for r in rows] == [(1, None), (2, ""), (3, "B"), (4, "a"), (5, "b")]


@pytest.mark.parametrize("name", list(DIMENSIONS))
def test_ids_are_64_bit(spark, name):
    key, id_col = DIMENSIONS[name]
    logs = spark.createDataFrame([], "log_date date, device string, os string, location string")
    assert dict(build_dimension(logs, name).dtypes)[id_col] == "bigint"


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_numbering_by_ranges_equals_one_task(spark, ranges):
    rng = random.Random(3)
    values = list({"".join(rng.choices("abcdé", k=rng.randint(0, 6))) for _ in range(500)}) + [None]
    rng.shuffle(values)
    keys = spark.createDataFrame([(v,) for v in values], "k string")
    expected = sorted(tuple(r) for r in number_in_one_task(keys, "k", "id").collect())
    found = sorted(tuple(r) for r in number_by_ranges(keys, "k", "id", ranges).collect())
    assert found == expected
    assert [r[0] for r in found] == list(range(1, len(values) + 1))


def test_many_keys_are_numbered_by_ranges(spark):
    keys = spark.range(0, 5000).selectExpr("cast(id as string) as k")
    numbered = dense_ids(keys, "k", "id", keys_per_task=600)
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan
    expected = {k: i + 1 for i, k in enumerate(sorted(str(n) for n in range(5000)))}
    assert {r.k: r.id for r in numbered.collect()} == expected
