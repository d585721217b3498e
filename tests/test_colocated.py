"""The fact over bucketed tables: same rows, and no exchange of what is large."""

import pytest

from reelmart.operators.dims import DIMENSIONS, build_dimension
from reelmart.operators.fact import build_fact
from reelmart.plans.colocated import build_fact_over, lay_out
from reelmart.schemas import FACT_MOVIE_ANALYTICS
from reelmart.scratch import written
from tests.test_fact import AS_OF, LOG, PURCHASE, REVIEW, _data


def _tables(spark, seed):
    purchases, reviews, logs = _data(seed)
    return (
        written(spark.createDataFrame(purchases, PURCHASE)),
        written(spark.createDataFrame(reviews, REVIEW)),
        written(spark.createDataFrame(logs, LOG)),
    )


@pytest.mark.parametrize("limits", [{}, {"hot_rows": 0}, {"hot_rows": 0, "broadcast_bytes": 0}, {"broadcast_bytes": 0}])
@pytest.mark.parametrize("seed", [1, 2])
def test_same_rows_as_without_buckets(spark, database, seed, limits):
    purchases, reviews, logs = _tables(spark, seed)
    dims = {name: written(build_dimension(logs, name)) for name in DIMENSIONS}
    layout = lay_out(spark, database, purchases, reviews, logs, 40, limits.get("hot_rows", 5_000_000))
    assert bool(layout.logs.hot) == ("hot_rows" in limits)
    found = build_fact_over(layout, dims, AS_OF, **limits)
    expected = build_fact(purchases, reviews, logs, dims, AS_OF)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect())) != []
    assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in FACT_MOVIE_ANALYTICS]


def _plans(monkeypatch, run):
    """The plans of what ``run`` writes on the way, and of what it returns."""
    from pyspark.sql import DataFrameWriter

    plans = []
    write = DataFrameWriter.parquet

    def recorded(self, *args, **options):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    result = run()
    return plans, result._jdf.queryExecution().executedPlan().toString()


def test_large_sides_are_not_exchanged(spark, database, monkeypatch):
    purchases, reviews, logs = _tables(spark, 1)
    dims = {name: written(build_dimension(logs, name)) for name in DIMENSIONS}
    layout = lay_out(spark, database, purchases, reviews, logs, 40)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with large tables
    try:
        (totals,), fact = _plans(monkeypatch, lambda: build_fact_over(layout, dims, AS_OF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Sums per customer and their join, bucket by bucket.
    assert "Exchange" not in totals and totals.count("SelectedBucketsCount: 8 out of 8") == 2
    # Exchanges are those of the broadcast dimensions and totals only; reviews and logs join as they lie.
    assert "SortMergeJoin" in fact and fact.count("SelectedBucketsCount: 5 out of 5") == 2
    for line in fact.splitlines():
        if "Exchange hashpartitioning" in line:
            assert any(f"hashpartitioning(_key" in line or f"hashpartitioning({key}" in line for key, _ in DIMENSIONS.values())


def test_one_file_per_bucket(spark, database):
    purchases, reviews, logs = _tables(spark, 1)
    layout = lay_out(spark, database, purchases.repartition(6), reviews, logs, 40)
    assert len(layout.purchases.buckets.inputFiles()) <= 8
    again = lay_out(spark, database, purchases, reviews, logs, 40)
    assert again.purchases.buckets.count() == purchases.where("customer_id IS NOT NULL").count()
