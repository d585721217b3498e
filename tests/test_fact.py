import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest

from reelmart.operators.dims import DIMENSIONS, build_dimension
from reelmart.operators.fact import build_fact
from reelmart.operators.purchases import (
    customer_review_spend,
    customer_spend,
    row_count_gate,
    stage_user_purchase,
)
from reelmart.operators.reviews import review_scores
from reelmart.schemas import FACT_MOVIE_ANALYTICS, USER_PURCHASE
from reelmart.scratch import written

AS_OF = dt.date(2024, 6, 30)
PURCHASE = "quantity int, unit_price decimal(8,3), customer_id int"
REVIEW = "user_id long, positive_review int, review_id long"
LOG = "log_id long, log_date date, device string, os string, location string, ip string, phone_number string"


def _data(seed):
    """A third of the reviews by one user, of the logs under one id; copies, gaps and NULLs."""
    rng = random.Random(seed)

    def key(hot, n):
        draw = rng.random()
        return None if draw < 0.05 else hot if draw < 0.38 else rng.randint(0, n)

    purchases = [
        (rng.randint(-3, 9), Decimal(rng.randint(0, 99999)) / 1000, key(5, 40)) for _ in range(300)
    ]
    reviews = [(key(5, 50), rng.randint(0, 1), key(8, 60)) for _ in range(150)]
    reviews += reviews[:20]
    logs = [
        (
            key(8, 60),
            rng.choice([None, dt.date(2021, 1, 1) + dt.timedelta(days=rng.randint(0, 20))]),
            rng.choice([None, "A", "B"]),
            rng.choice(["X", "Y"]),
            rng.choice([None, "Texas", "Texas", "Ohio"]),
            "ip",
            "tel",
        )
        for _ in range(120)
    ]
    return purchases, reviews, logs


def _brute_force(purchases, reviews, logs):
    spend, scores = defaultdict(Decimal), defaultdict(lambda: [0, 0])
    for quantity, price, customer in purchases:
        spend[customer] += quantity * price
    for user, positive, review in reviews:
        scores[user][0] += positive
        scores[user][1] += review is not None
    # column of the log row per dimension
    positions = {"dim_date": 1, "dim_devices": 2, "dim_location": 4, "dim_os": 3}
    ids = {}
    for name, place in positions.items():
        values = sorted({row[place] for row in logs}, key=lambda v: (v is not None, str(v)))
        ids[name] = {v: i + 1 for i, v in enumerate(values) if v is not None}
    rows = []
    for user, _, review in reviews:
        if user is None or review is None or user not in spend:
            continue
        for log in logs:
            if log[0] == review:
                found = [ids[name].get(log[positions[name]]) for name in DIMENSIONS]
                rows.append((user, *found, spend[user], *scores[user], AS_OF))
    return rows


@pytest.mark.parametrize("limits", [{}, {"hot_rows": 0}, {"hot_rows": 0, "broadcast_bytes": 0}])
@pytest.mark.parametrize("seed", [1, 2])
def test_fact_equals_brute_force(spark, seed, limits):
    purchases, reviews, logs = _data(seed)
    log_table = written(spark.createDataFrame(logs, LOG))
    dims = {name: written(build_dimension(log_table, name)) for name in DIMENSIONS}
    fact = build_fact(
        spark.createDataFrame(purchases, PURCHASE),
        written(spark.createDataFrame(reviews, REVIEW)),
        log_table,
        dims,
        AS_OF,
        **limits,
    )
    assert [(f.name, f.dataType) for f in fact.schema] == [
        (f.name, f.dataType) for f in FACT_MOVIE_ANALYTICS
    ]
    expected = _brute_force(purchases, reviews, logs)
    assert expected
    assert sorted(map(tuple, fact.collect()), key=str) == sorted(
        ((*r[:5], r[5].quantize(Decimal("0.00001")), *r[6:]) for r in expected), key=str
    )


def test_hot_users_are_split_only_where_totals_are_shuffled(spark):
    purchases, reviews, logs = _data(1)
    log_table = written(spark.createDataFrame(logs, LOG))
    dims = {name: written(build_dimension(log_table, name)) for name in DIMENSIONS}

    def plan(**limits):
        fact = build_fact(
            spark.createDataFrame(purchases, PURCHASE),
            written(spark.createDataFrame([(u, p, None) for u, p, _ in reviews], REVIEW)),
            log_table.withColumn("log_id", log_table.log_id * 0),
            dims,
            AS_OF,
            hot_rows=0,
            **limits,
        )
        return fact._jdf.queryExecution().executedPlan().toString()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastHashJoin [user_id" in plan()
        assert "_left_salt" not in plan()
        assert "Broadcast" not in plan(broadcast_bytes=0)
        assert "hashpartitioning(user_id#" in plan(broadcast_bytes=0)
        assert "_left_salt" in plan(broadcast_bytes=0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_load_date_is_today_unless_given(spark):
    log_table = written(spark.createDataFrame([(1, None, "A", "X", "Y", "", "")], LOG))
    dims = {name: written(build_dimension(log_table, name)) for name in DIMENSIONS}
    fact = build_fact(
        spark.createDataFrame([(1, Decimal("1.5"), 1)], PURCHASE),
        written(spark.createDataFrame([(1, 1, 1)], REVIEW)),
        log_table,
        dims,
    )
    today = spark.sql("SELECT current_date()").first()[0]
    assert abs((fact.first().insert_date - today).days) <= 1


def test_customer_without_reviews_or_purchases_is_dropped(spark):
    spend = customer_spend(
        spark.createDataFrame(
            [(2, Decimal("1.125"), 1), (0, Decimal("9"), 1), (-1, Decimal("0.5"), 2), (1, Decimal("1"), None)],
            PURCHASE,
        )
    )
    assert dict(spend.dtypes) == {"customer_id": "bigint", "amount_spent": "decimal(18,5)"}
    assert {r.customer_id: r.amount_spent for r in spend.collect()} == {
        1: Decimal("2.25"), 2: Decimal("-0.5"), None: Decimal("1"),
    }
    scores = review_scores(spark.createDataFrame([(1, 1, 1), (1, 0, 2), (3, 1, 3), (None, 1, 4)], REVIEW))
    assert customer_review_spend(spend, scores).collect() == [(1, Decimal("2.25"), 1, 2)]


def test_spend_beyond_the_declared_precision_raises(spark):
    purchases = spark.createDataFrame([(2_000_000_000, Decimal("99999.999"), 1)], PURCHASE)
    with pytest.raises(Exception, match="(?i)NUMERIC_VALUE_OUT_OF_RANGE|cannot be represented"):
        customer_spend(purchases).collect()


def test_spend_join_shuffles_each_side_once(spark):
    purchases = spark.createDataFrame([(1, Decimal("1"), 1)], PURCHASE)
    reviews = spark.createDataFrame([(1, 1, 1)], REVIEW)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = customer_review_spend(customer_spend(purchases), review_scores(reviews))
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("partial_sum") == 2


def _purchase(**values):
    row = {
        "invoice_number": "536365", "stock_code": "85123A", "detail": "lamp", "quantity": 6,
        "invoice_date": dt.datetime(2010, 12, 1, 8, 26), "unit_price": Decimal("2.550"),
        "customer_id": 17850, "country": "France",
    }
    return tuple({**row, **values}[f.name] for f in USER_PURCHASE)


def test_staging_types_and_lengths(spark):
    def staged(**values):
        return stage_user_purchase(spark.createDataFrame([_purchase(**values)], USER_PURCHASE)).first()

    assert staged() == _purchase()
    assert staged(country=None, detail="x" * 1000).country is None
    assert staged(country="y" * 20 + "  ").country == "y" * 20
    with pytest.raises(Exception, match="country is longer than 20"):
        staged(country="y" * 21)


def test_row_count_gate(spark):
    gate = row_count_gate(spark.range(3))
    assert gate.collect() == [(3, True)]
    assert row_count_gate(spark.range(0)).collect() == [(0, False)]
