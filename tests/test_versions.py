"""Versions of all tables at once: readers see the old warehouse or the new one, whenever a job dies."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from reelmart import schemas
from reelmart.operators.dims import DIMENSIONS, build_dimension, extend_dimension
from reelmart.plans import increments, warehouse
from reelmart.plans.increments import load_increment, merged_totals, new_totals
from reelmart.plans.warehouse import build_warehouse, refresh_at_once
from reelmart.sinks import versions
from reelmart.sinks.versions import begin_version, create_versioned_tables, publish, published, roll_back, write_version

AS_OF = dt.date(2024, 6, 30)
DAYS = [dt.date(2021, 1, 1) + dt.timedelta(days=d) for d in range(5)]


def _rows(seed, n=60):
    """Raw logs, reviews and purchases: a hot user and review, missing keys, users who buy nothing."""
    draw = random.Random(seed)

    def key(hot, most):
        chance = draw.random()
        return None if chance < 0.05 else hot if chance < 0.35 else draw.randint(0, most)

    def log():
        parts = {"logDate": draw.choice(DAYS), "device": draw.choice("ABC"), "os": draw.choice(["X", "Y"]),
                 "location": draw.choice(["Ohio", "Texas", f"Town {draw.randint(0, 9)}"]), "ipAddress": "ip", "phoneNumber": "tel"}
        if draw.random() < 0.2:
            del parts[draw.choice(["device", "location"])]
        text = "".join(f"<{k}>{v}</{k}>" for k, v in parts.items())
        return f"<reviewlog><log>{text}</log></reviewlog>" if draw.random() > 0.05 else "broken"

    logs = [(key(8, 40), log()) for _ in range(n)]
    reviews = [(key(5, 20), draw.choice(["so good", "bad", None]), key(8, 40)) for _ in range(n)]
    purchases = [(f"I{i}", "S", "detail", draw.choice([1, 3, -2, None]), dt.datetime(2020, 1, 1),
                  Decimal(draw.randint(0, 9_999)) / 1000, key(5, 12), "land") for i in range(n)]
    return logs, reviews, purchases


def _frames(spark, rows):
    logs, reviews, purchases = rows
    return (
        spark.createDataFrame(logs, schemas.LOG_REVIEWS),
        spark.createDataFrame(reviews, schemas.MOVIE_REVIEWS),
        spark.createDataFrame(purchases, schemas.USER_PURCHASE),
    )


def _contents(spark, database, names):
    return {name: sorted(map(str, spark.table(f"{database}.{name}").collect())) for name in names}


ALL = [*schemas.STAGE_TABLES, *schemas.WAREHOUSE_TABLES]


def test_refresh_at_once_equals_the_plain_refresh(spark, database):
    frames = _frames(spark, _rows(1))
    spark.sql(f"CREATE DATABASE {database}_plain LOCATION '{spark.conf.get('spark.checkpoint.dir')}/{database}_plain'")
    plain = build_warehouse(spark, f"{database}_plain", *frames, as_of=AS_OF)
    for _ in range(2):
        assert refresh_at_once(spark, database, *frames, as_of=AS_OF) == plain
        assert _contents(spark, database, ALL) == _contents(spark, f"{database}_plain", ALL)
    for name, schema in {**schemas.STAGE_TABLES, **schemas.WAREHOUSE_TABLES}.items():
        assert [(f.name, f.dataType) for f in spark.table(f"{database}.{name}").schema] == [(f.name, f.dataType) for f in schema]


class _Killed(Exception):
    pass


def _dies_after(monkeypatch, module, step, done):
    """Lets ``done`` writes pass and ends the job in the one after, whose rows are there already."""
    passed = []
    write = versions.write_version

    def counted(df, database, name, version):
        write(df, database, name, version)
        passed.append(name)
        if len(passed) > done:
            raise _Killed(name)

    monkeypatch.setattr(module, step, counted)
    return passed


def test_a_refresh_that_dies_anywhere_leaves_the_old_warehouse(spark, database, monkeypatch):
    refresh_at_once(spark, database, *_frames(spark, _rows(1)), as_of=AS_OF)
    before = _contents(spark, database, ALL)
    new = _frames(spark, _rows(2))
    for done in range(8):  # three staged tables, four dimensions, the fact
        with monkeypatch.context() as patch:
            passed = _dies_after(patch, warehouse, "write_version", done)
            with pytest.raises(_Killed):
                refresh_at_once(spark, database, *new, as_of=AS_OF)
        assert len(passed) > done
        assert _contents(spark, database, ALL) == before
    with monkeypatch.context() as patch:
        patch.setattr(versions, "_switch", lambda *args: (_ for _ in ()).throw(_Killed("switch")))
        with pytest.raises(_Killed):
            refresh_at_once(spark, database, *new, as_of=AS_OF)
    assert _contents(spark, database, ALL) == before
    refresh_at_once(spark, database, *new, as_of=AS_OF)
    after = _contents(spark, database, ALL)
    assert after != before
    assert all(len(versions._partitions(spark, database, name)) <= 2 for name in ALL)
    assert roll_back(spark, database) and _contents(spark, database, ALL) == before


def test_a_query_keeps_the_version_it_began_with(spark, database):
    names = {"a": schemas.DIM_OS, "b": schemas.DIM_DEVICES}
    create_versioned_tables(spark, database, names)
    seen = []
    for rows in (1, 2, 3):
        version = begin_version(spark, database, names)
        write_version(spark.range(rows).selectExpr("id AS id_dim_os", "'x' AS os"), database, "a", version)
        write_version(spark.range(rows).selectExpr("'y' AS device", "id AS id_dim_devices"), database, "b", version)
        publish(spark, database, names, version)
        if seen:
            assert [t.count() for t in seen[-1]] == [rows - 1, rows - 1]  # still there for one more version
        seen.append([spark.table(f"{database}.{name}") for name in names])
        assert [t.count() for t in seen[-1]] == [rows, rows]
    plan = seen[-1][0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version" in plan and "Subquery" not in plan


def test_tables_without_versions_are_refused(spark, database):
    build_warehouse(spark, database, *_frames(spark, _rows(1, 5)), as_of=AS_OF)
    with pytest.raises(ValueError, match="without versions"):
        refresh_at_once(spark, database, *_frames(spark, _rows(1, 5)), as_of=AS_OF)


def test_no_version_to_go_back_to(spark, database):
    create_versioned_tables(spark, database, {"a": schemas.DIM_OS})
    with pytest.raises(ValueError, match="no version"):
        roll_back(spark, database)
    assert published(spark, database) == (0, 0)


@pytest.mark.parametrize("name", list(DIMENSIONS))
def test_ids_stay(spark, name):
    key, id_col = DIMENSIONS[name]
    draw = random.Random(7)
    pool = [None, *DAYS] if name == "dim_date" else [None, "", "a", "b", "B", "é", "z"]
    logs = [spark.createDataFrame([(draw.choice(pool),) for _ in range(n)], f"{key} {'date' if name == 'dim_date' else 'string'}")
            for n in (3, 4, 30, 30)]
    stored = build_dimension(logs[0], name)
    ids = {r[key]: r[id_col] for r in stored.collect()}
    for more in logs[1:]:
        new = extend_dimension(stored, more, name)
        assert new.columns == stored.columns
        added = {r[key]: r[id_col] for r in new.collect()}
        assert not set(added) & set(ids)
        unseen = {r[0] for r in more.collect()} - set(ids)
        wanted = [None] * (None in unseen) + sorted(unseen - {None})
        assert added == {v: len(ids) + i + 1 for i, v in enumerate(wanted)}
        ids.update(added)
        stored = spark.createDataFrame(stored.unionAll(new).collect(), stored.schema)
        assert extend_dimension(stored, more, name).collect() == []
    assert sorted(ids.values()) == list(range(1, len(ids) + 1))


@pytest.mark.parametrize("seed,hot_rows", [(1, 5_000_000), (2, 0)])
def test_loads_in_turn_equal_one_refresh(spark, database, seed, hot_rows):
    parts = [_rows(10 * seed + i, n) for i, n in enumerate((40, 0, 30, 50))]
    for part in parts:
        load_increment(spark, database, *_frames(spark, part), as_of=AS_OF, hot_rows=hot_rows)
    whole = tuple([row for part in parts for row in part[i]] for i in range(3))
    spark.sql(f"CREATE DATABASE {database}_whole LOCATION '{spark.conf.get('spark.checkpoint.dir')}/{database}_whole'")
    build_warehouse(spark, f"{database}_whole", *_frames(spark, whole), as_of=AS_OF)
    assert _contents(spark, database, schemas.STAGE_TABLES) == _contents(spark, f"{database}_whole", schemas.STAGE_TABLES)

    def by_key(db):
        """The fact with keys in place of ids."""
        fact = spark.table(f"{db}.fact_movie_analytics")
        for name, (key, id_col) in DIMENSIONS.items():
            fact = fact.join(spark.table(f"{db}.{name}").select(id_col, key), id_col, "left").drop(id_col)
        return sorted(map(str, fact.select(*sorted(fact.columns)).collect()))

    assert by_key(database) == by_key(f"{database}_whole") != []
    for name, (key, id_col) in DIMENSIONS.items():
        mine = spark.table(f"{database}.{name}").collect()
        assert sorted(r[id_col] for r in mine) == list(range(1, len(mine) + 1))
        assert {r[key] for r in mine} == {r[key] for r in spark.table(f"{database}_whole.{name}").collect()}
    assert spark.table(f"{database}.fact_movie_analytics").dtypes == spark.table(f"{database}_whole.fact_movie_analytics").dtypes


def test_a_load_that_dies_is_run_again(spark, database, monkeypatch):
    first, second = _frames(spark, _rows(5, 30)), _frames(spark, _rows(6, 30))
    load_increment(spark, database, *first, as_of=AS_OF)
    names = [*increments.TABLES, "fact_movie_analytics"]
    before = _contents(spark, database, names)
    for done in (0, 3, 6, 8):
        with monkeypatch.context() as patch:
            _dies_after(patch, warehouse, "write_version", done)
            with pytest.raises(_Killed):
                load_increment(spark, database, *second, as_of=AS_OF)
        assert _contents(spark, database, names) == before
    load_increment(spark, database, *second, as_of=AS_OF)
    once = _contents(spark, database, names)
    spark.sql(f"CREATE DATABASE {database}_b LOCATION '{spark.conf.get('spark.checkpoint.dir')}/{database}_b'")
    for part in (first, second):
        load_increment(spark, f"{database}_b", *part, as_of=AS_OF)
    assert once == _contents(spark, f"{database}_b", names)


def test_a_load_reads_no_old_lines(spark, database):
    """The staged files of an earlier load can be away: purchases are never read again."""
    load_increment(spark, database, *_frames(spark, _rows(5, 30)), as_of=AS_OF)
    old = spark.table(f"{database}.user_purchase").inputFiles()
    assert old
    path = spark._jvm.org.apache.hadoop.fs.Path(old[0]).getParent()
    assert path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    logs, reviews, purchases = _rows(6, 30)
    load_increment(spark, database, *_frames(spark, (logs, reviews, purchases)), as_of=AS_OF)
    spent = spark.table(f"{database}.customer_totals").agg(F.sum("purchase_lines")).first()[0]
    both = _rows(5, 30)[2] + purchases
    assert spent == sum(p[6] is not None for p in both)


def test_partial_sums_merge_in_any_order(spark):
    parts = [_rows(20 + i, 25) for i in range(3)]
    new = []
    for _, reviews, purchases in parts:
        flags = [(u, None if t is None else int("good" in t), r) for u, t, r in reviews]
        new.append(new_totals(spark.createDataFrame(purchases, schemas.USER_PURCHASE),
                              spark.createDataFrame(flags, schemas.CLASSIFIED_MOVIE_REVIEWS)))
    empty = spark.createDataFrame([], increments.CUSTOMER_TOTALS)

    def merged(order):
        stored = empty
        for i in order:
            stored = merged_totals(stored, new[i]).withColumn("load_date", F.lit(AS_OF))
        return sorted(map(str, stored.collect()))

    assert merged([0, 1, 2]) == merged([2, 0, 1]) == merged([1, 2, 0])
