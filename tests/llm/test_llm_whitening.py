"""Whitening against exact integers and decompositions of known matrices."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from llm_frames import with_clashes
from pyspark.sql import functions as F

from reelmart.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>"


def _expected(rows):
    """Counts, deviations, eigenvalues and components of the remaining rows, by exact sums."""
    sound = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in sound]
    d = min(set(lengths), key=lambda k: (-lengths.count(k), k))
    xs = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in sound if len(v) == d]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(column) for column in zip(*fit)]
    deviation = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in xs]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return xs, n, sums, deviation, values[::-1], vectors[:, ::-1]


def _found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.component, []).append(r)
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_equals_brute_force(spark, parts):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1 + j) for j in range(6)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(300)]  # a third of all rows is one vector
    rows += [(1, rows[1][1]), (None, rows[3][1]), (900, None), (901, []), (902, [1.0] * 5 + [None])]
    rows += [(903, [math.nan] + [1.0] * 5), (904, [math.inf] * 6), (905, [1.0]), (906, [0.0] * 6)]
    draw.shuffle(rows)
    xs, n, sums, deviation, values, vectors = _expected(rows)
    table = with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(parts)
    found = _found(whitening.whitened_components(table, components=4))
    assert set(found) == {1, 2, 3, 4}
    for component, got in found.items():
        assert sorted((str(r.vec_id), r.deviation) for r in got) == sorted((str(i), d) for i, d in deviation)
        assert {r.n for r in got} == {n}
        assert got[0].explained == pytest.approx(values[component - 1] / values.sum(), rel=1e-12)
        assert 0 <= got[0].identity_error < 1e-12
        wanted = {
            str(i): (np.array(x) - np.array(sums) / n) @ vectors[:, component - 1] / math.sqrt(values[component - 1])
            for i, x in xs
        }
        sign = {round(math.copysign(1, r.whitened) * math.copysign(1, wanted[str(r.vec_id)])) for r in got
                if abs(r.whitened) > 1e-6}
        assert len(sign) == 1
        for r in got:
            assert r.whitened * next(iter(sign)) == pytest.approx(wanted[str(r.vec_id)], abs=1e-8)


def test_small_eigenvalues_keep_their_precision(spark):
    """Columns of a Hadamard matrix under scales of up to 2^36: eigenvalues are known, over 21 digits."""
    h = np.array([[1.0]])
    for _ in range(4):
        h = np.block([[h, h], [h, -h]])
    scales = 2.0 ** np.array([36, 30, 24, 18, 12, 6, 0])
    rows = [(i, [float(c) for c in h[i, 1:8] * scales]) for i in range(16)]
    found = _found(whitening.whitened_components(spark.createDataFrame(rows, SCHEMA)))
    variance = (64 * scales) ** 2
    assert set(found) == set(range(1, 8))
    for component, got in found.items():
        assert got[0].explained == pytest.approx(variance[component - 1] / variance.sum(), rel=1e-6)
        assert got[0].identity_error < 1e-6
        assert all(abs(r.whitened) == pytest.approx(1, abs=1e-6) for r in got)


def test_dependent_and_constant_dimensions(spark):
    draw = random.Random(5)
    rows = []
    for i in range(200):
        a, b = draw.randint(-99, 99), draw.randint(-99, 99)
        rows.append((i, [float(a), float(b), float(a + b), 7.0, 0.0]))
    found = _found(whitening.whitened_components(spark.createDataFrame(rows, SCHEMA)))
    assert set(found) == {1, 2}
    assert sum(got[0].explained for got in found.values()) == pytest.approx(1)
    assert found[1][0].identity_error < 1e-10


def test_few_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whitened_components(empty).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, [math.nan])], SCHEMA)
    assert whitening.whitened_components(nothing).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)
    assert whitening.whitened_components(one).collect() == []
    whole = whitening.whiten(one).collect()
    assert [(r.n, r.deviation, r.whitened) for r in whole] == [(1, 0, []), (1, 0, [])]
    two = whitening.whitened_components(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], SCHEMA)).collect()
    assert {r.vec_id: r.deviation for r in two} == {1: 128**2, 2: 128**2}
    assert sorted(round(abs(r.whitened), 9) for r in two) == [1.0, 1.0]


def test_numbers_beyond_64_bits():
    x = np.array([[2**40, 1], [-(2**40), 3]])
    deviation = whitening.deviations(x, 2**30, np.array([5, 7]))
    assert deviation.tolist() == [[2**70 - 5, 2**30 - 7], [-(2**70) - 5, 3 * 2**30 - 7]]
    assert whitening.squared_lengths(deviation) == [None, None]
    assert whitening.squared_lengths(np.array([[3, 4]])) == [25]


def test_triangular_solve():
    draw = np.random.default_rng(1)
    triangle = np.triu(draw.normal(size=(9, 9))) + 5 * np.eye(9)
    rows = draw.normal(size=(30, 9))
    assert np.allclose(whitening.divided(rows, triangle) @ triangle, rows)


def test_nothing_but_numbers_per_dimension_reaches_the_driver(spark):
    rows = spark.range(5_000).select(
        F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: F.randn(1) * j).alias("embedding")
    )
    fit = whitening.quantised(rows).select("x").distinct()
    assert len(whitening._sums(fit)) == 8
