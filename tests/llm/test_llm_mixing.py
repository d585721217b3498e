"""Mixing: water level against brute force, rows, edge rows."""

import random

import pytest
from llm_frames import documents, edge_rows, with_clashes

from reelmart.llm import mixing


def _brute_targets(sizes, weights, cap, total):
    clamped = set()
    while True:
        open_weight = sum(w for s, w in weights.items() if s not in clamped)
        rest = total - sum(sizes[s] * cap for s in clamped)
        share = {s: rest * w / open_weight for s, w in weights.items() if s not in clamped} if open_weight else {}
        above = {s for s, t in share.items() if t >= sizes[s] * cap}
        if not above:
            return {s: sizes[s] * cap if s in clamped else share[s] for s in sizes}
        clamped |= above


def test_water_level(spark):
    draw = random.Random(1)
    for _ in range(4):
        sizes = {f"s{i}": draw.choice([0, 1, 5, 50, 1000, 20_000]) for i in range(9)}
        weights = {s: float(draw.choice([1, 2, 5, 30])) for s in sizes}
        rows = [(s, sizes[s], weights[s]) for s in sizes]
        sources = spark.createDataFrame(rows, "source string, source_size bigint, weight double")
        level = mixing.water_level(sources, 3.0)
        expected = _brute_targets(sizes, weights, 3.0, sum(sizes.values()))
        found = {s: min(3.0 * sizes[s], level * weights[s]) for s in sizes}
        assert found == pytest.approx(expected)
        assert sum(found.values()) == pytest.approx(sum(sizes.values()))


def test_edge_rows(spark):
    docs = with_clashes(documents(spark))
    weights = mixing.cyclic_weights(docs, (5, 2, 1))
    named = {r.source: r.weight for r in weights.collect()}
    assert named == {"s1": 5, "s2": 2, "s3": 1, "s4": 5, "s5": 2, "s6": 1, "s7": 5, None: 2}
    mix = mixing.mix_sources(docs, weights, seed=3)
    rows = mix.collect()
    assert len(rows) == len(edge_rows())
    assert sorted(rows, key=str) == sorted(mixing.mix_sources(docs, weights, seed=3).collect(), key=str)
    for source in named:
        own = [r for r in rows if r.source == source]
        longest = max(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= longest / 2 + 1e-6
        assert all(r.taken == r.copies * r.size <= 3 * r.size for r in own)
        assert own[0].target <= 3 * own[0].source_size
    assert {r.size for r in rows if r.doc_id in (5, 6, 7, 8)} == {0}
    repeated = mixing.repeat_documents(docs, mix)
    assert repeated.columns == docs.columns
    by_id = {r.doc_id: r.copies for r in rows}
    counts = {r.doc_id: r["count"] for r in repeated.groupBy("doc_id").count().collect()}
    assert counts[9] == by_id[9] and counts.get(10, 0) == by_id[10]


def test_many_documents_meet_the_target(spark):
    draw = random.Random(2)
    rows = [(i, "w " * draw.randint(0, 9), "en", f"s{i % 3}", 0) for i in range(2_000)]
    docs = documents(spark, rows)
    weights = mixing.cyclic_weights(docs, (5, 2, 1))
    few, mixing.ROWS_IN_ORDER = mixing.ROWS_IN_ORDER, 40
    try:
        narrowed = mixing.mix_sources(docs, weights, seed=5).collect()
    finally:
        mixing.ROWS_IN_ORDER = few
    assert sorted(narrowed, key=str) == sorted(mixing.mix_sources(docs, weights, seed=5).collect(), key=str)
    for s in ("s0", "s1", "s2"):
        own = [r for r in narrowed if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 5


def test_empty_table_and_no_weights(spark):
    empty = documents(spark, [])
    assert mixing.mix_sources(empty, mixing.cyclic_weights(empty, (5, 2, 1))).collect() == []
    docs = documents(spark)
    none = spark.createDataFrame([("s1", 1.0)], "source string, weight double")
    rows = mixing.mix_sources(docs, none).collect()
    assert {r.source for r in rows if r.taken} == {"s1"}
