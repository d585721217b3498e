"""Approximate nearest neighbours by projections indexed with kd-trees.

Vectors are scaled to length one, where the nearest by cosine is the nearest by distance, and projected
by seeded normal draws, which are stable: the squared projected distance over the squared true distance
follows a chi-square distribution with ``DIMENSIONS`` degrees of freedom. The index is one kd-tree per
shard of vectors over their projections. A query reads the leaves of a tree in the order of their
projected distance and verifies every vector in them on the original components, until the test holds:
the chi-square probability that a vector nearer than the last of its best would have been projected
within the distance reached so far is at least ``CONFIDENCE``.

Equal vectors are one entry of the index, with one id more than the neighbours asked for, the smallest: as
ties go to the smaller id, the others can never be found. Different vectors of one score are ranked by
their ids, in a shard as among shards. Shards hold ``SHARD`` entries and
meet queries in blocks of ``BLOCK``, so a task holds neither all vectors nor all queries.

Defined results: vectors that are NULL, empty, zero, or hold a NULL or a component that is not finite
take no part, nor do those of another length than the most frequent one, nor a NULL vec_id; of rows that
repeat a vec_id with equal vectors one is looked at; an empty table gives an empty result; a query gets
fewer rows where there are fewer candidates; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmart.scratch import written
from reelmart.shipping import ship_package

DIMENSIONS = 8
CONFIDENCE = 0.99
LEAF = 64
SHARD = 8_192
BLOCK = 2_048


def chi_square(x: np.ndarray | float) -> np.ndarray | float:
    """Distribution function with ``DIMENSIONS`` degrees of freedom, an even number."""
    half = np.asarray(x) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, DIMENSIONS // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def stop_ratio(confidence: float = CONFIDENCE) -> float:
    """The squared projected over squared true distance at which the test holds."""
    low, high = 0.0, 200.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle) < confidence else (low, middle)
    return high


def projection(components: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(components, DIMENSIONS))


def _dots(vectors: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Row by row in the same order of additions, so that equal rows give equal sums."""
    return (vectors * vector).sum(axis=1)


class Tree:
    """A kd-tree over projections, kept as its leaves with their bounds."""

    def __init__(self, points: np.ndarray):
        order = np.arange(len(points))
        parts = [order]
        while max(map(len, parts)) > LEAF:
            cut = []
            for part in parts:
                if len(part) <= LEAF:
                    cut.append(part)
                    continue
                inner = points[part]
                axis = int(np.argmax(inner.max(axis=0) - inner.min(axis=0)))
                middle = len(part) // 2
                split = np.argpartition(inner[:, axis], middle)
                cut += [part[split[:middle]], part[split[middle:]]]
            parts = cut
        self.leaves = parts
        self.low = np.array([points[p].min(axis=0) for p in parts])
        self.high = np.array([points[p].max(axis=0) for p in parts])

    def nearest_first(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by the squared distance of their bounds."""
        beyond = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        distance = (beyond**2).sum(axis=1)
        order = np.argsort(distance, kind="stable")
        return order, distance[order]


class Shard:
    """Entries of the index: vectors, each with the smallest id that has it."""

    def __init__(self, vectors: np.ndarray, first_ids: np.ndarray, seed: int = 7):
        self.vectors, self.first_ids = vectors, first_ids
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.matrix = projection(vectors.shape[1], seed)
        self.points = (vectors / self.norms[:, None]) @ self.matrix
        self.tree = Tree(self.points)

    def search(self, query: np.ndarray, wanted: int, ratio: float) -> list[tuple[float, int]]:
        """``(score, entry)`` of the best entries found, best first, ties by their smallest ids.

        Leaves are read on as long as they can hold an entry that is projected no farther than one of the
        best, so that what ties with these, as vectors of one direction do, is looked at as well.
        """
        norm = math.sqrt((query * query).sum())
        point = (query / norm) @ self.matrix
        order, reached = self.tree.nearest_first(point)
        entries = np.empty(0, np.int64)
        scores = np.empty(0)
        for leaf, distance in zip(order, reached):
            if len(scores) >= wanted:
                farthest = ((self.points[entries] - point) ** 2).sum(axis=1).max()
                # Equal points may differ in their last digits.
                if distance > max(ratio * max(0.0, 2 - 2 * scores[-1]), farthest * (1 + 1e-9) + 1e-12):
                    break
            part = self.tree.leaves[leaf]
            found = _dots(self.vectors[part], query) / (self.norms[part] * norm)
            scores = np.concatenate([scores, found])
            entries = np.concatenate([entries, part])
            best = np.lexsort((self.first_ids[entries], -scores))[:wanted]
            scores, entries = scores[best], entries[best]
        return list(zip(scores.tolist(), entries.tolist()))


def usable(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, vector)`` in double precision of the vectors that take part."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    sound = (F.size("vector") > 0) & F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists("vector", lambda x: x != 0)
    found = embeddings.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("vector")
    ).where(sound)
    lengths = found.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return found.where(F.size("vector") == (lengths[0] if lengths else 0))


def index_entries(vectors: DataFrame, wanted: int) -> DataFrame:
    """``(vector, ids)``: distinct vectors with their ``wanted`` + 1 smallest ids."""
    # Ranked before the shuffle as well, so a vector that many rows share leaves few of them.
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    return (
        vectors.withColumn("rank", rank)
        .where(F.col("rank") <= wanted + 1)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    )


def nearest(
    embeddings: DataFrame,
    queries: DataFrame,
    wanted: int = 5,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """Per query: query_id, rank (from 1), vec_id and score (cosine), nearest first.

    Both inputs have vec_id and embedding; a query is never its own neighbour.
    """
    ship_package(embeddings.sparkSession)
    entries = written(index_entries(usable(embeddings), wanted))
    asked = written(
        usable(queries)
        .groupBy("vec_id")
        .agg(F.max("vector").alias("vector"))
        .withColumnRenamed("vec_id", "query_id")
    )
    shards = max(1, math.ceil(entries.count() / SHARD))
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    ratio = stop_ratio(confidence)

    # Each shard meets each block of queries; hashes of the vectors and the ids share them out.
    sharded = entries.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    blocked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))
    )

    def search(index: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(index) and len(questions):
            ids = index["ids"].to_list()
            shard = Shard(np.stack(index["vector"].to_numpy()), np.array([own[0] for own in ids], np.int64))
            for query_id, vector in zip(questions["query_id"], questions["vector"]):
                # One more, as the query's own vector may be among them.
                for score, entry in shard.search(np.asarray(vector), wanted + 1, ratio):
                    rows += [(query_id, vec_id, score) for vec_id in ids[entry] if vec_id != query_id]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    found = (
        sharded.groupBy("shard", "block")
        .cogroup(blocked.groupBy("shard", "block"))
        .applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= wanted)
        .select("query_id", "rank", "vec_id", "score")
    )
