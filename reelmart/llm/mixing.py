"""Mixing sources to target weights by capped water-filling.

Every source gets words in proportion to its weight, but no more than ``max_epochs`` passes over
what it has; the excess of clamped sources goes to the others by weight until none is above its cap.
Each document is then repeated a whole number of times, and one time more where it lies within the
fractional part of its source, taken in a seeded order. Only DataFrame operations are used.

Defined results: a NULL or blank text has size 0 and adds nothing; a NULL source is a source like
any other; a source without a weight, or of size 0, has the target 0; an empty table gives an empty
mix; repeated rows are separate documents that share their place in the seeded order, so the sum of
a source is the same whichever of them comes first. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmart.operators.keys import dense_ids
from reelmart.scratch import written

# A word: a run of characters other than blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"

# Rows of a source that one task puts in order.
ROWS_IN_ORDER = 50_000

# Hexadecimal digits of the order key by which the search for the last document goes on each time.
DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def order_key(seed: int, doc_id: Column) -> Column:
    """The seeded order of documents: 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def cyclic_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``(source, weight)``: distinct sources by code point, NULL last, weigh ``weights`` in turn."""
    distinct = sources.select("source").distinct()
    numbered = written(dense_ids(distinct.where("source IS NOT NULL"), "source", "place"))
    without = distinct.where("source IS NULL").select(
        F.lit(numbered.count() + 1).cast("bigint").alias("place"), "source"
    )
    turn = (F.col("place") - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))
    return numbered.union(without).select("source", weight.alias("weight"))


def water_level(sources: DataFrame, max_epochs: float, total: float | None = None) -> float:
    """Words per unit of weight at which the targets ``least(cap, level * weight)`` add up to ``total``.

    ``sources`` has ``source_size`` and ``weight``. Clamping a source only raises the level, so each
    round clamps more of them or is the last; a round is one small aggregate.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    if total is None:
        total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        above = cap <= F.lit(level) * F.col("weight")
        state = sources.where("weight > 0").agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)).alias("filled"),
            F.coalesce(F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count(F.when(above, 1)).alias("clamped"),
        ).first()
        if state["open"] == 0 or state["clamped"] == clamped:
            return level
        clamped = state["clamped"]
        level = (total - state["filled"]) / state["open"]


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _last_buckets(sized: DataFrame, sources: DataFrame, key: Column) -> DataFrame:
    """Per source the key prefix within which the fractional words run out.

    ``prefix`` and ``words_before`` (words of the source with smaller prefixes). The prefix grows by
    ``DIGITS`` digits a round, each round within the bucket of the round before, until no bucket has
    more than ``ROWS_IN_ORDER`` rows; so no task sees more than the buckets of one round.
    """
    found = written(
        sources.select(
            F.col("source").alias("its_source"),
            "rest",
            F.lit("").alias("prefix"),
            F.lit(0).cast("bigint").alias("words_before"),
            F.lit(None).cast("bigint").alias("rows"),
        )
    )
    digits = 0
    while True:
        digits += DIGITS
        buckets = (
            sized.join(found, _same("source", "its_source"))
            .where(F.substring(key, 1, digits - DIGITS) == F.col("prefix"))
            .groupBy("its_source", "rest", "words_before", F.substring(key, 1, digits).alias("bucket"))
            .agg(F.sum("size").alias("words"), F.count("*").alias("bucket_rows"))
        )
        earlier = (
            Window.partitionBy("its_source")
            .orderBy("bucket")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        begins = F.col("words_before") + F.coalesce(F.sum("words").over(earlier), F.lit(0))
        found = written(
            buckets.withColumn("begins", begins)
            .where(F.col("begins") <= F.col("rest"))
            .groupBy("its_source", "rest")
            .agg(F.max_by(F.struct("bucket", "begins", "bucket_rows"), "bucket").alias("last"))
            .select(
                "its_source",
                "rest",
                F.col("last.bucket").alias("prefix"),
                F.col("last.begins").alias("words_before"),
                F.col("last.bucket_rows").alias("rows"),
            )
        )
        most = found.agg(F.max("rows")).first()[0]
        if most is None or most <= ROWS_IN_ORDER or digits + DIGITS > 30:
            return found


def mix_sources(
    docs: DataFrame,
    weights: DataFrame,
    max_epochs: float = 3.0,
    total: float | None = None,
    seed: int = 0,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (words of its source), copies, taken.

    ``docs`` has doc_id, text and source, ``weights`` source and weight; columns of ``docs`` that are
    ``carried`` come last. The words taken of a source
    differ from its target by half of its longest document at most. ``copies`` is the number of
    times that the document goes into the mix, ``taken`` the words this makes.
    """
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carried))
    weighed = weights.select(F.col("source").alias("weighed"), "weight")
    sources = written(
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .join(weighed, _same("source", "weighed"), "left")
        .select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    )
    level = water_level(sources, max_epochs, total)
    target = F.least(
        F.col("source_size") * F.lit(float(max_epochs)), F.lit(level) * F.col("weight")
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    sources = written(
        sources.withColumn("target", target)
        .withColumn("whole", F.coalesce(whole, F.lit(0)).cast("bigint"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )

    key = order_key(seed, F.col("doc_id"))
    last = _last_buckets(sized, sources, key).select("its_source", "prefix", "words_before")
    of_source = sources.select(
        F.col("source").alias("one_source"), "source_size", "target", "whole", "rest"
    )
    placed = (
        sized.join(of_source, _same("source", "one_source"))
        .join(last, _same("source", "its_source"))
        .withColumn("place", F.substring(key, 1, F.length("prefix")))
    )
    # Documents of smaller prefixes fit whole, those of larger ones not; in between they are counted.
    clear = placed.where("place <> prefix").withColumn("more", F.expr("place < prefix"))
    before = (
        Window.partitionBy("source")
        .orderBy(key, "doc_id", "size", *carried)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    begins = F.col("words_before") + F.coalesce(F.sum("size").over(before), F.lit(0))
    edge = placed.where("place = prefix").withColumn(
        "more", begins + F.col("size") / F.lit(2.0) <= F.col("rest")
    )
    copies = F.col("whole") + F.expr("more AND rest > 0").cast("bigint")
    return clear.unionByName(edge).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
        *carried,
    )


def repeat_documents(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mix`` says (doc_id, copies).

    A document without a row in ``mix`` is left out; the copies of repeated doc_ids must agree, as
    those of one source do but for the edge of its fraction, where the larger number holds.
    """
    times = mix.groupBy(F.col("doc_id").alias("mixed_id")).agg(F.max("copies").alias("mixed_times"))
    return (
        docs.join(times, _same("doc_id", "mixed_id"))
        .where("mixed_times > 0")
        .withColumn("mixed_copy", F.explode(F.sequence(F.lit(1), F.col("mixed_times").cast("int"))))
        .select(*(docs[c] for c in docs.columns))
    )
