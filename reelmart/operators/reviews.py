"""Movie reviews: text to a positive flag, and totals per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmart.functions import text


def review_tokens(raw: DataFrame) -> DataFrame:
    """Token count and stop-word-free text of each review."""
    words = text.without_stop_words(F.col("_tokens"))
    return (
        raw.withColumnRenamed("id_review", "review_id")
        .withColumn("_tokens", text.tokens(F.col("review_str")))
        .select(
            "review_id",
            F.size("_tokens").alias("n_tokens"),
            F.concat_ws(" ", words).alias("review_clean_str"),
        )
    )


def classify_reviews(raw: DataFrame, keyword: str = "good") -> DataFrame:
    """``(cid, review_str, id_review)`` to ``(user_id, positive_review, review_id)``."""
    return (
        raw.withColumnRenamed("cid", "user_id")
        .withColumnRenamed("id_review", "review_id")
        .select(
            "user_id",
            text.mentions(F.col("review_str"), keyword).alias("positive_review"),
            "review_id",
        )
    )


def review_scores(classified: DataFrame) -> DataFrame:
    """Positive reviews and reviews with an id, per user."""
    return classified.groupBy("user_id").agg(
        F.sum("positive_review").alias("review_score"),
        F.count("review_id").alias("review_count"),
    )
