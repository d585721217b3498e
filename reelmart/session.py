"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Runtime re-planning: partition coalescing, broadcast switch, skewed sort-merge joins.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Overflow and bad casts raise instead of turning into NULL.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "reelmart", **conf: str) -> SparkSession:
    """Session with the settings above; ``conf`` (dots as ``__``) adds to or overrides them."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
