"""Headered CSV folders, one part file per task."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, trim: bool = False) -> None:
    """Replaces ``path`` by the rows of ``df``; ``read_csv`` reads them back unchanged.

    ``trim`` cuts the blanks around text fields. The rows stay in the tasks that computed them:
    a single output file would send everything through one of them.
    """
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", trim)
        .option("ignoreTrailingWhiteSpace", trim)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
        .csv(path)
    )
