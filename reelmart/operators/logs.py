"""Review log: XML documents to flat, typed rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from reelmart.functions import review_xml as xml


# What a CSV writer counts as blank: the space and every control character below it.
_BLANKS = "".join(map(chr, range(0x21)))


def parse_review_logs(
    raw: DataFrame,
    date_format: str = "yyyy-MM-dd",
    fail_on_malformed: bool = False,
    observation: Observation | None = None,
) -> DataFrame:
    """``(id_review, log)`` to the seven columns of ``log_reviews_transformed``.

    Each document is parsed once, in the scan's own stage. Fields are NULL without a document and for
    a malformed one, which fails the job with ``fail_on_malformed``; an element that a sound
    document lacks is an empty string. A date that does not follow ``date_format`` becomes NULL.
    ``observation`` counts what was rejected while the rows are computed, see ``log_quality``.
    """
    rows = _parsed_rows(raw, date_format, fail_on_malformed)
    if observation:
        rows = rows.observe(observation, *_quality())
    return rows.drop("_malformed", "_written_date")


def _parsed_rows(raw: DataFrame, date_format: str, fail_on_malformed: bool) -> DataFrame:
    document, simple = F.col("_document"), F.col("_simple")
    parsed = F.col("_parsed")

    def unless_simple(plain: Column, looked_at: Column) -> Column:
        """What the document's rarer forms ask for, at the price of a closer look, only where there may be one."""
        return F.when(simple, plain).otherwise(looked_at)

    malformed = unless_simple(xml.is_unreadable(parsed), xml.is_malformed(document, parsed))
    if fail_on_malformed:
        failure = F.raise_error(F.concat(F.lit("malformed document: "), document))
        malformed = F.when(malformed, failure.cast("boolean")).otherwise(malformed)
    plain = unless_simple(document, xml.plain_document(document))
    texts = (
        raw.select("id_review", xml.document_of(F.col("log")).alias("_document"))
        .withColumn("_simple", xml.is_simple(document))
        .withColumn("_parsed", xml.parsed_log(plain, fail_on_malformed))
        .select(
            F.col("id_review").alias("log_id"),
            "_document",
            "_simple",
            malformed.alias("_malformed"),
            unless_simple(F.lit(True), xml.has_review_root(document)).alias("_rooted"),
            unless_simple(F.lit(False), xml.needs_xpath(document)).alias("_by_xpath"),
            *(xml.first_text(parsed, name).alias(column) for name, column in xml.FIELDS.items()),
        )
    )
    by_xpath = {c: F.col("_by_xpath") | (F.col("_rooted") & xml.has_markup(F.col(c))) for c in xml.FIELDS.values()}
    looked_up = ~simple & ~F.col("_malformed") & reduce(or_, by_xpath.values())
    texts = texts.withColumn("_texts", F.when(looked_up, xml.texts_by_xpath(document)))
    fields = {}
    for i, column in enumerate(xml.FIELDS.values()):
        text = (
            F.when(simple, F.col(column))
            .when(by_xpath[column], F.get("_texts", F.lit(i)))
            .when(F.col("_rooted"), F.col(column))
        )
        fields[column] = F.when(~F.col("_malformed"), F.coalesce(text, F.lit("")))
    written_date = F.trim(fields["log_date"], F.lit(_BLANKS))
    fields["log_date"] = F.try_to_date(written_date, date_format)
    return texts.select(
        "log_id",
        *(value.alias(column) for column, value in fields.items()),
        F.col("_malformed"),
        written_date.alias("_written_date"),
    )


def _quality() -> list[Column]:
    unreadable = F.col("log_date").isNull() & (F.col("_written_date") != "")
    return [
        F.count("*").alias("total_logs"),
        F.count_if("_malformed").alias("malformed_logs"),
        F.count_if(unreadable).alias("unreadable_dates"),
        F.count_if(F.col("log_id").isNull()).alias("logs_without_id"),
    ]


def log_quality(raw: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """One row: all logs, malformed ones, dates that do not follow the format, logs without an id."""
    return _parsed_rows(raw, date_format, False).agg(*_quality())


def malformed_logs(raw: DataFrame) -> DataFrame:
    """One row: how many logs there are and how many of them are not readable as XML."""
    return log_quality(raw).select("total_logs", "malformed_logs")


def trimmed(df: DataFrame) -> DataFrame:
    """Text columns without surrounding blanks, as a staged CSV would hold them."""
    return df.select(
        *(
            F.trim(F.col(c), F.lit(_BLANKS)).alias(c) if kind == "string" else F.col(c)
            for c, kind in df.dtypes
        )
    )
