"""Calendar fields of the date dimension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of_month(date: Column) -> Column:
    """Two-digit day, ``05``."""
    return F.date_format(date, "dd")


def month_name(date: Column) -> Column:
    """Abbreviated English month, ``Sep``."""
    return F.date_format(date, "MMM")


def year_number(date: Column) -> Column:
    """Four-digit year, ``2021``."""
    return F.date_format(date, "yyyy")


def season(date: Column) -> Column:
    """Northern season by month; whatever is in no listed month, NULL included, is Fall."""
    month = F.month(date)
    return (
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer")
        .otherwise("Fall")
    )
