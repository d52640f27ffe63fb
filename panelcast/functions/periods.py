"""Month arithmetic on columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_period(label: Column | str) -> Column:
    """First day of the month named by a ``YYYY-MM`` (or ``YYYY-M``) label.

    A missing or malformed label fails the query, with ANSI mode on or off.
    """
    label = F.col(label) if isinstance(label, str) else label
    complaint = F.concat(F.lit("not a YYYY-MM period: "), F.coalesce(label, F.lit("null")))
    return F.coalesce(F.to_date(label, "yyyy-M"), F.raise_error(complaint).cast("date"))


def first_day(day: Column | str) -> Column:
    return F.trunc(day, "MM")


def period_end(day: Column | str) -> Column:
    return F.last_day(day)


def month_end(day: dt.date, months: int = 0) -> dt.date:
    """Last day of the month that lies ``months`` after that of ``day``."""
    count = day.year * 12 + day.month + months
    return dt.date(count // 12, count % 12 + 1, 1) - dt.timedelta(days=1)


def clock(as_of: dt.date | None) -> Column:
    """The reference day; the wall clock only when none is given."""
    return F.current_date() if as_of is None else F.lit(as_of)
