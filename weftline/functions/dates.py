"""Published date formats. Text that is no date is returned unchanged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import fixed


def _month(ts: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.month(ts))


def fmt_date(iso: Column, long_month: bool = False, zone: str = "UTC") -> Column:
    """Day, month name, year of an ISO timestamp in a zone."""
    # From the session zone, in which the cast reads it, to the wanted one.
    ts = F.convert_timezone(None, F.lit(zone), iso.try_cast("timestamp").cast("timestamp_ntz"))
    names = fixed.MONTHS_LONG if long_month else fixed.MONTHS_SHORT
    text = F.concat_ws(" ", F.dayofmonth(ts).cast("string"), _month(ts, names), F.year(ts).cast("string"))
    return F.when(ts.isNotNull(), text).otherwise(iso)


def iso_day(iso: Column) -> Column:
    """First ten characters of an ISO timestamp; "-" when there is none."""
    return F.coalesce(F.substring(iso, 1, 10), F.lit("-"))


def rfc822(day: Column) -> Column:
    return F.concat(F.date_format(day.try_cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
