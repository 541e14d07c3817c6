"""Durations in hours, their availability, and timestamp parsing. A missing input never gives a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str
AVAILABLE, UNAVAILABLE = "AVAILABLE", "UNAVAILABLE"


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hours_between(start: Col, end: Col, digits: int = 6) -> Column:
    """Signed hours from start to end (TM-01 to TM-03); null if either is null."""
    return F.round(F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(3.6e9), digits)


def availability(*inputs: Col) -> Column:
    """AVAILABLE if no input is null."""
    present = F.lit(True)
    for x in inputs:
        present &= _c(x).isNotNull()
    return F.when(present, AVAILABLE).otherwise(UNAVAILABLE)


def missing_inputs(**inputs: Col) -> Column:
    """Names of the null inputs, in the order given."""
    return F.array_compact(F.array(*[F.when(_c(c).isNull(), F.lit(name)) for name, c in inputs.items()]))


def target_variance(actual: Col, target: Col) -> Column:
    """TM-05."""
    return F.round(_c(actual) - _c(target), 6)


def early_delivery(delay: Col) -> tuple[Column, Column]:
    """TM-09: the negative delay, else 0, and its size."""
    early = F.least(_c(delay), F.lit(0.0))
    return F.when(_c(delay).isNotNull(), early), F.when(_c(delay).isNotNull(), F.abs(early))


def delay_share(delayed: Col, eligible: Col) -> Column:
    """TM-08: null for no eligible rows."""
    return F.round(F.try_divide(_c(delayed), F.nullif(_c(eligible), F.lit(0))), 4)


def signed_hours_text(hours: Col) -> Column:
    """TM-27: ``1h 30m (+1.50h)``, ``-1h 30m (-1.50h)``; a dash for null."""
    h = _c(hours)
    size = F.abs(h)
    whole = F.floor(size)
    minutes = F.round((size - whole) * 60).cast("int")
    text = F.format_string("%s%dh %dm (%s%.2fh)", F.when(h < 0, "-").otherwise(""), whole.cast("int"), minutes, F.when(h < 0, "-").otherwise("+"), size)
    return F.when(h.isNotNull(), text).otherwise("—")


#: Formats that parse_local accepts, tried in order.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "dd-MM-yyyy HH:mm", "dd-MM-yyyy", "dd MMM yyyy HH:mm", "dd MMM yyyy")


def parse_local(value: Col, zone: Col, formats: tuple[str, ...] = FORMATS) -> Column:
    """ING-09: a local time as UTC. Null for blanks, bare times, days and months that could be swapped, and unknown formats.

    In the hour that a zone repeats, the earlier instant is taken.
    """
    v = F.trim(_c(value))
    ambiguous = v.rlike(r"^(0?[1-9]|1[0-2])[/-](0?[1-9]|1[0-2])[/-]\d{2,4}")
    usable = (v != "") & ~v.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$") & ~ambiguous
    parsed = F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in formats])
    return F.when(usable, F.to_utc_timestamp(parsed, _c(zone)))


def excel_serial(value: Col) -> Column:
    """RC-04, ING-06: a 1900-system date serial as a timestamp, its day 60 that never was included."""
    v = _c(value).cast("double")
    days = F.when(v > 60, v - 1).otherwise(v)
    return F.timestamp_add("SECOND", F.round(days * 86400).cast("long"), F.lit("1899-12-31").cast("timestamp_ntz"))
