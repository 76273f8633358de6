"""Timestamp parsing and event status (C1-C3) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexivec.config import END_MARKERS, START_MARKERS
from lexivec.functions.text import py_strip

# A value must start like an ISO date (or be a compact yyyyMMdd date) to be
# parsed at all; bare years and bare clock times are not dates.
ISO_DATE_PREFIX = r"^\d{4}-\d{1,2}-\d{1,2}"
COMPACT_DATE = r"^\d{8}$"
OFFSET_SUFFIX = r"(Z|[+-]\d{2}:?\d{2})$"


def parse_ts(v: Column, zone: str = "UTC") -> Column:
    """Text -> TIMESTAMP (an instant), or NULL.

    Values must start like an ISO date (``yyyy-M-d``, padded or not) or be a compact
    ``yyyyMMdd`` date. ISO forms go through Spark's own string-to-timestamp cast, a hand-written
    parser with no exception on failure: it accepts a space or ``T`` separator, fractions and
    ``Z`` / ``+hh:mm`` offsets, and rejects trailing garbage. Values with an offset are converted;
    naive values are wall time in ``zone``.
    """
    s = py_strip(v.cast("string"))
    s = F.when(s != "", s)
    has_off = s.rlike(OFFSET_SUFFIX)
    cast = s.try_cast("timestamp")  # naive text is read in the session zone (UTC)
    naive = cast if zone == "UTC" else F.to_utc_timestamp(cast, zone)
    compact = F.try_to_timestamp(s, F.lit("yyyyMMdd"))
    compact = compact if zone == "UTC" else F.to_utc_timestamp(compact, zone)
    return (
        F.when(s.rlike(COMPACT_DATE), compact)
        .when(s.rlike(ISO_DATE_PREFIX) & has_off, cast)
        .when(s.rlike(ISO_DATE_PREFIX), naive)
    )


def _marked(name: Column, markers: tuple[str, ...]) -> Column:
    low = F.lower(name)
    cond = None
    for m in markers:
        c = F.contains(low, F.lit(m))
        cond = c if cond is None else (cond | c)
    return cond


def pick_time(temporal: Column, markers: tuple[str, ...], zone: str) -> Column:
    """First parsable value among map entries whose key contains a marker (map order =
    schema order)."""
    entries = F.map_entries(temporal)
    parsed = F.transform(F.filter(entries, lambda e: _marked(e["key"], markers)), lambda e: parse_ts(e["value"], zone))
    return F.try_element_at(F.filter(parsed, lambda t: t.isNotNull()), F.lit(1))


def event_status(start: Column, end: Column, now: Column) -> Column:
    """Later rules override earlier ones, so the CASE checks them in reverse."""
    return (
        F.when(end.isNotNull() & (now > end), F.lit("completed"))
        .when(start.isNotNull() & end.isNotNull() & (start <= now) & (now <= end), F.lit("ongoing"))
        .when(start.isNotNull() & (now < start), F.lit("upcoming"))
    )


def status_of(temporal: Column, now: Column, zone: str = "UTC") -> Column:
    return F.when(
        temporal.isNotNull(),
        event_status(pick_time(temporal, START_MARKERS, zone), pick_time(temporal, END_MARKERS, zone), now),
    )
