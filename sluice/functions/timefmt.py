"""Event-time parsing and time-zone normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPTIONAL_FRACTION = "[.SSSSSS]"


def lenient_pattern(fmt: str) -> str:
    """Accept an optional fraction of a second after a pattern ending in seconds.

    Feeds written with ``isoformat()`` carry microseconds only when they are
    non-zero; a strict ``...HH:mm:ss`` pattern would reject them.
    """
    if fmt.endswith("ss") and "S" not in fmt:
        return fmt + OPTIONAL_FRACTION
    return fmt


def parse_timestamp(txt: Column, fmt: str) -> Column:
    """Parse with the source's pattern; unparseable text gives NULL."""
    return F.try_to_timestamp(txt, F.lit(lenient_pattern(fmt)))


def parse_date(txt: Column, fmt: str) -> Column:
    return F.to_date(parse_timestamp(txt, fmt))


def to_utc(ts: Column, zone: str | None) -> Column:
    """Normalise a naive local timestamp of ``zone`` to UTC."""
    if not zone or zone.upper() == "UTC":
        return ts
    return F.to_utc_timestamp(ts, zone)


def render(ts: Column, fmt: str) -> Column:
    return F.date_format(ts, fmt)
