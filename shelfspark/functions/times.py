"""Time-zone independent handling of TIMESTAMP_NTZ values.

Event times in the tables are wall-clock values without a zone. Casting them to
TIMESTAMP goes through the session time zone; these helpers read them as UTC
instead, so results do not depend on how the session is configured."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")


def ntz_micros(c) -> Column:
    """Microseconds since 1970-01-01 00:00:00 of a TIMESTAMP_NTZ, read as UTC."""
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", _epoch(), col)


def ntz_to_instant(c) -> Column:
    """TIMESTAMP_NTZ -> TIMESTAMP instant (UTC reading); usable for watermarks."""
    return F.timestamp_micros(ntz_micros(c))


def instant_to_ntz(c) -> Column:
    """TIMESTAMP instant -> TIMESTAMP_NTZ wall-clock value in UTC."""
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_add("MICROSECOND", F.unix_micros(col), _epoch())
