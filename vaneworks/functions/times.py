"""Time columns as numbers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_micros(time: Column) -> Column:
    """Microseconds of the wall clock of a ``timestamp_ntz``; hours that a time zone skips or repeats are hours like others."""
    wall = time.cast("timestamp_ntz")
    minutes = (F.unix_date(wall.cast("date")).cast("bigint") * 24 + F.hour(wall)) * 60 + F.minute(wall)
    seconds = F.expr("1000000").cast("decimal(8,0)") * F.extract(F.lit("SECOND"), wall)
    return minutes * 60_000_000 + seconds.cast("bigint")


def ntz(value: dt.datetime) -> Column:
    """A naive time of the driver as a ``timestamp_ntz``, whatever the driver's or the session's zone."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
