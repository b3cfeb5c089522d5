"""Calendar fields. Null stays null; dates before 1970 are right."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter,
    "weekday": F.weekday, "ordinal_day": F.dayofyear, "week": F.weekofyear,
}


def local_time(x: Column, zone: str) -> Column:
    """The wall time in a zone, of a UTC time without zone. A timestamp that has one comes first through `utc`."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), x)


def utc(x: Column) -> Column:
    """The UTC time of a timestamp with zone, as one without, whatever the session's zone; microseconds stay."""
    micros = F.unix_micros(x)
    day = 86_400_000_000
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / F.lit(day)).cast("int"))
    return date.cast("timestamp_ntz") + F.make_dt_interval(secs=(F.pmod(micros, F.lit(day)).cast("decimal(18,6)") / F.lit(1_000_000)).cast("decimal(18,6)"))


def field(x: Column, name: str, zone: str | None = None) -> Column:
    """weekday: 0 is Monday; week: ISO. zone: the field of the wall time there, of a UTC time without zone."""
    if name not in FIELDS:
        raise ValueError(f"no calendar field {name}; there are {', '.join(FIELDS)}")
    return FIELDS[name](local_time(x, zone) if zone else x).cast("int")


def with_fields(df: DataFrame, column: str, *names: str, zone: str | None = None) -> DataFrame:
    return df.withColumns({f"{column}_{n}": field(F.col(column), n, zone) for n in names})


def days(x: Column) -> Column:
    """Days since 1970-01-01, rounded down."""
    return F.datediff(F.to_date(x), F.lit("1970-01-01").cast("date"))


def on_or_after(x: Column, day: datetime.date) -> Column:
    """Whether a timestamp without zone lies on the day or later. The column stays bare, so the test reaches the scan."""
    return x >= F.lit(f"{day.isoformat()} 00:00:00").cast("timestamp_ntz")


def on_or_before(x: Column, day: datetime.date) -> Column:
    return ~on_or_after(x, day + datetime.timedelta(days=1))
