"""Date parsing and formatting as native expressions (no Python UDF)."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings
from .text import col_of


def parse_trial_date(c: str | Column) -> Column:
    """Date text -> date (op 2): drop every comma, squeeze blanks after a word, try
    'Month d yyyy', then 'Month yyyy' (first of the month), else null. Null stays null.
    ``try_to_timestamp`` never raises under ANSI mode, unlike ``to_date``."""
    s = F.regexp_replace(F.regexp_replace(col_of(c), ",", ""), r"(\S)\s+", "$1 ")
    return F.coalesce(
        F.try_to_timestamp(s, F.lit(settings.MONTH_DAY_YEAR)),
        F.try_to_timestamp(s, F.lit(settings.MONTH_YEAR)),
    ).cast("date")


def parse_dates(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace each named text column by its parsed date; one projection."""
    return df.withColumns({c: parse_trial_date(c) for c in cols})


def long_date(c: str | Column) -> Column:
    """'Month dd, yyyy' with a two-digit day (op 43)."""
    return F.date_format(col_of(c), settings.LONG_DATE)


def run_label(ts: str | Column, zone: str = "US/Eastern") -> Column:
    """UTC instant shown in a named zone as 'yyyy-MM-dd-HH:mm:ss-ZONE' (op 61).

    The zone abbreviation is the one of the offset in effect at that instant (standard or
    daylight time, by the rules of that year), since Spark's 'z' pattern prints the session zone instead."""
    utc = col_of(ts).cast("timestamp_ntz")
    # convert_timezone works on wall-clock (NTZ) values, so the session zone plays no part
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    offset_sec = F.timestamp_diff("SECOND", utc, local)
    abbr = F.lit(None).cast("string")
    for seconds, names in zone_abbreviations(zone).items():
        for until, name in reversed(names):
            here = offset_sec == F.lit(seconds)
            abbr = F.when(here if until is None else here & (utc < F.lit(until).cast("timestamp_ntz")), F.lit(name)).otherwise(abbr)
    sign = F.when(offset_sec < 0, F.lit("-")).otherwise(F.lit("+"))
    minutes = F.abs(offset_sec / 60).cast("int")
    shown = F.concat(sign, F.lpad((minutes / 60).cast("int").cast("string"), 2, "0"), F.lpad((minutes % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(local, "yyyy-MM-dd-HH:mm:ss"), F.lit("-"), F.coalesce(abbr, shown))


def zone_abbreviations(zone: str) -> dict[int, list[tuple[dt.datetime | None, str]]]:
    """UTC offset in seconds -> its abbreviations in the order of time, each with the UTC instant at which it gives way to the next
    (None: the last one), of any named zone: what the time zone database says from 1970 to 2037, looked at each half month (others are
    shown as +hhmm). An unknown zone raises ``ZoneInfoNotFoundError``."""
    info = ZoneInfo(zone)

    def at(t: dt.datetime) -> tuple[int, str]:
        shown = t.replace(tzinfo=dt.timezone.utc).astimezone(info)
        return int(shown.utcoffset().total_seconds()), shown.tzname()

    out: dict[int, list[tuple[dt.datetime | None, str]]] = {}
    seen: dict[int, dt.datetime] = {}                      # when an offset was last met
    for t in (dt.datetime(year, month, day) for year in range(1970, 2038) for month in range(1, 13) for day in (1, 15)):
        offset, name = at(t)
        names = out.setdefault(offset, [(None, name)])
        if names[-1][1] != name:
            low, high = seen[offset], t                    # the new name begins somewhere between
            while high - low > dt.timedelta(seconds=1):
                middle = low + (high - low) // 2
                low, high = (low, middle) if at(middle) == (offset, name) else (middle, high)
            names[-1] = (high.replace(microsecond=0), names[-1][1])
            names.append((None, name))
        seen[offset] = t
    return out


def todays_date() -> Column:
    """Today's date in the long form, as the date tool answers (op 43 with the clock)."""
    return long_date(F.current_date())
