"""Calendar columns as plain expressions: no join, no UDF, all inside codegen."""

from __future__ import annotations

import math
from datetime import date

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

CALENDAR_COLUMNS = [
    "hour", "day", "month", "week", "quarter", "day_of_week", "day_of_year", "season",
    "is_weekend", "hour_sin", "hour_cos", "month_sin", "month_cos", "dow_sin", "dow_cos",
    "is_holiday", "hour_is_weekend",
]

# German national holidays as (month, day), offsets from Easter Sunday in
# days, and single-year dates as (year, month, day).
FIXED_HOLIDAYS = [(1, 1), (5, 1), (10, 3), (12, 25), (12, 26)]
EASTER_OFFSETS = [-2, 1, 39, 50]
SINGLE_HOLIDAYS = [(2017, 10, 31)]


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since 1970, for TIMESTAMP and TIMESTAMP_NTZ alike (UTC session)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def easter_day_of_year(year: int) -> int:
    """Day of the year of Gregorian Easter Sunday, by the anonymous algorithm."""
    golden, (century, rest) = year % 19, divmod(year, 100)
    epact = (golden * 19 + century - century // 4 - (century - (century + 8) // 25 + 1) // 3 + 15) % 30
    weekday = (32 + (century % 4) * 2 + rest // 4 * 2 - epact - rest % 4) % 7
    month, day = divmod(epact + weekday - (golden + epact * 11 + weekday * 22) // 451 * 7 + 114, 31)
    return date(year, month, day + 1).timetuple().tm_yday


# From the calendar's first full year to the last for which the rule was made.
FIRST_YEAR, LAST_YEAR = 1583, 4099


def easter_offset(day: Column) -> Column:
    """Days since that year's Easter Sunday; null outside the covered years. The table is
    one constant array, where the algorithm as nested columns would repeat its terms."""
    days = [easter_day_of_year(y) for y in range(FIRST_YEAR, LAST_YEAR + 1)]
    table = F.lit(np.array(days, dtype="int32"))  # one literal, not one per year
    return F.dayofyear(day) - F.get(table, F.year(day) - FIRST_YEAR)


def is_holiday(ts: Column, country: str = "DE") -> Column:
    """1 on a national holiday, else 0. Only the German calendar is built in."""
    if country != "DE":
        raise ValueError(f"no holiday calendar for {country!r}")
    day = ts.cast("date")
    month_day = F.month(day) * 100 + F.dayofmonth(day)
    flag = month_day.isin([m * 100 + d for m, d in FIXED_HOLIDAYS])
    flag = flag | F.coalesce(easter_offset(day).isin(EASTER_OFFSETS), F.lit(False))
    flag = flag | day.isin([date(*d) for d in SINGLE_HOLIDAYS])
    return flag.cast("int")


def calendar_columns(ts: Column, *, holidays: bool = True, country: str = "DE") -> dict[str, Column]:
    """All calendar features by name."""
    hour, month, dow = F.hour(ts), F.month(ts), F.weekday(ts)
    weekend = (dow >= 5).cast("int")

    def cycle(part: Column, period: int, fn) -> Column:
        return fn(F.lit(2 * math.pi) * part / F.lit(float(period)))

    return {
        "hour": hour,
        "day": F.dayofmonth(ts),
        "month": month,
        "week": F.weekofyear(ts),
        "quarter": F.quarter(ts),
        "day_of_week": dow,
        "day_of_year": F.dayofyear(ts),
        "season": F.floor((month % 12) / 3).cast("int"),
        "is_weekend": weekend,
        "hour_sin": cycle(hour, 24, F.sin),
        "hour_cos": cycle(hour, 24, F.cos),
        "month_sin": cycle(month, 12, F.sin),
        "month_cos": cycle(month, 12, F.cos),
        "dow_sin": cycle(dow, 7, F.sin),
        "dow_cos": cycle(dow, 7, F.cos),
        "is_holiday": is_holiday(ts, country) if holidays else F.lit(0),
        "hour_is_weekend": hour * weekend,
    }
