"""Multi-scale time. A position is an integer count of its scale's units from 1970; ages such as '66 MYA' are negative counts.

Literals of queries are worked out on the driver with exact Python integers; data columns have Column expressions.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALES = ("Gyr", "Myr", "Kyr", "year", "month", "day", "second", "ms", "ns")
ORDER = {s: k for k, s in enumerate(SCALES)}
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
_ALIASES = {alias: scale for scale, names in {
    "Gyr": "gyr gya by bya", "Myr": "myr mya", "Kyr": "kyr kya", "year": "year years y", "month": "month months", "day": "day days d",
    "second": "second seconds sec s", "ms": "ms millisecond milliseconds", "ns": "ns nanosecond nanoseconds",
}.items() for alias in names.split()}
_YEARS = {"Gyr": 10**9, "Myr": 10**6, "Kyr": 10**3, "year": 1}
_PER_DAY = {"day": 1, "second": 86_400, "ms": 86_400_000, "ns": 86_400 * 10**9}


class Point(NamedTuple):
    scale: str
    value: int


class Interval(NamedTuple):
    scale: str
    start: int
    end: int
    open_start: bool = False
    open_end: bool = False


def scale_of(name: str) -> str:
    try:
        return _ALIASES[str(name).strip().lower()]
    except KeyError:
        raise ValueError(f"unknown time scale {name!r}") from None


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days from 1970-01-01 in the proleptic Gregorian calendar, any year."""
    if not 1 <= m <= 12 or not 1 <= d <= month_length(y, m):
        raise ValueError(f"no such day: {y}-{m}-{d}")
    y -= m <= 2
    era, year_of_era = divmod(y, 400)
    day_of_year = (153 * (m - 3 if m > 2 else m + 9) + 2) // 5 + d - 1
    return era * 146_097 + year_of_era * 365 + year_of_era // 4 - year_of_era // 100 + day_of_year - 719_468


def month_length(y: int, m: int) -> int:
    return 29 if m == 2 and (y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)) else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]


def civil_from_days(n: int) -> tuple[int, int, int]:
    era, day_of_era = divmod(n + 719_468, 146_097)
    year_of_era = (day_of_era - day_of_era // 1460 + day_of_era // 36_524 - day_of_era // 146_096) // 365
    day_of_year = day_of_era - (365 * year_of_era + year_of_era // 4 - year_of_era // 100)
    k = (5 * day_of_year + 2) // 153
    m = k + 3 if k < 10 else k - 9
    return year_of_era + era * 400 + (m <= 2), m, day_of_year - (153 * k + 2) // 5 + 1


def _iso(text: str) -> datetime:
    d = datetime.fromisoformat(text)
    return d.replace(tzinfo=UTC) if d.tzinfo is None else d.astimezone(UTC)


def point(value) -> Point:
    """Scale and value of an endpoint as it is written: '1769', '2020-02', '20200229', '541 MYA', an ISO instant, milliseconds, or {scale, value}."""
    if isinstance(value, Point):
        return value
    if isinstance(value, dict):
        if not value.get("scale"):
            return point(value.get("value"))
        scale = scale_of(value["scale"])
        given = value.get("value")
        if isinstance(given, int) and not isinstance(given, bool):
            return Point(scale, given)
        return Point(scale, floor_to(point(given), scale))
    if isinstance(value, bool):
        raise ValueError("a truth value is no time")
    if isinstance(value, int):
        return Point("ms", value)
    if isinstance(value, datetime):
        at = value.replace(tzinfo=UTC) if value.tzinfo is None else value
        return Point("ms", (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1))
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"no time: {value!r}")
    text = value.strip()
    if m := re.fullmatch(r"(?i)(-?\d+)(?:\.\d+)?\s*(gya|gyr|bya|mya|myr|kya|kyr)", text):
        return Point(scale_of(m[2]), -int(m[1]))
    if re.fullmatch(r"-?\d{1,6}", text):
        return Point("year", int(text) - 1970)
    if re.fullmatch(r"\d{8}", text):
        return Point("day", days_from_civil(int(text[:4]), int(text[4:6]), int(text[6:])))
    if m := re.fullmatch(r"(-?\d{1,6})-(\d{2})", text):
        if not 1 <= int(m[2]) <= 12:
            raise ValueError(f"no such month: {text}")
        return Point("month", (int(m[1]) - 1970) * 12 + int(m[2]) - 1)
    if m := re.fullmatch(r"(-?\d{1,6})-(\d{2})-(\d{2})", text):
        return Point("day", days_from_civil(int(m[1]), int(m[2]), int(m[3])))
    try:
        ms = (_iso(text) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)
    except ValueError:
        raise ValueError(f"unknown time or scale: {value!r}") from None
    return Point("ms", ms) if "." in text else Point("second", ms // 1000)


def _to_year(scale: str, value: int) -> int:
    if scale == "month":
        return value // 12
    return civil_from_days(value // _PER_DAY[scale])[0] - 1970


def floor_to(p: Point, scale: str) -> int:
    """A point's value at the same or a coarser scale."""
    if p.scale == scale:
        return p.value
    if ORDER[p.scale] < ORDER[scale]:
        raise ValueError(f"{p.scale} is coarser than {scale}: that precision isn't there")
    if scale in _YEARS:
        years = p.value * _YEARS[p.scale] if p.scale in _YEARS else _to_year(p.scale, p.value)
        return years // _YEARS[scale]
    if scale == "month":
        y, m, _ = civil_from_days(p.value // _PER_DAY[p.scale])
        return (y - 1970) * 12 + m - 1
    return p.value // (_PER_DAY[p.scale] // _PER_DAY[scale])


def spread(scale: str, start: int, end: int, target: str) -> tuple[int, int]:
    """A range at another scale: coarser floors both ends, finer covers whole periods."""
    if ORDER[target] <= ORDER[scale]:
        return floor_to(Point(scale, start), target), floor_to(Point(scale, end), target)
    first, after = start, end + 1
    if scale in _YEARS:
        first, after, scale = first * _YEARS[scale], after * _YEARS[scale], "year"
        if target in _YEARS:
            return first // _YEARS[target], after // _YEARS[target] - 1
        first, after, scale = first * 12, after * 12, "month"
    if target == "month":
        return first, after - 1
    if scale == "month":
        first, after = (days_from_civil(v // 12 + 1970, v % 12 + 1, 1) for v in (first, after))
        scale = "day"
    factor = _PER_DAY[target] // _PER_DAY[scale]
    return first * factor, after * factor - 1


_OPEN_END = re.compile(r"(?i)\+?(?:∞|inf|infinity|ongoing|present)")
_OPEN_START = re.compile(r"(?i)-(?:∞|inf|infinity)")
#: Stands for an end that isn't given, as against None, which means open.
ABSENT = object()


def _open_side(value, side: str) -> str | None:
    if isinstance(value, dict):
        if "value" not in value:
            return None
        value = value["value"]
    if value is None:
        return side
    if isinstance(value, float):
        if value == float("inf"):
            return "end"
        if value == float("-inf"):
            return "start"
        if not value.is_integer():
            raise ValueError("times in numbers are whole milliseconds")
    if isinstance(value, str):
        if _OPEN_END.fullmatch(value.strip()):
            return "end"
        if _OPEN_START.fullmatch(value.strip()):
            return "start"
    return None


def interval(start, end=ABSENT) -> Interval:
    """An entry's interval: a missing end makes an instant, None an open side; a finer end is floored to the start's scale, a coarser one raises."""
    end = start if end is ABSENT else end
    a, b = _open_side(start, "start"), _open_side(end, "end")
    if a == "start" and b == "end":
        return Interval("year", LOWEST, HIGHEST, True, True)
    if a == "end" or b == "start":
        raise ValueError("an open interval ends in the future or begins in the past")
    if b == "end":
        p = point(start)
        return Interval(p.scale, p.value, HIGHEST, False, True)
    if a == "start":
        p = point(end)
        return Interval(p.scale, LOWEST, p.value, True, False)
    p, q = point(start), point(end)
    last = floor_to(q, p.scale)
    if p.value > last:
        raise ValueError("the interval ends before it begins")
    return Interval(p.scale, p.value, last)


def query_bounds(start, end=ABSENT) -> dict[str, tuple[int | None, int | None]]:
    """For each scale, the inclusive bounds a query range has there; None is unbounded, and bounds are clamped to 64 bits."""
    end = start if end is ABSENT else end
    a, b = _open_side(start, "start"), _open_side(end, "end")
    if a == "end" or b == "start":
        raise ValueError("an open range ends in the future or begins in the past")
    low = None if a else point(start)
    high = None if b else point(end)
    if low and high and low.scale != high.scale:
        coarse = min(low.scale, high.scale, key=ORDER.get)
        if ORDER[high.scale] < ORDER[low.scale]:
            raise ValueError(f"{high.scale} is coarser than {low.scale}: that precision isn't there")
        low, high = Point(coarse, floor_to(low, coarse)), Point(coarse, floor_to(high, coarse))
    if low and high and low.value > high.value:
        raise ValueError("the range ends before it begins")
    out = {}
    clamp = lambda v: max(LOWEST, min(HIGHEST, v))
    for s in SCALES:
        out[s] = (clamp(spread(low.scale, low.value, low.value, s)[0]) if low else None, clamp(spread(high.scale, high.value, high.value, s)[1]) if high else None)
    return out


def sort_key(p: Point) -> int:
    """Milliseconds from 1970 to the beginning of a point's period, exact however deep."""
    if p.value in (LOWEST, HIGHEST):
        return p.value
    return floor_to(p, "ms") if p.scale == "ns" else spread(p.scale, p.value, p.value, "ms")[0]


FRAMES = frozenset({"now", "today", "yesterday", "tomorrow", *(a + b for a in ("last", "this", "next") for b in ("Week", "Month", "Year", "Decade", "Century", "Millennium"))})


def frame(name: str, now: datetime | None = None) -> tuple[datetime, datetime]:
    """First and last millisecond of a named frame around `now` (UTC unless it has a zone of its own)."""
    if name not in FRAMES:
        raise ValueError(f"unknown time frame {name!r}")
    now = datetime.now(UTC) if now is None else now
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)

    def year(y):
        return day.replace(year=y, month=1, day=1)

    def month(k):
        y, m = divmod(day.year * 12 + day.month - 1 + k, 12)
        return day.replace(year=y, month=m + 1, day=1)

    if name == "now":
        begin = now.replace(minute=0, second=0, microsecond=0)
        after = begin + timedelta(hours=1)
    elif name in ("today", "yesterday", "tomorrow"):
        begin = day + timedelta(days={"yesterday": -1, "today": 0, "tomorrow": 1}[name])
        after = begin + timedelta(days=1)
    else:
        shift, unit = {"last": -1, "this": 0, "next": 1}[name[:4]], name[4:]
        if unit == "Week":
            begin = day + timedelta(days=7 * shift - day.weekday())
            after = begin + timedelta(days=7)
        elif unit == "Month":
            begin, after = month(shift), month(shift + 1)
        else:
            span = {"Year": 1, "Decade": 10, "Century": 100, "Millennium": 1000}[unit]
            first = day.year // span * span + shift * span
            begin, after = year(max(1, first)), year(first + span)
    return begin, after - timedelta(milliseconds=1)


def cells(start: int, end: int, scale: str) -> list[tuple[str, int]]:
    """The fewest whole periods that tile a range: coarse ones inside, finer ones at the ends. The floor is the range's own scale, a day at the finest."""
    if ORDER[scale] > ORDER["day"]:
        start, end, scale = floor_to(Point(scale, start), "day"), floor_to(Point(scale, end), "day"), "day"
    out: list[tuple[str, int]] = []
    floor = ORDER[scale]
    at = start
    while at <= end:
        for s in SCALES[: floor + 1]:
            v = floor_to(Point(scale, at), s)
            a, b = spread(s, v, v, scale)
            if a == at and b <= end:
                out.append((s, v))
                at = b + 1
                break
    return out


# -- columns


def timestamp_value(ts: Column, scale: str) -> Column:
    """A timestamp's value at a scale from year to ns."""
    micros = F.unix_micros(ts.cast("timestamp"))
    if scale == "year":
        return (F.year(ts) - 1970).cast("bigint")
    if scale == "month":
        return ((F.year(ts) - 1970) * 12 + F.month(ts) - 1).cast("bigint")
    if scale == "ns":
        return (micros * 1000).cast("bigint")
    unit = {"day": 86_400_000_000, "second": 1_000_000, "ms": 1000}[scale]
    return ((micros - F.pmod(micros, F.lit(unit))) / F.lit(unit)).cast("bigint") if unit > 1 else micros


def civil_days(year: Column, month: Column, day: Column) -> Column:
    """days_from_civil for columns of integers, any year."""
    y = year.cast("bigint") - F.when(month <= 2, 1).otherwise(0)
    yoe = F.pmod(y, F.lit(400))
    era = ((y - yoe) / 400).cast("bigint")
    mp = F.pmod(month + 9, F.lit(12))
    doy = F.floor((mp * 153 + 2) / 5) + day - 1
    return (era * 146_097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719_468).cast("bigint")


def sort_key_column(scale: Column, value: Column) -> Column:
    """sort_key for columns: milliseconds as DECIMAL(38,0), as deep time exceeds 64 bits."""
    dec = lambda c: c.cast("decimal(38,0)")
    v = dec(value)
    per_year = lambda y: dec(_year_days(y)) * dec(F.lit(86_400_000))
    months = F.floor(value / 12)
    month_days = civil_days(months + 1970, F.pmod(value, F.lit(12)) + 1, F.lit(1))
    out = F.when(value.isin(LOWEST, HIGHEST), v).when(scale == "ms", v).when(scale == "ns", dec(F.floor((value - F.pmod(value, F.lit(1_000_000))) / 1_000_000)))
    out = out.when(scale == "second", v * dec(F.lit(1000))).when(scale == "day", v * dec(F.lit(86_400_000)))
    out = out.when(scale == "month", dec(month_days) * dec(F.lit(86_400_000)))
    for s, n in _YEARS.items():
        out = out.when(scale == s, per_year(v * dec(F.lit(n))))
    return out.cast("decimal(38,0)")


def _year_days(y: Column) -> Column:
    """Days from 1970 to the first of January of year 1970 + y, for decimals."""
    d = lambda n: F.lit(n).cast("decimal(38,0)")
    # January belongs to the calendar year before in the March-based count
    whole = (y + d(1969)).cast("decimal(38,0)")
    below = lambda n: F.floor(whole.cast("decimal(30,0)") / F.lit(n).cast("decimal(8,0)")).cast("decimal(38,0)")
    return (whole * d(365) + below(4) - below(100) + below(400) + d(306) - d(719_468)).cast("decimal(38,0)")
