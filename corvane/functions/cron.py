"""Times of five-field cron rules (minute, hour, day of month, month, day of week), in UTC.

Fields hold `*`, numbers, ranges, lists and steps, months and days of the week their first three letters too; 7 is Sunday. A range whose end
is before its start goes over the end of the field. Of the days of a month, `L` is the last, `L-3` the third before it, `15W` the weekday nearest to the
15th within the month, and `LW` the last weekday. Of the days of the week, `5L` is the month's last Friday and `5#2` its second. `?` is `*` in either field
of days. A day must fit the day of month, the month and the day of week alike. `@hourly` and the like stand for whole rules. Malformed rules
have no times.
"""

from __future__ import annotations

import re
from calendar import monthrange
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Years that are looked through; every rule that ever fits fits within a leap cycle, but for days of the week on a leap day.
HORIZON = 29
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_DAYS = "sun mon tue wed thu fri sat".split()
_FIELDS = ((0, 59, [], 0), (0, 23, [], 0), (1, 31, [], 1), (1, 12, _MONTHS, 1), (0, 7, _DAYS, 0))
#: Names of whole rules.
_MACROS = {
    "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *", "@every_minute": "* * * * *",
}


def _number(text: str, names: list[str], first: int) -> int:
    if text in names:
        return names.index(text) + first
    if not re.fullmatch("[0-9]+", text):
        raise ValueError(text)
    return int(text)


def _allowed(parts: list[str], low: int, high: int, names: list[str], first: int) -> set[int]:
    out: set[int] = set()
    for part in parts:
        span, slash, step = part.partition("/")
        if span == "*":
            a, b = low, high
        else:
            start, dash, end = span.partition("-")
            a = _number(start, names, first)
            b = _number(end, names, first) if dash else high if step else a
        by = _number(step, [], 0) if slash else 1
        if not (low <= a <= high and low <= b <= high) or by < 1:
            raise ValueError(part)
        # A Sunday is 0 and 7, so a range over the end of the week goes on at Monday.
        out.update(range(a, b + 1, by) if a <= b else [low + (x - low) % (7 if names is _DAYS else high - low + 1) for x in range(a, b + (7 if names is _DAYS else high - low + 1) + 1, by)])
    return out


@dataclass
class Rule:
    minutes: set[int]
    hours: set[int]
    months: set[int]
    days: set[int] = field(default_factory=set)
    before_last: set[int] = field(default_factory=set)  # days before a month's last
    near: set[int] = field(default_factory=set)  # days whose nearest weekday is meant
    last_weekday: bool = False
    weekdays: set[int] = field(default_factory=set)
    last_of: set[int] = field(default_factory=set)  # days of the week whose last in a month is meant
    nth: set[tuple[int, int]] = field(default_factory=set)  # (day of the week, which one of the month)

    def fits(self, day: datetime) -> bool:
        last = monthrange(day.year, day.month)[1]
        weekday = (day.weekday() + 1) % 7
        in_month = day.day in self.days or last - day.day in self.before_last or any(_nearest_weekday(day.year, day.month, n) == day.day for n in self.near if n <= last)
        in_month = in_month or self.last_weekday and _nearest_weekday(day.year, day.month, last) == day.day
        return in_month and (weekday in self.weekdays or weekday in self.last_of and day.day + 7 > last or (weekday, (day.day + 6) // 7) in self.nth)


def _nearest_weekday(year: int, month: int, day: int) -> int:
    """The day from Monday to Friday nearest to one, in the same month."""
    last = monthrange(year, month)[1]
    weekday = datetime(year, month, day).weekday()
    if weekday == 5:
        return day - 1 if day > 1 else day + 2
    if weekday == 6:
        return day + 1 if day < last else day - 2
    return day


@lru_cache(maxsize=10_000)
def parsed(rule: str) -> Rule | None:
    """A rule's fields; None if it is malformed."""
    fields = _MACROS.get(rule.strip().lower(), rule).lower().split()
    if len(fields) != 5:
        return None
    try:
        minutes, hours, months = (_allowed(fields[k].split(","), *_FIELDS[k]) for k in (0, 1, 3))
        out, plain = Rule(minutes, hours, months), []
        for part in ("*" if fields[2] == "?" else fields[2]).split(","):
            if part == "lw":
                out.last_weekday = True
            elif m := re.fullmatch(r"l(?:-([0-9]+))?", part):
                if (n := int(m[1] or 0)) > 30:
                    return None
                out.before_last.add(n)
            elif m := re.fullmatch(r"([0-9]+)w", part):
                out.near |= _allowed([m[1]], *_FIELDS[2])
            else:
                plain.append(part)
        out.days = _allowed(plain, *_FIELDS[2])
        plain = []
        for part in ("*" if fields[4] == "?" else fields[4]).split(","):
            if m := re.fullmatch(r"(\w+?)(?:l|#([1-5]))", part):
                (d,) = _allowed([m[1]], *_FIELDS[4])
                if m[2]:
                    out.nth.add((d % 7, int(m[2])))
                else:
                    out.last_of.add(d % 7)
            else:
                plain.append(part)
        out.weekdays = {d % 7 for d in _allowed(plain, *_FIELDS[4])}
    except ValueError:
        return None
    return out


def next_time(rule: str | None, after: int | None) -> int | None:
    """The first time later than `after` that a rule names, both in seconds since 1970."""
    if rule is None or after is None or (own := parsed(rule)) is None:
        return None
    start = datetime.fromtimestamp(after, UTC).replace(second=0) + timedelta(minutes=1)
    day = start.replace(hour=0, minute=0)
    while day.year <= start.year + HORIZON:
        if day.month not in own.months:
            day = (day.replace(day=1) + timedelta(days=32)).replace(day=1)
            continue
        if own.fits(day):
            times = (day + timedelta(hours=h, minutes=m) for h in sorted(own.hours) for m in sorted(own.minutes))
            if (found := next((t for t in times if t >= start), None)) is not None:
                return int(found.timestamp())
        day += timedelta(days=1)
    return None


def next_run(rule: Column, after: Column) -> Column:
    """The first time later than `after` that a rule names, to the minute; null if it is malformed or never fits."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def times(rules, seconds):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([next_time(r, None if pd.isna(s) else int(s)) for r, s in zip(rules, seconds)], dtype="Int64")

    return F.timestamp_seconds(times(rule, F.unix_timestamp(after)))
