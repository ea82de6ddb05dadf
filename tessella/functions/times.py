"""Time: fixed resolutions, buckets from an origin, half-open ranges, lateness, names of windows. All in microseconds since 1970, UTC."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CubeError

#: Microseconds of the units, finest first.
UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
CALENDAR = ("day", "week", "month", "quarter", "year")
DAY = UNITS["d"]
_LONG = 2**63
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


def parse_resolution(text) -> int | str:
    """Microseconds of ``15m``, ``6h`` and so on; calendar words come back as they are (specs refuse them)."""
    text = str(text)
    if text in CALENDAR:
        return text
    m = re.fullmatch(r"(\d+)(us|µs|ms|s|m|h|d|w)", text)
    micros = int(m[1]) * UNITS[m[2].replace("µs", "us")] if m else 0
    if not 0 < micros < _LONG:
        raise CubeError(f"not a resolution: {text!r}")
    return micros


def show_resolution(micros: int | str) -> str:
    """In the coarsest unit that divides it."""
    if isinstance(micros, str):
        return micros
    unit = next(u for u in reversed(UNITS) if micros % UNITS[u] == 0)
    return f"{micros // UNITS[unit]}{unit}"


def parse_time(text: str | int | dt.datetime) -> int:
    """Microseconds of an RFC 3339 time, a datetime, or a number that is that already."""
    if isinstance(text, int):
        return text
    if isinstance(text, str):
        try:
            text = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
        except ValueError as e:
            raise CubeError(f"not a time: {text!r}") from e
    at = text if text.tzinfo else text.replace(tzinfo=dt.UTC)
    return (at - _EPOCH) // dt.timedelta(microseconds=1)


def parse_origin(text: str | int) -> int:
    return 0 if text == "unix" else parse_time(text)


def show_time(micros: int) -> str:
    at = _EPOCH + dt.timedelta(microseconds=micros)
    return at.strftime("%Y-%m-%dT%H:%M:%S") + (f".{at.microsecond:06d}" if at.microsecond else "") + "Z"


@dataclass(frozen=True)
class Range:
    """Half-open, not empty."""

    start: int
    end: int

    def __post_init__(self):
        if self.start >= self.end:
            raise CubeError("a range ends after it starts")

    def __contains__(self, at: int) -> bool:
        return self.start <= at < self.end

    @property
    def length(self) -> int:
        return self.end - self.start


def bucket(at: int, width: int, origin: int = 0) -> Range:
    """The bucket that holds ``at``; times before the origin round down as well."""
    start = at - (at - origin) % width
    if not -_LONG <= start or start + width >= _LONG:
        raise CubeError("bucket out of range")
    return Range(start, start + width)


def bucket_start(ts: Column, width: int, origin: int = 0) -> Column:
    """The same of a timestamp column, as a timestamp; null stays null."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros - F.lit(origin), F.lit(width)))


def on_time(event: Column, seen: Column, width: int, lateness: int, origin: int = 0) -> Column:
    """True while the bucket of ``event`` still takes rows at ``seen``: before its end and the allowed lateness have passed."""
    end = F.unix_micros(bucket_start(event, width, origin)) + F.lit(width)
    return F.unix_micros(seen.cast("timestamp")).cast("decimal(38,0)") < end.cast("decimal(38,0)") + F.lit(lateness)


def is_on_time(event: int, seen: int, width: int, lateness: int, origin: int = 0) -> bool:
    return seen < bucket(event, width, origin).end + lateness


def window_id(start: int, width: int) -> str:
    """``2026-04-07`` for whole days at midnight, else a time to the second, or to the microsecond where it has any."""
    if width % DAY == 0 and start % DAY == 0:
        return show_time(start)[:10]
    return show_time(start)


def affected_windows(changed: Range, width: int, origin: int = 0) -> list[tuple[str, Range]]:
    """Every bucket that a half-open range touches, ascending; an end on a border does not touch the next."""
    out, at = [], bucket(changed.start, width, origin).start
    while at < changed.end:
        out.append((window_id(at, width), Range(at, at + width)))
        at += width
    return out
