"""ISO-8601 times, always in UTC."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(4096)
def _parsed(text: str) -> datetime:
    t = datetime.fromisoformat(text[:-1] + "+00:00" if text.endswith("Z") else text)
    return t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)


def convert_to_datetime(text: str | datetime | None, stringify: bool = False) -> datetime | str | None:
    """UTC time of a text; a naive time is UTC. None, "None" and "" give None."""
    if text is None or text in ("", "None"):
        return None
    t = text if isinstance(text, datetime) else _parsed(text)
    if isinstance(text, datetime):
        t = t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)
    return t.isoformat() if stringify else t


def parse(text: Column) -> Column:
    """Timestamp of ISO text (the session's zone must be UTC); null where it is no time."""
    return F.try_to_timestamp(text)


def iso(ts: Column) -> Column:
    """ISO text with +00:00; a fraction only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.when(F.pmod(F.unix_micros(ts), F.lit(1_000_000)) == 0, F.lit("")).otherwise(F.date_format(ts, ".SSSSSS"))
    return F.concat(whole, part, F.lit("+00:00"))


def within(ts: Column, interval: tuple | None) -> Column:
    """Both ends inclusive; an end that is None is open; no interval holds everything."""
    start, end = (convert_to_datetime(x) for x in interval) if interval else (None, None)
    ok = ts.isNotNull()
    if start is not None:
        ok = ok & (ts >= F.lit(start))
    if end is not None:
        ok = ok & (ts <= F.lit(end))
    return ok
