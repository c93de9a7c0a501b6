"""Clock helpers: timeframes, buckets, sessions and the event calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Minutes per timeframe unit.
UNIT_MINUTES = {"m": 1, "h": 60, "d": 1440}

# Session windows in UTC hours, inclusive; other hours are asian.
SESSIONS = {"london": (7, 11), "ny": (12, 16), "quiet": (17, 21)}

# Weekly high-impact events, Monday = 0, hour in UTC.
CALENDAR = [(1, 13), (3, 12), (4, 12), (2, 14)]


def tf_minutes(tf: str) -> int:
    """Minutes of a timeframe such as ``5m``, ``4h`` or ``1d``."""
    text = tf.strip().lower()
    unit = UNIT_MINUTES.get(text[-1:])
    if unit is None or not text[:-1].isdigit():
        raise ValueError(f"unknown timeframe {tf!r}")
    return int(text[:-1]) * unit


def tf_minutes_col(tf: Column) -> Column:
    """The same over a column; an unknown unit fails the query."""
    text = F.lower(F.trim(tf))
    count = F.regexp_extract(text, r"^(\d+)[mhd]$", 1)
    unit = F.right(text, F.lit(1))
    scale = F.lit(None)
    for key, minutes in UNIT_MINUTES.items():
        scale = F.when(unit == key, F.lit(minutes)).otherwise(scale)
    bad = F.raise_error(F.concat(F.lit("unknown timeframe "), tf))
    return F.when(count == "", bad.cast("int")).otherwise(F.try_to_number(count, F.lit("999999999")).cast("int") * scale)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def bucket_micros(ts: Column, minutes: int) -> Column:
    """Start of the timeframe bucket, in microseconds since the epoch."""
    width = minutes * 60_000_000
    value = micros(ts)
    return value - F.pmod(value, F.lit(width).cast("long"))


def bucket_start(ts: Column, minutes: int) -> Column:
    return F.timestamp_micros(bucket_micros(ts, minutes))


def session_of(hour: Column) -> Column:
    name = F.lit("asian")
    for label, (lo, hi) in SESSIONS.items():
        name = F.when(hour.between(lo, hi), F.lit(label)).otherwise(name)
    return name


def allowed_sessions(df: DataFrame, ts: str, blocked: list[str]) -> DataFrame:
    """Drop rows whose session is blocked; unknown names are an error."""
    known = {*SESSIONS, "asian"}
    unknown = set(blocked) - known
    if unknown:
        raise ValueError(f"unknown sessions {sorted(unknown)}; known: {sorted(known)}")
    if not blocked:
        return df
    return df.where(~session_of(F.hour(ts)).isin(*sorted(blocked)))


def in_event_window(ts: Column, before: int = 30, after: int = 30, calendar=CALENDAR) -> Column:
    """True within [event - before, event + after] minutes, ends included.

    The calendar is a fixed weekly list of a few rows, so the range join with it
    is a constant predicate per row and needs no join at all.
    """
    seconds = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.date_trunc("day", ts).cast("timestamp"))
    hit = F.lit(False)
    for weekday, hour in calendar:
        centre = hour * 3_600_000_000
        lo, hi = centre - before * 60_000_000, centre + after * 60_000_000
        hit = hit | ((F.weekday(ts) == weekday) & seconds.between(F.lit(lo).cast("long"), F.lit(hi).cast("long")))
    return hit


def outside_events(df: DataFrame, ts: str, before: int = 30, after: int = 30) -> DataFrame:
    return df.where(~in_event_window(F.col(ts), before, after))


def parsed_millis(text: Column) -> Column:
    """ISO text to epoch milliseconds, null on junk."""
    return F.unix_millis(F.try_to_timestamp(text))


def exit_millis(exit_ms: Column, entry_ms: Column, bars_held: Column, minutes: int) -> Column:
    """End of a row's outcome: its exit, else entry plus held bars (at least 1)."""
    held = F.greatest(F.coalesce(bars_held.cast("long"), F.lit(0).cast("long")), F.lit(1).cast("long"))
    return F.coalesce(exit_ms, entry_ms + held * F.lit(minutes * 60_000).cast("long"))
