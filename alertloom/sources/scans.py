"""Batch scans over alert tables: time windows, cursors, backfill, lookback."""

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions.coerce import to_int
from alertloom.functions.ordering import row_numbers
from alertloom.operators.filters import keyword, min_level

# Window of the scheduled mode, lookback limit in windows, page size of the search.
WINDOW_MINUTES, MAX_WINDOWS_BACK, PAGE_SIZE = 10, 4, 100


def window_bounds(now: datetime, last: datetime | None = None,
                  minutes: int = WINDOW_MINUTES) -> tuple[datetime, datetime]:
    """From the last processed moment to now, however long ago that was; first one window."""
    return (now - timedelta(minutes=minutes) if last is None else last), now


def capped_window(now: datetime, last: datetime | None = None, minutes: int = WINDOW_MINUTES,
                  windows: int = MAX_WINDOWS_BACK
                  ) -> tuple[datetime, datetime, tuple[datetime, datetime] | None]:
    """As ``window_bounds`` but at most ``windows`` windows back; also the interval left out."""
    start, end = window_bounds(now, last, minutes)
    limit = now - timedelta(minutes=minutes * windows)
    return (limit, end, (start, limit)) if start < limit else (start, end, None)


def parse_since(text: str, now: datetime | None = None) -> datetime:
    """Start of a lookback given as 30m, 2h or 1d."""
    match = re.fullmatch(r"(\d+)([mhd])", text)
    if not match:
        raise ValueError(f"lookback must look like 30m, 2h or 1d: {text!r}")
    unit = {"m": "minutes", "h": "hours", "d": "days"}[match[2]]
    return (now or datetime.now(timezone.utc)) - timedelta(**{unit: int(match[1])})


def _in_window(start: datetime, end: datetime, closed: bool):
    """Half open by default, so that an alert on a boundary belongs to one window only."""
    ts = F.col("event_ts")
    before = ts <= F.lit(end) if closed else ts < F.lit(end)
    return (ts >= F.lit(start)) & before


def time_window(alerts: DataFrame, start: datetime, end: datetime, level: int = 1,
                closed: bool = False) -> DataFrame:
    return min_level(alerts.where(_in_window(start, end, closed)), level)


def scan_counters(alerts: DataFrame, start: datetime, end: datetime, level: int = 1,
                  closed: bool = False) -> DataFrame:
    """One row: lines seen, matched, without a usable time, in the window but below the level."""
    inside = F.coalesce(_in_window(start, end, closed), F.lit(False))
    high = F.expr(f"{to_int('rule.level')} >= {int(level)}")
    return alerts.agg(
        F.count("*").alias("total"),
        F.count_if(inside & high).alias("matched"),
        F.count_if(F.col("event_ts").isNull()).alias("skipped_ts"),
        F.count_if(inside & ~high).alias("skipped_level"),
    )


def next_page(alerts: DataFrame, after: tuple[datetime, str] | None, now: datetime, level: int = 0,
              size: int = PAGE_SIZE, newest_first: bool = False) -> DataFrame:
    """The next alerts after the cursor, oldest first; without a cursor those of the last hour.

    The cursor is (event_ts, doc_id) of the last alert handed out, so a page edge inside one instant
    loses nothing. With ``newest_first`` the walk goes back in time.
    """
    ts, doc = F.col("event_ts"), F.col("doc_id")
    if after is None:
        start = ts >= F.lit(now - timedelta(hours=1))
    elif newest_first:
        start = (ts < F.lit(after[0])) | ((ts == F.lit(after[0])) & (doc < F.lit(after[1])))
    else:
        start = (ts > F.lit(after[0])) | ((ts == F.lit(after[0])) & (doc > F.lit(after[1])))
    order = [ts.desc(), doc.desc()] if newest_first else [ts, doc]
    return min_level(alerts.where(start), level).orderBy(*order).limit(size)


def cursor_pages(alerts: DataFrame, since: datetime, level: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """All pages from ``since`` on in one plan: every alert with its ``page``, from 0, and ``place`` in it.

    The same pages as walking the cursor gives, in two passes over the order columns instead of a sort
    of the whole table for each page.
    """
    wanted = min_level(alerts.where(F.col("event_ts") >= F.lit(since)), level).select("event_ts", "doc_id")
    return row_numbers(wanted, "event_ts", "doc_id").selectExpr(
        "doc_id", "event_ts", f"(row_no - 1) div {int(size)} AS page", f"(row_no - 1) % {int(size)} AS place")


def pages(alerts: DataFrame, since: datetime, level: int = 0, size: int = PAGE_SIZE):
    """Page after page from ``since`` on, as (number, page); only cursors come to the driver."""
    after, number = (since, ""), 0
    while True:
        page = next_page(alerts, after, since, level, size)
        last = page.orderBy(F.desc("event_ts"), F.desc("doc_id")).select("event_ts", "doc_id").first()
        if last is None:
            return
        yield number, page
        after, number = (last["event_ts"].astimezone(timezone.utc), last["doc_id"]), number + 1


def backfill(alerts: DataFrame, last: int, level: int = 6, word: str | None = None) -> DataFrame:
    """The last N alerts by time, filtered afterwards."""
    newest = alerts.orderBy(F.col("event_ts").desc(), F.col("doc_id").desc()).limit(last)
    return keyword(min_level(newest, level), word)


def since(alerts: DataFrame, lookback: str, now: datetime | None = None) -> DataFrame:
    return alerts.where(F.col("event_ts") >= F.lit(parse_since(lookback, now)))
