"""Bi-temporal state: supersession, snapshots, expiry, forgetting; calendars and dates."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values.
WEEKS = {"454": (4, 5, 4), "445": (4, 4, 5), "544": (5, 4, 4)}
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
# Ends of fixed values.


def supersede(facts: DataFrame, slot: list[str], since: str, key: str, value: str) -> DataFrame:
    """facts with valid_to, replaces and replaced_by: each statement of a slot holds until the next one with another value.

    The order is by time of validity, never by arrival, so late statements land where they belong; a statement that
    repeats the value before it opens no new version.
    """
    line = Window.partitionBy(*slot).orderBy(since, key)
    changed = facts.withColumn("_before", F.lag(value).over(line)).withColumn("_first", F.lag(key).over(line).isNull())
    heads = changed.where(F.col("_first") | ~F.col("_before").eqNullSafe(F.col(value))).drop("_before", "_first")
    return heads.withColumn("valid_to", F.lead(since).over(line)).withColumn("replaced_by", F.lead(key).over(line)).withColumn("replaces", F.lag(key).over(line))


def index_as_of(valid_from: Column, valid_to: Column, at: Column) -> Column:
    """Closed bounds, open where null: what an index keeps of a time."""
    return (F.coalesce(valid_from <= at, F.lit(True))) & (F.coalesce(valid_to >= at, F.lit(True)))


def graph_as_of(valid_from: Column, valid_to: Column, at: Column, status: Column | None = None) -> Column:
    """Half-open bounds, and neither retracted nor invalidated."""
    held = F.coalesce(valid_from <= at, F.lit(True)) & F.coalesce(valid_to > at, F.lit(True))
    return held if status is None else held & ~status.isin("RETRACTED", "INVALIDATED")


def known_at(observed: Column, known_to: Column, at: Column) -> Column:
    return (observed <= at) & F.coalesce(known_to >= at, F.lit(True))


def expired(status: Column, expires_at: Column, now: Column) -> Column:
    return (status == "CURRENT") & F.coalesce(expires_at <= now, F.lit(False))


def _month_end(year: int, month: int) -> date:
    return date(year + (month == 12), month % 12 + 1, 1) - timedelta(days=1)


def _year_end(year: int, end_month: int, named_by: str) -> date:
    """The Saturday nearest the last day of the year's last month."""
    last = _month_end(year + (named_by == "start" and end_month != 12), end_month)
    days = [last + timedelta(days=k) for k in range(-3, 4)]
    return next(d for d in days if d.weekday() == 5)


def fiscal_years(spark: SparkSession, first: int, last: int, pattern: str = "454", end_month: int = 1, named_by: str = "start") -> DataFrame:
    """fiscal_year, period, quarter, first_week, weeks, starts, ends: a row for each of the twelve periods of each year."""
    rows = []
    for year in range(first, last + 1):
        start, end = _year_end(year - 1, end_month, named_by) + timedelta(days=1), _year_end(year, end_month, named_by)
        weeks = list(WEEKS[pattern]) * 4
        weeks[-1] += ((end - start).days + 1) // 7 - 52
        at = 0
        for k, n in enumerate(weeks):
            rows.append((year, k + 1, k // 3 + 1, at + 1, n, start + timedelta(weeks=at), start + timedelta(weeks=at + n) - timedelta(days=1)))
            at += n
    return spark.createDataFrame(rows, "fiscal_year int, period int, quarter int, first_week int, weeks int, starts date, ends date")


def fiscal_position(rows: DataFrame, day: Column, calendar: DataFrame) -> DataFrame:
    """rows with fiscal_year, fiscal_week, period and quarter. The calendar has twelve rows a year, so it is broadcast; a day meets one period, by year first."""
    days = calendar.select("*", F.explode(F.sequence("starts", "ends")).alias("_day"))
    found = rows.withColumn("_day", day).join(F.broadcast(days), "_day", "left")
    week = F.col("first_week") + F.floor(F.datediff("_day", "starts") / 7).cast("int")
    return found.withColumn("fiscal_week", week).drop("_day", "first_week", "weeks", "starts", "ends")


def parse_date(text: Column) -> Column:
    """The first ISO date, or else the first "Month day, year" or "Month year", as a date."""
    iso = F.try_to_timestamp(F.regexp_extract(text, r"\b(\d{4}-\d{2}-\d{2})\b", 1), F.lit("yyyy-MM-dd")).cast("date")
    names = "|".join(MONTHS)
    low = F.lower(text)
    month, dom, year = (F.regexp_extract(low, rf"\b({names})\s+(\d{{1,2}})?,?\s*(\d{{4}})\b", k) for k in (1, 2, 3))
    number = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), month)
    written = F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(F.when(dom == "", "1").otherwise(dom), 2, "0"))
    return F.coalesce(iso, F.when(month != "", F.try_to_timestamp(written, F.lit("yyyy-MM-dd")).cast("date")))


def valid_from_cue(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, r"(?i)\b(?:as of|since|from|starting|effective)\s+([^,.;]+)", 1)), F.lit(""))


def valid_to_cue(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, r"(?i)\b(?:until|through|till)\s+([^,.;]+)", 1)), F.lit(""))


def relative_days(phrase: Column, base: Column) -> Column:
    """The days that an English phrase names, seen from a day, as a struct of first and last; null for other phrases."""
    low = F.lower(F.trim(phrase))
    monday = F.date_trunc("week", base).cast("date")
    one = lambda d: F.struct(d.alias("first"), d.alias("last"))
    span = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    month = F.trunc(base, "month")
    year = F.trunc(base, "year")
    out = (
        F.when(low == "today", one(base))
        .when(low == "yesterday", one(F.date_sub(base, 1)))
        .when(low == "tomorrow", one(F.date_add(base, 1)))
        .when(low == "last week", span(F.date_sub(monday, 7), F.date_sub(monday, 1)))
        .when(low == "this week", span(monday, F.date_add(monday, 6)))
        .when(low == "next week", span(F.date_add(monday, 7), F.date_add(monday, 13)))
        .when(low == "last weekend", span(F.date_sub(monday, 2), F.date_sub(monday, 1)))
        .when(low == "this weekend", span(F.date_add(monday, 5), F.date_add(monday, 6)))
        .when(low == "last month", span(F.add_months(month, -1), F.date_sub(month, 1)))
        .when(low == "this month", span(month, F.last_day(base)))
        .when(low == "next month", span(F.add_months(month, 1), F.last_day(F.add_months(month, 1))))
        .when(low == "last year", span(F.add_months(year, -12), F.date_sub(year, 1)))
        .when(low == "this year", span(year, F.date_sub(F.add_months(year, 12), 1)))
    )
    weekday = F.weekday(base)
    for k, name in enumerate(WEEKDAYS):
        back, ahead = (weekday - k + 6) % 7 + 1, (k - weekday + 6) % 7 + 1
        out = out.when(low == f"last {name}", one(F.date_sub(base, back.cast("int")))).when(low == f"next {name}", one(F.date_add(base, ahead.cast("int"))))
    return out


def overlaps(first: Column, last: Column, other_first: Column, other_last: Column) -> Column:
    return (first <= other_last) & (other_first <= last)
