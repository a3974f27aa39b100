"""The fixed leap-year calendar (C-01 to C-06): every year has 8,784 slot hours, 29 February is slot day 59.

A year without 29 February has that day as a phantom: no hours, no weekday. All functions are arithmetic on columns, so
facts need no join to know their month, weekday or season.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOT_HOURS, SLOT_DAYS, LEAP_DAY = 8784, 366, 59
MOST_YEARS = 256
SEASONS = ("Winter", "Spring", "Summer", "Autumn")

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_leap(year: ColumnOrName) -> Column:
    y = _c(year)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def slot_day(date: ColumnOrName) -> Column:
    """Slot day 0 to 365 of a date."""
    d = _c(date)
    return F.dayofyear(d) - 1 + F.when(~is_leap(F.year(d)) & (F.month(d) >= 3), 1).otherwise(0)


def slot_hour(date: ColumnOrName, he: ColumnOrName) -> Column:
    """Slot hour 0 to 8783 of a date and an hour-ending 1 to 24."""
    return slot_day(date) * 24 + _c(he) - 1


def day_of_slot(hour: ColumnOrName = "slot_hour") -> Column:
    return F.floor(_c(hour) / 24).cast("int")


def he_of(hour: ColumnOrName = "slot_hour") -> Column:
    return (_c(hour) % 24 + 1).cast("int")


def _leap_date(hour: ColumnOrName) -> Column:
    return F.date_add(F.lit("2000-01-01").cast("date"), day_of_slot(hour))


def month_of(hour: ColumnOrName = "slot_hour") -> Column:
    return F.month(_leap_date(hour))


def monthday_of(hour: ColumnOrName = "slot_hour") -> Column:
    return F.dayofmonth(_leap_date(hour))


def is_phantom(year: ColumnOrName = "year", hour: ColumnOrName = "slot_hour") -> Column:
    return ~is_leap(year) & (day_of_slot(hour) == LEAP_DAY)


def date_of(year: ColumnOrName = "year", hour: ColumnOrName = "slot_hour") -> Column:
    """The date of a slot hour; null for a phantom."""
    return F.when(~is_phantom(year, hour), F.make_date(_c(year), month_of(hour), F.when(is_phantom(year, hour), 28).otherwise(monthday_of(hour))))


def weekday_of(year: ColumnOrName = "year", hour: ColumnOrName = "slot_hour") -> Column:
    """Monday 0 to Sunday 6; null for a phantom (C-05)."""
    return F.weekday(date_of(year, hour))


def season_of(hour: ColumnOrName = "slot_hour") -> Column:
    """0 December to February, 1 March to May, 2 June to August, 3 September to November."""
    return (F.floor((month_of(hour) % 12) / 3)).cast("int")


def hours_in(year: ColumnOrName) -> Column:
    return F.when(is_leap(year), SLOT_HOURS).otherwise(SLOT_HOURS - 24)


def calendar(spark: SparkSession, first_year: int, years: int) -> DataFrame:
    """year, slot_hour, slot_day, month, day, dow, he, season, phantom for a span of years (C-02)."""
    if not 0 < years <= MOST_YEARS:
        raise ValueError(f"a span has 1 to {MOST_YEARS} years")
    base = spark.range(years * SLOT_HOURS).select((F.lit(first_year) + F.floor(F.col("id") / SLOT_HOURS)).cast("int").alias("year"), (F.col("id") % SLOT_HOURS).cast("int").alias("slot_hour"))
    return base.select("year", "slot_hour", day_of_slot().alias("slot_day"), month_of().alias("month"), monthday_of().alias("day"), weekday_of().alias("dow"), he_of().alias("he"), season_of().alias("season"), is_phantom().alias("phantom"))


def real_hours(spans: DataFrame) -> DataFrame:
    """``spans`` (case_id, first_year, num_years) with real_hours (C-03)."""
    years = spans.select("*", F.explode(F.sequence(F.col("first_year"), F.col("first_year") + F.col("num_years") - 1)).alias("_year"))
    return years.groupBy(*spans.columns).agg(F.sum(hours_in("_year")).cast("long").alias("real_hours"))


def coverage(table_hours: DataFrame, by: list[str]) -> DataFrame:
    """Real hours that a table has, and the real hours of its span (C-04, Q-08)."""
    seen = table_hours.filter(~is_phantom()).select(*by, "year", "slot_hour").distinct()
    found = seen.groupBy(*by).agg(F.count(F.lit(1)).alias("hours_seen"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    spans = found.select(*by, "hours_seen", F.explode(F.sequence("first_year", "last_year")).alias("_year"))
    return spans.groupBy(*by, "hours_seen").agg(F.sum(hours_in("_year")).cast("long").alias("real_hours"))


def on_common_axis(facts: DataFrame) -> DataFrame:
    """``facts`` with axis_hour from the earliest year of all cases (C-06)."""
    first = facts.agg(F.min("year").alias("_first"))
    return facts.crossJoin(F.broadcast(first)).withColumn("axis_hour", (F.col("year") - F.col("_first")) * SLOT_HOURS + F.col("slot_hour")).drop("_first")
