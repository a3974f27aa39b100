"""Hour filters (F-01 to F-03) and column filters of ranked tables (F-04 to F-08, F-13) as Column predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casehours.functions import calendar as cal
from casehours.operators.browse import displayed


def normalized_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of slot days, clamped to the year, sorted, overlapping or touching ones merged (F-02)."""
    clean = sorted((max(0, min(a, b)), min(cal.SLOT_DAYS - 1, max(a, b))) for a, b in runs)
    out: list[tuple[int, int]] = []
    for a, b in clean:
        if b < a:
            continue
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


@dataclass(frozen=True)
class HourFilter:
    """Which hours count; None is no constraint. Phantom hours never count (F-01)."""

    years: tuple[int, ...] | None = None
    date_runs: tuple[tuple[int, int], ...] | None = None
    hours_ending: tuple[int, ...] | None = None
    weekdays: tuple[int, ...] | None = None
    seasons: tuple[int, ...] | None = None
    tou: str | None = None
    tou_column: str = field(default="tou", compare=False)

    def predicate(self) -> Column:
        parts = [~cal.is_phantom()]
        if self.years is not None:
            parts.append(F.col("year").isin(*self.years))
        if self.date_runs is not None and (runs := normalized_runs(list(self.date_runs))):
            day = cal.day_of_slot()
            parts.append(reduce(Column.__or__, [day.between(a, b) for a, b in runs]))
        if self.hours_ending is not None:
            parts.append(cal.he_of().isin(*self.hours_ending))
        if self.weekdays is not None:
            parts.append(cal.weekday_of().isin(*self.weekdays))
        if self.seasons is not None:
            parts.append(cal.season_of().isin(*self.seasons))
        if self.tou is not None:
            parts.append(F.col(self.tou_column) == self.tou)
        return reduce(Column.__and__, parts)

    def with_loaded_years(self, loaded: list[int]) -> HourFilter:
        """The years filter met with the loaded years; empty or complete is no constraint (F-03, U-03)."""
        if self.years is None:
            return self
        still = tuple(sorted(set(self.years) & set(loaded)))
        return HourFilter(None if not still or set(still) == set(loaded) else still, self.date_runs, self.hours_ending, self.weekdays, self.seasons, self.tou, self.tou_column)


#: Slot days of a bucket: a run of days is joined through the buckets that it touches.
RUN_BUCKET = 32


def merged_runs(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, first_day, last_day: a table of runs of slot days, in either order, clamped to the year; overlapping or touching ones merged (F-02).

    First the longest run from each day is found, so a window has a year's days at most, however many runs there are.
    """
    a, b = F.least("first_day", "last_day"), F.greatest("first_day", "last_day")
    clamped = runs.select(*by, F.greatest(a, F.lit(0)).alias("a"), F.least(b, F.lit(cal.SLOT_DAYS - 1)).alias("b")).filter("a <= b")
    longest = clamped.groupBy(*by, "a").agg(F.max("b").alias("b"))
    order = Window.partitionBy(*by).orderBy("a")
    apart = F.col("a") > F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1
    islands = longest.withColumn("_apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("_island", F.sum("_apart").over(order))
    return islands.groupBy(*by, "_island").agg(F.min("a").cast("int").alias("first_day"), F.max("b").cast("int").alias("last_day")).drop("_island")


def in_runs(facts: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """``facts`` on the days of their group's runs; a group without runs is not constrained (F-02). ``runs``: by, first_day, last_day."""
    merged = merged_runs(runs, by)
    bucket = lambda day: F.floor(day / RUN_BUCKET)
    touched = merged.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("first_day")), bucket(F.col("last_day")))))
    constrained = runs.select(*by).distinct().withColumn("_constrained", F.lit(True))
    placed = facts.withColumn("_day", cal.day_of_slot()).withColumn("_bucket", bucket(F.col("_day")))
    on = [F.col(f"f.{c}") == F.col(f"r.{c}") for c in [*by, "_bucket"]] + [F.col("f._day").between(F.col("r.first_day"), F.col("r.last_day"))]
    hit = placed.alias("f").join(touched.alias("r"), reduce(Column.__and__, on), "left").select("f.*", F.col("r.first_day").isNotNull().alias("_hit"))
    return hit.join(constrained, by, "left").filter("_hit or _constrained is null").select(*facts.columns)


def display_text(column: Column, cell_class: str | None = None) -> Column:
    """The cell as shown: text trimmed; numbers, for which ``cell_class`` is given, rounded as in tables."""
    return displayed(column, cell_class) if cell_class else F.trim(F.coalesce(column.cast("string"), F.lit("")))


def text_filter(column: Column, typed: str, cell_class: str | None = None) -> Column:
    """Any comma- or line-separated piece occurs in the displayed cell, case ignored (F-04)."""
    pieces = [p.strip().lower() for p in re.split(r"[,\n]", typed) if p.strip()]
    if not pieces:
        return F.lit(True)
    shown = F.lower(display_text(column, cell_class))
    return reduce(Column.__or__, [shown.contains(p) for p in pieces])


def values_filter(column: Column, chosen: list[str], cell_class: str | None = None) -> Column:
    """The displayed cell is one of the chosen texts; the empty text selects blanks (F-05)."""
    return display_text(column, cell_class).isin(*[c.strip() for c in chosen])


def range_filter(column: Column, low: float | None = None, high: float | None = None, ratio: bool = False) -> Column:
    """Inclusive bounds; null fails. Bounds of a ratio column are in percent, of 12 significant digits (F-06)."""
    value = F.format_string("%.11e", (column * 100).cast("double")).cast("double") if ratio else column
    parts = [column.isNotNull()] + ([value >= low] if low is not None else []) + ([value <= high] if high is not None else [])
    return reduce(Column.__and__, parts)


def membership_filter(groups: Column, chosen: list[str]) -> Column:
    """The entity is in any of the chosen groups; the empty text selects entities without a group (F-07)."""
    named = [c for c in chosen if c != ""]
    hit = F.arrays_overlap(F.coalesce(groups, F.array().cast("array<string>")), F.array(*[F.lit(c) for c in named])) if named else F.lit(False)
    return hit | (F.size(F.coalesce(groups, F.array().cast("array<string>"))) == 0) if "" in chosen else hit


def keep_set(facts: DataFrame, entity_stats: DataFrame, passes: Column, by: list[str]) -> DataFrame:
    """Facts of the entities whose own statistics pass; filters are never asked again of the aggregate (F-08)."""
    return facts.join(entity_stats.filter(passes).select(*by).distinct(), by, "left_semi")


def frozen_members(facts: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """A stored group narrows the live match (F-09)."""
    return facts.join(members.select(*by).distinct(), by, "left_semi")


def in_area_scope(entities: DataFrame, listed: DataFrame, areas: list[str], key: str = "entity", area_column: str = "area") -> DataFrame:
    """Entities of the areas, and entities that the list does not have; a listed one of a blank or other area goes (F-11)."""
    marked = entities.join(listed.select(key, F.col(area_column).alias("_area"), F.lit(True).alias("_listed")), key, "left")
    return marked.filter(F.col("_listed").isNull() | F.col("_area").isin(*areas)).drop("_area", "_listed")


def with_presence(scope: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """Scope rows that have any fact (F-12)."""
    return scope.join(facts.select(*by).distinct(), by, "left_semi")


def split_empty(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a value in the kept hours, and a one-row count of the others (F-13)."""
    return ranked.filter("n > 0"), ranked.agg(F.count_if(F.col("n") == 0).alias("hidden"))
