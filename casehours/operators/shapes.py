"""Shapes of series: boxes by dimension, days, matrices, periods, curves, stacks, overlays, pairs (A-14 to A-18, W-*, J-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casehours.functions import calendar as cal
from casehours.operators.stats import box_of_counts, box_stats
from casehours.session import written

CURVE_POINTS = 1000
OVERLAY_LINES = 30

#: Box dimensions and their columns (A-14).
DIMENSIONS = {
    "case": lambda: F.col("case_id"),
    "year": lambda: F.col("year"),
    "month": cal.month_of,
    "hourOfDay": cal.he_of,
    "dayOfWeek": cal.weekday_of,
    "season": cal.season_of,
    "area": lambda: F.col("entity"),
}


def boxes(series: DataFrame, by: list[str], dimension: str) -> DataFrame:
    """A box for each series and value of a dimension; empty categories have none (A-14)."""
    return box_stats(series.withColumn("dim", DIMENSIONS[dimension]()), [*by, "dim"])


def boxes_by_dimensions(series: DataFrame, by: list[str], dimensions: list[str]) -> DataFrame:
    """Boxes for several dimensions from one scan: by, dimension, dim (as text) and the box (A-14).

    Values are counted by grouping sets, one for each dimension; boxes then come from the counts.
    """
    rows = series.filter("value is not null").select(*by, F.col("value").alias("v"), *(DIMENSIONS[d]().cast("string").alias(f"dim_{d}") for d in dimensions))
    sets = [[*by, f"dim_{d}", "v"] for d in dimensions]
    which = F.coalesce(*(F.when(F.grouping(f"dim_{d}") == 0, F.lit(d)) for d in dimensions))
    counted = rows.groupingSets(sets, *by, *(f"dim_{d}" for d in dimensions), "v").agg(F.count(F.lit(1)).alias("n"), which.alias("dimension"))
    counts = written(counted.select(*by, "dimension", F.coalesce(*(f"dim_{d}" for d in dimensions)).alias("dim"), "v", "n"), "value-counts")
    return box_of_counts(counts, [*by, "dimension", "dim"])


def daily(series: DataFrame, by: list[str]) -> DataFrame:
    """Mean, min and max of each day over the kept hours (A-15)."""
    return series.groupBy(*by, "year", cal.day_of_slot().alias("slot_day")).agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))


def day_hour_matrix(series: DataFrame, by: list[str]) -> DataFrame:
    """A row a day with columns h1 to h24 (A-16)."""
    cells = [F.max(F.when(cal.he_of() == h, F.col("value"))).alias(f"h{h}") for h in range(1, 25)]
    return series.groupBy(*by, "year", cal.day_of_slot().alias("slot_day")).agg(*cells)


def colour_scale(series: DataFrame, by: list[str]) -> DataFrame:
    """One scale over all years: low, high (low + 1 if equal), diverging (A-16)."""
    ends = series.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high")).filter("low is not null")
    return ends.select(*by, "low", F.when(F.col("high") > F.col("low"), F.col("high")).otherwise(F.col("low") + 1).alias("high"), ((F.col("low") < 0) & (F.col("high") > 0)).alias("diverging"))


def with_period(series: DataFrame, period: str) -> DataFrame:
    """Period (its first date) and hour on the period's axis: day, week (Monday to Sunday, across New Year) or month (A-17)."""
    date, he = cal.date_of(), cal.he_of()
    real = series.filter(~cal.is_phantom())
    if period == "day":
        return real.withColumn("period", date).withColumn("axis_hour", he - 1)
    if period == "week":
        return real.withColumn("period", F.date_sub(date, cal.weekday_of())).withColumn("axis_hour", cal.weekday_of() * 24 + he - 1)
    if period == "month":
        return real.withColumn("period", F.trunc(date, "month")).withColumn("axis_hour", (cal.monthday_of() - 1) * 24 + he - 1)
    raise ValueError("period is day, week or month")


def period_summary(cut: DataFrame, by: list[str]) -> DataFrame:
    """Mean, p10 and p90 (nearest rank, outward) of each axis hour over the periods (A-18).

    The list of an axis hour has a value per period, 366 a year at most, so it is bounded.
    """
    ordered = cut.filter("value is not null").groupBy(*by, "axis_hour").agg(F.array_sort(F.collect_list("value")).alias("_v"), F.avg("value").alias("mean"))
    n = F.size("_v")
    return ordered.select(*by, "axis_hour", "mean", F.element_at("_v", (F.floor(0.1 * (n - 1)) + 1).cast("int")).alias("p10"), F.element_at("_v", (F.ceil(0.9 * (n - 1)) + 1).cast("int")).alias("p90"), n.alias("periods"))


def duration_curve(series: DataFrame, by: list[str]) -> DataFrame:
    """Kept values ascending with their rank and percent of the interval; one value is flat (W-01)."""
    kept = series.filter("value is not null")
    order = Window.partitionBy(*by).orderBy("value", *[c for c in ("year", "slot_hour") if c in kept.columns])
    ranked = kept.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    pct = F.when(F.col("n") > 1, (F.col("rank") - 1) / (F.col("n") - 1) * 100).otherwise(0.0)
    return ranked.select(*by, "rank", "n", pct.alias("pct"), "value")


def resampled_curve(curve: DataFrame, by: list[str], points: int = CURVE_POINTS) -> DataFrame:
    """A curve at ``points`` even places: the value at rank round(i / (points - 1) * (n - 1)) (W-01)."""
    sizes = curve.groupBy(*by).agg(F.max("n").alias("n"))
    places = sizes.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    places = places.withColumn("rank", F.floor(F.col("point") / (points - 1) * (F.col("n") - 1) + 0.5).cast("int") + 1)
    return places.join(curve.select(*by, "rank", "value"), [*by, "rank"]).select(*by, "point", "value")


def stack_order(series: DataFrame, by: list[str], line: str) -> DataFrame:
    """Lines of a stack by total, largest first, ties by name (W-03)."""
    totals = series.groupBy(*by, line).agg(F.sum("value").alias("total"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("total").desc_nulls_last(), line))
    return totals.withColumn("stack_rank", rank)


def stack_hours(series: DataFrame, order: DataFrame, by: list[str], line: str) -> DataFrame:
    """One row an hour that any line has: by, year, slot_hour, lines (in stack order), values, totals (running; a missing value adds nothing) (W-02).

    ``series`` has one row a line and hour. A stack has a few lines, so an hour's arrays are short.
    """
    hours = series.filter("value is not null").groupBy(*by, "year", "slot_hour").agg(F.map_from_entries(F.collect_list(F.struct(line, "value"))).alias("at"))
    lines = order.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("stack_rank", line))), lambda x: x[line]).alias("lines"))
    dense = hours.join(lines, by).withColumn("values", F.transform("lines", lambda x: F.element_at("at", x)))
    added = F.aggregate("values", F.array().cast("array<double>"), lambda sums, v: F.concat(sums, F.array(F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0.0)) + F.coalesce(v, F.lit(0.0)))))
    return dense.select(*by, "year", "slot_hour", "lines", "values", added.alias("totals"))


def stack_rows(hours: DataFrame, keys: list[str], line: str) -> DataFrame:
    """A row for every line of every row of :func:`stack_hours` or :func:`thinned_stack`: keys, line, stack_rank, value, running."""
    each = F.posexplode(F.arrays_zip("lines", "values", "totals")).alias("place", "x")
    return hours.select(*keys, each).select(*keys, F.col("x.lines").alias(line), (F.col("place") + 1).alias("stack_rank"), F.col("x.values").alias("value"), F.col("x.totals").alias("running"))


def stacked(series: DataFrame, order: DataFrame, by: list[str], line: str) -> DataFrame:
    """Running totals of each hour in stack order; a missing value is 0 if any line has the hour (W-02)."""
    return stack_rows(stack_hours(series, order, by, line), [*by, "year", "slot_hour"], line)


def overlay_years(series: DataFrame, by: list[str]) -> DataFrame:
    """Each year of a series as a line of its own on one slot axis; years without a value are dropped (W-06)."""
    lines = series.filter("value is not null").select(*by, "year").distinct()
    return series.join(lines, [*by, "year"], "left_semi").withColumn("line", F.concat_ws(" ", *by, F.col("year").cast("string")))


def thinned(series: DataFrame, by: list[str], hour: str, columns: int) -> DataFrame:
    """Hours of the least and the greatest value in each of ``columns`` stretches, apart at gaps (W-07)."""
    kept = series.filter("value is not null")
    w = Window.partitionBy(*by)
    placed = kept.withColumn("_run", F.col(hour) - F.row_number().over(w.orderBy(hour))).withColumn("_x0", F.min(hour).over(w)).withColumn("_x1", F.max(hour).over(w))
    column = F.least(F.floor((F.col(hour) - F.col("_x0")) / F.greatest(F.col("_x1") - F.col("_x0"), F.lit(1)) * columns), F.lit(columns - 1)).cast("int")
    low = F.min(F.struct(F.col("value"), F.col(hour).alias("h")))
    high = F.max(F.struct(F.col("value"), (-F.col(hour)).alias("h")))
    return placed.groupBy(*by, "_run", column.alias("column")).agg(low.alias("_l"), high.alias("_h")).select(*by, F.col("_run").alias("run"), "column", F.col("_l.h").alias("low_hour"), F.col("_l.value").alias("low"), (-F.col("_h.h")).alias("high_hour"), F.col("_h.value").alias("high"))


def thinned_stack(hours: DataFrame, by: list[str], hour: str, columns: int) -> DataFrame:
    """Hours kept of a stack, the same for every line: run, column, and the rows of :func:`stack_hours` kept (W-07).

    In each of ``columns`` stretches, apart at gaps, the hours of the least and the greatest of every running total stay (the first of
    equals). A stretch has the hours of its axis, whatever the number of stacks.
    """
    w = Window.partitionBy(*by)
    placed = hours.withColumn("run", F.col(hour) - F.row_number().over(w.orderBy(hour))).withColumn("_x0", F.min(hour).over(w)).withColumn("_x1", F.max(hour).over(w))
    column = F.least(F.floor((F.col(hour) - F.col("_x0")) / F.greatest(F.col("_x1") - F.col("_x0"), F.lit(1)) * columns), F.lit(columns - 1)).cast("int")
    rest = [c for c in hours.columns if c not in by]
    held = placed.withColumn("column", column).groupBy(*by, "run", "column").agg(F.array_sort(F.collect_list(F.struct(hour, *(c for c in rest if c != hour)))).alias("rows"))
    end = lambda k, turn: F.array_min(F.transform("rows", lambda r: F.struct((r["totals"][k] * turn).alias("t"), r[hour].alias("h"))))["h"]
    lines = F.sequence(F.lit(0), F.size(F.col("rows")[0]["totals"]) - 1)
    kept = held.withColumn("kept", F.array_distinct(F.flatten(F.transform(lines, lambda k: F.array(end(k, 1), end(k, -1))))))
    rows = kept.select(*by, "run", "column", F.explode(F.filter("rows", lambda r: F.array_contains("kept", r[hour]))).alias("x"))
    return rows.select(*by, "run", "column", *(F.col(f"x.{c}").alias(c) for c in rest))


def window_extremes(series: DataFrame, by: list[str], hour: str) -> DataFrame:
    """The highest and the lowest hour of each series, the earliest of equals (W-09)."""
    kept = series.filter("value is not null")
    agg = kept.groupBy(*by).agg(F.min(F.struct(F.col("value"), F.col(hour).alias("h"))).alias("_l"), F.max(F.struct(F.col("value"), (-F.col(hour)).alias("h"))).alias("_h"))
    return agg.select(*by, F.col("_l.h").alias("low_hour"), F.col("_l.value").alias("low"), (-F.col("_h.h")).alias("high_hour"), F.col("_h.value").alias("high"))


def kth_years(series: DataFrame, by: list[str]) -> DataFrame:
    """``series`` with k, the place of its year among the years kept (W-10). The years kept go to every row as a list of each series."""
    years = series.groupBy(*by).agg(F.array_sort(F.collect_set("year")).alias("_years"))
    return (series.join(years, by) if by else series.join(F.broadcast(years))).withColumn("k", F.array_position("_years", F.col("year")).cast("int")).drop("_years")


def xy_pairs(x: DataFrame, y: DataFrame, colour: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Hours of two series, or of two for each ``by``, by k-th year and slot hour: by, k, slot_hour, x, y and, if given, colour (J-11)."""
    by = by or []
    at = [*by, "k", "slot_hour"]
    of = lambda df, name: kth_years(df, by).select(*at, F.col("value").alias(name))
    out = of(x, "x").join(of(y, "y"), at).filter("x is not null and y is not null")
    return out.join(of(colour, "colour"), at, "left") if colour is not None else out


def pairing_refusal(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row: the numbers of years kept, and why they cannot be paired (J-11, Q-20)."""
    a, b = x.agg(F.count_distinct("year").alias("x_years")), y.agg(F.count_distinct("year").alias("y_years"))
    return a.crossJoin(b).withColumn("refusal", F.when(F.col("x_years") != F.col("y_years"), "the two series keep different numbers of years"))


def calendar_category(by: str) -> Column:
    """season, month or HE index of a point (T-24)."""
    return {"season": cal.season_of, "month": lambda: cal.month_of() - 1, "he": lambda: cal.he_of() - 1}[by]()
