"""Statistics of series (A-09 to A-12, A-20 to A-22): one pass of built-in aggregates per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casehours.session import written


def stat_columns(value: str = "value", ndigits: int | None = None) -> list[Column]:
    """n, mean, min, max, sd, total, positive/negative/zero counts and means (A-09)."""
    v = F.col(value)
    put = lambda c: F.round(c, ndigits) if ndigits is not None else c
    return [
        F.count(v).alias("n"),
        put(F.avg(v)).alias("mean"),
        put(F.min(v)).alias("min"),
        put(F.max(v)).alias("max"),
        put(F.stddev_samp(v)).alias("sd"),
        put(F.sum(v)).alias("total"),
        F.count_if(v > 0).alias("n_pos"),
        put(F.avg(F.when(v > 0, v))).alias("mean_pos"),
        F.count_if(v < 0).alias("n_neg"),
        put(F.avg(F.when(v < 0, v))).alias("mean_neg"),
        F.count_if(v == 0).alias("n_zero"),
    ]


def series_stats(df: DataFrame, by: list[str], value: str = "value", ndigits: int | None = None) -> DataFrame:
    return df.groupBy(*by).agg(*stat_columns(value, ndigits))


def ranked_stats(scope: DataFrame, facts: DataFrame, by: list[str], value: str = "value", ndigits: int | None = None) -> DataFrame:
    """Statistics of every row of ``scope``; one without data has counts 0 and nulls (A-12)."""
    found = series_stats(facts, by, value, ndigits)
    counts = [c for c in found.columns if c == "n" or c.startswith("n_")]
    joined = scope.select(*by).distinct().join(found, by, "left")
    return joined.fillna(0, counts)


#: Buckets that a stretch of values is parted into at a time, and different values of a stretch that one task may sort.
BUCKETS, SORTED_VALUES = 1024, 10_000
QUARTERS = (0.25, 0.5, 0.75)


def value_counts(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """by, v, n: how often each group has each value, written. Counted before the shuffle, which goes by group and value."""
    return written(df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")), "value-counts")


def _beside(left: DataFrame, right: DataFrame, by: list[str], more: Column | None = None, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``by``, null groups included; the columns ``by`` of ``left`` stay."""
    renamed = right.withColumnsRenamed({c: f"_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    on = same[0]
    for c in [*same[1:], *([more] if more is not None else [])]:
        on = on & c
    return left.join(renamed, on, how).drop(*(f"_{c}" for c in by))


def values_at(counts: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """by, rank, at: the value at each rank (from 0) of each group. ``ranks``: by, rank, small; no group meets in one task.

    Every rank has a stretch of values in which it lies, the whole group's at first. Stretches of more than ``SORTED_VALUES``
    different values are parted into buckets of equal width, whose counts say in which one each rank lies; what is left
    is sorted. A stretch runs from its least to its greatest value, so each parting leaves fewer values.
    """
    ends = counts.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("different"))
    known = written(_beside(ranks, ends, by).withColumn("before", F.lit(0).cast("long")), "rank-stretches")
    while known.filter(F.col("different") > SORTED_VALUES).limit(1).count():
        wide = known.filter(F.col("different") > SORTED_VALUES).select(*by, "lo", "hi", "before").distinct()
        bucket = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1))
        inside = _beside(counts, wide, by, F.col("v").between(F.col("lo"), F.col("hi"))).withColumn("bucket", bucket)
        parts = inside.groupBy(*by, F.col("lo").alias("from"), "before", "bucket").agg(F.sum("n").alias("n"), F.min("v").alias("new_lo"), F.max("v").alias("new_hi"), F.count(F.lit(1)).alias("new_different"))
        running = F.sum("n").over(Window.partitionBy(*by, "from").orderBy("bucket"))
        parts = parts.select(*by, "from", (F.col("before") + running).alias("until"), "n", "new_lo", "new_hi", "new_different")
        found = _beside(known, parts, by, (F.col("lo") == F.col("from")) & (F.col("different") > SORTED_VALUES) & (F.col("rank") < F.col("until")) & (F.col("rank") >= F.col("until") - F.col("n")), "left")
        new = lambda name: F.coalesce(f"new_{name}", name).alias(name)
        known = written(found.select(*by, "rank", new("lo"), new("hi"), new("different"), F.coalesce(F.col("until") - F.col("n"), "before").alias("before")), "rank-stretches")
    stretches = known.select(*by, "lo", "hi", "before").distinct()
    inside = _beside(counts, stretches, by, F.col("v").between(F.col("lo"), F.col("hi")))
    until = F.col("before") + F.sum("n").over(Window.partitionBy(*by, "lo").orderBy("v"))
    placed = inside.select(*by, F.col("lo").alias("from"), "v", "n", until.alias("until"))
    on = (F.col("lo") == F.col("from")) & (F.col("rank") < F.col("until")) & (F.col("rank") >= F.col("until") - F.col("n"))
    return _beside(placed, known.select(*by, "rank", "lo"), by, on).select(*by, "rank", F.col("v").alias("at"))


def quantiles_of(counts: DataFrame, by: list[str], points: tuple[float, ...] = QUARTERS) -> DataFrame:
    """by and a column q (array, one value a point, by linear interpolation) of each group; small, written."""
    place = F.col("point") * (F.col("total") - 1)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total")).withColumn("point", F.explode(F.array(*map(F.lit, points))))
    places = written(totals.select(*by, "point", place.alias("place"), F.floor(place).alias("low"), F.ceil(place).alias("high")), "quantile-places")
    ranks = places.select(*by, F.explode(F.array("low", "high")).alias("rank")).distinct()
    at = values_at(counts, ranks, by).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "at"))).alias("at"))  # two ranks a point
    low, high = F.element_at("at", F.col("low")), F.element_at("at", F.col("high"))
    value = F.when(low == high, low).otherwise((F.col("high") - F.col("place")) * low + (F.col("place") - F.col("low")) * high)
    listed = _beside(places, at, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("point", value.alias("value")))).alias("q"))
    return written(listed.select(*by, F.transform("q", lambda x: x["value"]).alias("q")), "quantiles")


def box_of_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """Box plots of groups whose values are counted (see ``value_counts``)."""
    v, p25, p75 = F.col("v"), F.col("q")[0], F.col("q")[2]
    inside = v.between(p25 - 1.5 * (p75 - p25), p75 + 1.5 * (p75 - p25))
    boxes = _beside(counts, quantiles_of(counts, by), by).groupBy(*by).agg(
        F.sum("n").alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.first("q").alias("q"),
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"), F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
    )
    return boxes.select(*by, "n", "min", p25.alias("p25"), F.col("q")[1].alias("median"), p75.alias("p75"), "max", "whisker_low", "whisker_high", "outliers", (F.col("min") == F.col("max")).alias("degenerate"))


def box_stats(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Box plots: quartiles by linear interpolation, whiskers within 1.5 IQR, outliers, degenerate (A-10, A-14)."""
    return box_of_counts(value_counts(df, by, value), by)


def quartiles(df: DataFrame, by: list[str], value: str = "value", approximate: int | None = None) -> DataFrame:
    """p25, median, p75 (A-11); ``approximate`` is the accuracy of an approximation in one pass."""
    if approximate:
        found = df.groupBy(*by).agg(F.percentile_approx(value, F.array(*map(F.lit, QUARTERS)), approximate).alias("q"))
    else:
        found = quantiles_of(value_counts(df, by, value), by)
    return found.select(*by, F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"))


def all_zero(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Has values, and all are zero (A-22)."""
    v = F.col(value)
    return df.groupBy(*by).agg(((F.count(v) > 0) & (F.count_if(v != 0) == 0)).alias("all_zero"))


def capacity_factor(mean: Column, cap: Column) -> Column:
    """mean / cap; null without a cap or with cap 0 (A-20)."""
    return F.try_divide(mean, cap)


def line_fit(points: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Least squares of y on x: slope, intercept, r2, n; null slope is a refusal (A-21)."""
    both = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = both.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))
    reason = F.when(F.col("n") < 2, "fewer than two points").when(F.col("slope").isNull(), "x does not vary")
    return fit.withColumn("refusal", reason).withColumn("slope", F.when(F.col("n") >= 2, F.col("slope"))).withColumn("intercept", F.when(F.col("n") >= 2, F.col("intercept"))).withColumn("r2", F.when(F.col("refusal").isNull(), F.col("r2")))
