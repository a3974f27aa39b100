"""Entities combined to one value per hour (A-01 to A-08, A-13, A-19, A-26, J-05, J-06, J-14).

The group series is built first; hour filters and statistics come after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR = ["year", "slot_hour"]
ALL_AREAS = "All areas"


def expand_groups(facts: DataFrame, memberships: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Facts once for each group that holds their entity: group rows need not add up (J-05)."""
    return facts.join(memberships, on or ["entity"])


def with_all_areas(memberships: DataFrame, axis: DataFrame) -> DataFrame:
    """The group of every area on the axis, unless one of that name was authored (J-06)."""
    authored = memberships.filter(F.col("grp") == ALL_AREAS).select("grp").distinct()
    every = axis.select("entity").distinct().withColumn("grp", F.lit(ALL_AREAS)).join(authored, "grp", "left_anti")
    return memberships.select("entity", "grp").unionByName(every.select("entity", "grp"))


def sum_series(df: DataFrame, by: list[str], value: str = "value", coef: str | None = None) -> DataFrame:
    """Sum per hour, signed by ``coef`` if given; null where nobody contributes (A-01 to A-03, A-05)."""
    v = F.col(value) * F.col(coef) if coef else F.col(value)
    return df.groupBy(*by, *HOUR).agg(F.sum(v).alias("value"), F.count(F.col(value)).alias("contributors"))


def mean_series(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Plain mean per hour of the entities that have a value (A-05)."""
    return df.groupBy(*by, *HOUR).agg(F.avg(value).alias("value"), F.count(F.col(value)).alias("contributors"))


def weighted_series(df: DataFrame, by: list[str], value: str = "value", weight: str | None = "weight", fallback: str | None = None, entity: str = "entity") -> DataFrame:
    """Weighted mean per hour (A-06): year, slot_hour, value, weight (total), weight_used.

    Hours of zero total weight are the plain mean. If every hour with data has zero weight the fallback weight is
    tried. A series of one entity passes through unchanged; without a weight column it is the plain mean and claims no
    weight. ``df`` has one row per entity and hour; ``weight`` and ``fallback`` are columns of it.
    """
    v = F.col(value)
    names = [c for c in (weight, fallback) if c]
    sums = []
    for k, w in enumerate(names):
        both = v.isNotNull() & F.col(w).isNotNull()
        sums += [F.coalesce(F.sum(F.when(both, v * F.col(w))), F.lit(0.0)).alias(f"_vw{k}"), F.coalesce(F.sum(F.when(both, F.col(w))), F.lit(0.0)).alias(f"_w{k}")]
    held = F.when(v.isNotNull(), F.col(entity))
    carried = [F.count(F.col(w)).alias(f"_n{k}") for k, w in enumerate(names)]
    hourly = df.groupBy(*by, *HOUR).agg(F.avg(v).alias("_plain"), F.min(held).alias("_first"), F.max(held).alias("_last"), *sums, *carried)
    # what decides for the whole series comes from its hours, all of them, whatever a filter keeps later
    whole = Window.partitionBy(*by)
    choice = F.lit(None).cast("int")
    for k in reversed(range(len(names))):
        has = F.sum(f"_n{k}").over(whole) > 0
        weighs = F.count_if(F.col("_plain").isNotNull() & (F.col(f"_w{k}") != 0)).over(whole) > 0
        choice = F.when(has & weighs, F.lit(k)).otherwise(choice)
    several = F.min("_first").over(whole) < F.max("_last").over(whole)
    joined = hourly.withColumn("_k", F.when(several, choice))
    value_out, weight_out, used = F.col("_plain"), F.lit(None).cast("double"), F.lit(None).cast("string")
    for k, w in enumerate(names):
        here = F.col("_k") == k
        value_out = F.when(here & (F.col(f"_w{k}") != 0), F.try_divide(F.col(f"_vw{k}"), F.col(f"_w{k}"))).otherwise(value_out)
        weight_out = F.when(here, F.col(f"_w{k}")).otherwise(weight_out)
        used = F.when(here, F.lit(w)).otherwise(used)
    return joined.select(*by, *HOUR, value_out.alias("value"), weight_out.alias("weight"), used.alias("weight_used"))


def pooled_mean(series: DataFrame, by: list[str]) -> DataFrame:
    """sum(series * weight) / sum(weight) over the kept hours; not the mean of the hourly series (A-07)."""
    ok = F.col("value").isNotNull() & F.col("weight").isNotNull()
    return series.groupBy(*by).agg(F.try_divide(F.sum(F.when(ok, F.col("value") * F.col("weight"))), F.sum(F.when(ok, F.col("weight")))).alias("pooled_mean"))


def strict_sum(column):
    """Sum that is null as soon as one row is null (A-19)."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))


def boundary_limits(limits: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """Limits of a boundary per month: a reversed member swaps sides and sign; a side that any member lacks is null (A-19).

    ``limits``: entity, month, upper, lower. ``members``: ``by``, entity, coef (1 or -1).
    """
    joined = members.join(limits, "entity")
    upper = F.when(F.col("coef") >= 0, F.col("upper")).otherwise(-F.col("lower"))
    lower = F.when(F.col("coef") >= 0, F.col("lower")).otherwise(-F.col("upper"))
    return joined.select(*by, "month", upper.alias("_u"), lower.alias("_l")).groupBy(*by, "month").agg(strict_sum(F.col("_u")).alias("upper"), strict_sum(F.col("_l")).alias("lower"))


def derived_metric(facts: DataFrame, keys: list[str], name: str, minuend: str, subtrahend: str, op: str = "sub") -> DataFrame:
    """Rows of a calculated metric, present where both operands are; division by zero is null (J-14)."""
    wide = facts.filter(F.col("quantity").isin(minuend, subtrahend)).groupBy(*keys).agg(
        F.max(F.when(F.col("quantity") == minuend, F.col("value"))).alias("_a"),
        F.max(F.when(F.col("quantity") == subtrahend, F.col("value"))).alias("_b"),
        F.count_distinct("quantity").alias("_n"),
    )
    value = F.try_divide(F.col("_a"), F.col("_b")) if op == "div" else F.col("_a") - F.col("_b")
    return wide.filter("_n = 2").select(*keys, F.lit(name).alias("quantity"), value.alias("value"))


def period_total(df: DataFrame, by: list[str], temporal: str = "temporal", value: str = "value") -> DataFrame:
    """The total over hours where the unit's temporal rule is SUM, else null (A-26)."""
    return df.groupBy(*by, temporal).agg(F.when(F.col(temporal) == "SUM", F.sum(value)).alias("total"))
