"""Limits and percent of range (W-04, W-05, J-07 to J-10, A-27, A-28, J-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casehours.functions import calendar as cal

NO_LIMIT = 90000


def limits_for_cases(limits: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, interface, side, month, value: a case's own table wins whole, else the shared one (J-08)."""
    own = limits.filter("scope_case is not null").select("scope_case").distinct()
    named = cases.select("case_id").distinct()
    scopes = named.join(own, F.col("case_id") == F.col("scope_case"), "left").withColumnRenamed("scope_case", "_scope")
    return scopes.join(limits, F.col("_scope").eqNullSafe(F.col("scope_case"))).select("case_id", F.trim("interface").alias("interface"), "side", "month", "value")


def two_sided(limits: DataFrame, by: list[str]) -> DataFrame:
    """upper (MAX) and lower (MIN) of each month."""
    return limits.groupBy(*by, "month").agg(F.max(F.when(F.col("side") == "MAX", F.col("value"))).alias("upper"), F.max(F.when(F.col("side") == "MIN", F.col("value"))).alias("lower"))


def hourly_limits(series: DataFrame, limits: DataFrame, by: list[str]) -> DataFrame:
    """``series`` with upper and lower of its month, null on phantoms (J-07)."""
    month = F.when(~cal.is_phantom(), cal.month_of())
    return series.withColumn("month", month).join(limits, [*by, "month"], "left").drop("month")


def limit_lines(series: DataFrame, unit: str, by: list[str]) -> DataFrame:
    """side, year, slot_hour, limit: MW only, blank where the series is blank, a blank side left out (J-09)."""
    lines = series.select(*by, "year", "slot_hour", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.when(F.col("value").isNotNull(), F.col(s)).alias("limit")) for s in ("upper", "lower")])).alias("x")).select(*by, "year", "slot_hour", "x.*")
    sides = lines.filter("limit is not null").select(*by, "side").distinct()
    return lines.join(sides, [*by, "side"], "left_semi").filter(F.lit(unit) == "MW")


def percent_of_range(series: DataFrame, by: list[str], upper: str = "upper", lower: str = "lower", scale: float = 1.0) -> DataFrame:
    """``series`` with ratio and used (side and source), over the unfiltered peak and trough (W-04).

    Filter hours after this: the extremes are those of all hours.
    """
    w = Window.partitionBy(*by)
    v = F.col("value")
    peak, trough = F.max(F.greatest(v, F.lit(0.0))).over(w), F.min(F.least(v, F.lit(0.0))).over(w)
    out = series.withColumn("_peak", peak).withColumn("_trough", trough)
    up = F.when(F.col(upper) > 0, F.col(upper)).otherwise(F.col("_peak"))
    up_source = F.when(F.col(upper) > 0, "limit").otherwise("peak")
    low_limit, low_peak = F.col(lower) < 0, F.col(lower).isNull() | (up <= 0)
    ratio = (
        F.when(v.isNull(), None)
        .when((v < 0) & low_limit, -F.abs(F.try_divide(v, F.col(lower))) * scale)
        .when((v < 0) & low_peak, -F.abs(F.try_divide(v, F.col("_trough"))) * scale)
        .otherwise(F.when(up > 0, F.try_divide(v, up) * scale).otherwise(0.0))
    )
    used = F.when(v.isNull(), None).when((v < 0) & low_limit, "lower:limit").when((v < 0) & low_peak, "lower:peak").otherwise(F.concat(F.lit("upper:"), up_source))
    return out.withColumn("ratio", ratio).withColumn("used", used).drop("_peak", "_trough")


def range_labels(ranged: DataFrame, by: list[str]) -> DataFrame:
    """Per side, what the shown hours were divided by: limit, peak, mixed or null (W-05)."""
    def label(side: str) -> Column:
        limit, peak = F.count_if(F.col("used") == f"{side}:limit"), F.count_if(F.col("used") == f"{side}:peak")
        return F.when((limit > 0) & (peak > 0), "mixed").when(limit > 0, "limit").when(peak > 0, "peak")

    return ranged.groupBy(*by).agg(label("upper").alias("upper_by"), label("lower").alias("lower_by"))


def nameplate(members: DataFrame, unit_list: DataFrame, by: list[str]) -> DataFrame:
    """Summed caps of the units of a series: max counts only above 0, any min counts (J-10); and units without a max (Q-14).

    Where no unit has a max, the peak is the divisor, which nothing exceeds: then none counts as capless.
    """
    joined = members.join(unit_list, "entity", "left")
    own = F.when(F.col("pmax") > 0, F.col("pmax"))
    return joined.groupBy(*by).agg(F.sum(own).alias("pmax"), F.sum("pmin").alias("pmin"), F.when(F.count(own) > 0, F.count_if(own.isNull())).otherwise(0).alias("capless"))


def flow_extremes(flows: DataFrame) -> DataFrame:
    """Highest and lowest flow of each interface and month."""
    return flows.filter(~cal.is_phantom()).groupBy(F.col("entity").alias("interface"), cal.month_of().alias("month")).agg(F.max("value").alias("highest"), F.min("value").alias("lowest"))


#: By how much of a limit a flow may pass it, and the shares of a limit that findings name.
PASSED_BY, HALF, HUNDREDTH = 0.01, 0.5, 0.01


def limit_finding(side: Column, flow: Column, limit: Column) -> Column:
    """How an extreme flow lies to the limit of its side (A-27).

    Whether it passed the limit is asked first; a maximum at or below zero is a ceiling and a minimum at or above zero a floor,
    of which a share says nothing.
    """
    past = F.when(side == "MAX", flow - limit).otherwise(limit - flow)
    share = F.try_divide(F.abs(flow), F.abs(limit))
    return (
        F.when(flow.isNull(), "no flow")
        .when(limit.isNull(), "no limit")
        .when(past > PASSED_BY * F.abs(limit), "exceeded")
        .when((side == "MAX") & (limit <= 0), "ceiling")
        .when((side == "MIN") & (limit >= 0), "floor")
        .when(F.sign(flow) == -F.sign(limit), "opposite sign")
        .when(share >= HALF, "50-100%")
        .when(share >= HUNDREDTH, "under 50%")
        .otherwise("under 1%")
    )


def limit_audit(extremes: DataFrame, limits: DataFrame) -> DataFrame:
    """interface, month, side, flow, limit, finding (A-27): the extreme flow of the side against its limit."""
    joined = limits.join(extremes, ["interface", "month"])
    flow = F.when(F.col("side") == "MAX", F.col("highest")).otherwise(F.col("lowest"))
    return joined.select("interface", "month", "side", flow.alias("flow"), F.col("value").alias("limit"), limit_finding(F.col("side"), flow, F.col("value")).alias("finding"))


def finding_shares(audit: DataFrame) -> DataFrame:
    """side, finding, n, share: findings by side, sides, and all month-sides (nulls: of all), by rollup; share is of the level above (A-27)."""
    counts = audit.rollup("side", "finding").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    above = F.when(F.col("level") == 0, F.max(F.when(F.col("level") == 1, F.col("n"))).over(Window.partitionBy("side"))).otherwise(F.max("n").over(Window.partitionBy(F.lit(1))))  # a row a finding and side
    return counts.select("side", "finding", "n", (F.col("n") / above).alias("share"))


def limit_name_match(limit_names: DataFrame, flow_names: DataFrame) -> DataFrame:
    """interface, match (exact, case, spaces, none) of limit names against flow names (J-17, Q-17)."""
    case = lambda c: F.lower(F.trim(c))
    space = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", "")
    names = limit_names.select("interface").distinct()
    for label, form in (("exact", F.trim), ("case", case), ("spaces", space)):
        side = flow_names.select(form(F.col("interface")).alias("_f")).distinct().withColumn(f"_{label}", F.lit(True))
        names = names.join(side, form(F.col("interface")) == F.col("_f"), "left").drop("_f")
    match = F.when(F.col("_exact"), "exact").when(F.col("_case"), "case").when(F.col("_spaces"), "spaces").otherwise("none")
    return names.select("interface", match.alias("match"))


def limit_match_report(limits: DataFrame, flows: DataFrame) -> DataFrame:
    """case_id, matched, total: how many of a case's interfaces its limits name (Q-17). ``limits`` from ``limits_for_cases``."""
    named = limits.select("case_id", F.trim("interface").alias("_i")).distinct().withColumn("_hit", F.lit(True))
    joined = flows.select("case_id", F.trim("interface").alias("_i")).distinct().join(named, ["case_id", "_i"], "left")
    return joined.groupBy("case_id").agg(F.count("_hit").alias("matched"), F.count(F.lit(1)).alias("total"))


def paths_without_limits(limit_names: DataFrame, flow_names: DataFrame) -> DataFrame:
    """Interfaces with flows that no limit names (J-17)."""
    return flow_names.select(F.trim("interface").alias("interface")).distinct().join(limit_names.select(F.trim("interface").alias("interface")).distinct(), "interface", "left_anti")


def limit_profile(limits: DataFrame) -> DataFrame:
    """One row about a limits table: rows, blank, near the no-limit threshold, varying within the year (A-28)."""
    per = limits.groupBy("interface", "side").agg(F.count_distinct("value").alias("levels"), F.count(F.lit(1)).alias("cells"), F.count_if(F.col("value").isNull()).alias("blank"), F.count_if(F.abs("value").between(0.9 * NO_LIMIT, NO_LIMIT)).alias("near"))
    return per.agg(F.count(F.lit(1)).alias("rows"), F.sum("cells").alias("cells"), F.sum("blank").alias("blank_cells"), F.sum("near").alias("near_threshold"), F.count_if(F.col("levels") > 1).alias("varying"))
