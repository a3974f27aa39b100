"""The test tables as hourly facts, in Spark and in DuckDB SQL.

case_id is the return flag, entity the supplier's nation, grp its region; the hour-ending is ``l_orderkey % 24 + 1`` (a
documented spread, because ship dates have no time). load sums quantities (MWh), price is extended price over quantity
($/MWh), net has negatives; money is in another currency at ``RATE`` (so that no value lies on a decimal grid, where engines
round ties differently). Time of use comes as a column: OnPeak is HE 7 to 22 on weekdays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casehours.functions import calendar as cal


RATE = 0.8731946237


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s_suppkey, entity, grp. nation and region have 25 and 5 rows by the benchmark's definition."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("n_name").alias("entity"), F.col("r_name").alias("grp"))
    return table(spark, sf_dir, "supplier").join(F.broadcast(named), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "entity", "grp")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, entity, grp, year, slot_hour, load, price, net, tou."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_shipdate", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
    joined = lines.join(places(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))
    keyed = joined.select(
        F.col("l_returnflag").alias("case_id"),
        "entity",
        "grp",
        F.year("l_shipdate").alias("year"),
        cal.slot_hour(F.col("l_shipdate"), F.col("l_orderkey") % 24 + 1).cast("int").alias("slot_hour"),
        "l_quantity",
        "l_extendedprice",
        (F.col("l_extendedprice") * (F.lit(0.05) - F.col("l_discount")) * RATE).alias("_net"),
    )
    out = keyed.groupBy("case_id", "entity", "grp", "year", "slot_hour").agg(F.sum("l_quantity").alias("load"), (F.sum("l_extendedprice") / F.sum("l_quantity") * RATE).alias("price"), F.sum("_net").alias("net"))
    return out.withColumn("tou", F.when(cal.he_of().between(7, 22) & (cal.weekday_of() < 5), "OnPeak").otherwise("OffPeak"))


def series_of(rows: DataFrame, metric: str) -> DataFrame:
    return rows.withColumn("value", F.col(metric)).drop("load", "price", "net")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, grp, coef: regions, and a second overlapping grouping; odd nations of it are reversed."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    regions = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("entity"), F.col("r_name").alias("grp"), F.lit(1).alias("coef"))
    other = nation.filter("n_nationkey % 3 <> 0").select(F.col("n_name").alias("entity"), F.lit("BOUNDARY").alias("grp"), F.when(F.col("n_nationkey") % 2 == 1, -1).otherwise(1).alias("coef"))
    return regions.unionByName(other)


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope_case, interface, side, month, value from nations: shared limits, and a table of case R's own."""
    rows = table(spark, sf_dir, "nation").select("n_name", "n_nationkey", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    upper = F.when((F.col("n_nationkey") + F.col("month")) % 7 != 0, (F.col("n_nationkey") + 1) * 20.0 + F.col("month"))
    lower = F.when((F.col("n_nationkey") + F.col("month")) % 5 != 0, -(F.col("n_nationkey") + 1) * 10.0 + F.col("month"))
    sides = lambda scope, factor: rows.select(F.lit(scope).cast("string").alias("scope_case"), F.col("n_name").alias("interface"), F.explode(F.array(F.struct(F.lit("MAX").alias("side"), (upper * factor).alias("value")), F.struct(F.lit("MIN").alias("side"), (lower * factor).alias("value")))).alias("x"), "month", "n_nationkey")
    both = sides(None, 1.0).unionByName(sides("R", 2.0).filter("n_nationkey < 10"))
    return both.select("scope_case", "interface", "x.side", "month", "x.value")


LEAP = "(y % 4 = 0 AND y % 100 <> 0 OR y % 400 = 0)"

H = f"""
li AS (SELECT l_returnflag AS case_id, n_name AS entity, r_name AS grp, year(l_shipdate)::INT AS y, l_shipdate::DATE AS d, l_orderkey, l_quantity, l_extendedprice, l_discount
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
h0 AS (SELECT case_id, entity, grp, y AS year, d, l_orderkey % 24 + 1 AS he,
    ((dayofyear(d) - 1 + CASE WHEN NOT {LEAP} AND month(d) >= 3 THEN 1 ELSE 0 END) * 24 + l_orderkey % 24)::INT AS slot_hour,
    sum(l_quantity) AS load, sum(l_extendedprice) / sum(l_quantity) * {RATE}::DOUBLE AS price, sum(l_extendedprice * (0.05::DOUBLE - l_discount) * {RATE}::DOUBLE) AS net
  FROM li GROUP BY ALL),
h AS (SELECT *, slot_hour // 24 AS slot_day, month(d) AS month, isodow(d) - 1 AS dow, (month(d) % 12) // 3 AS season,
    CASE WHEN he BETWEEN 7 AND 22 AND isodow(d) < 6 THEN 'OnPeak' ELSE 'OffPeak' END AS tou FROM h0)"""

MEMBERS = """
m AS (SELECT n_name AS entity, r_name AS grp, 1 AS coef FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT n_name, 'BOUNDARY', CASE WHEN n_nationkey % 2 = 1 THEN -1 ELSE 1 END FROM nation WHERE n_nationkey % 3 <> 0)"""

LIMITS = """
lr AS (SELECT n_name AS interface, n_nationkey AS k, range AS month FROM nation, range(1, 13)),
lb AS (SELECT *, CASE WHEN (k + month) % 7 <> 0 THEN (k + 1) * 20.0::DOUBLE + month END AS up, CASE WHEN (k + month) % 5 <> 0 THEN -(k + 1) * 10.0::DOUBLE + month END AS lo FROM lr),
lim AS (SELECT NULL AS scope_case, interface, 'MAX' AS side, month, up AS value FROM lb UNION ALL SELECT NULL, interface, 'MIN', month, lo FROM lb
  UNION ALL SELECT 'R', interface, 'MAX', month, up * 2.0 FROM lb WHERE k < 10 UNION ALL SELECT 'R', interface, 'MIN', month, lo * 2.0 FROM lb WHERE k < 10),
cases AS (SELECT DISTINCT l_returnflag AS case_id FROM lineitem),
cl AS (SELECT c.case_id, lim.* EXCLUDE scope_case FROM cases c JOIN lim ON scope_case = c.case_id
  UNION ALL SELECT c.case_id, lim.* EXCLUDE scope_case FROM cases c JOIN lim ON scope_case IS NULL WHERE c.case_id NOT IN (SELECT scope_case FROM lim WHERE scope_case IS NOT NULL)),
sides AS (SELECT case_id, interface, month, max(value) FILTER (side = 'MAX') AS upper, max(value) FILTER (side = 'MIN') AS lower FROM cl GROUP BY ALL)"""


def stats_sql(value: str, digits: int = 4) -> str:
    r = lambda x: f"round({x}, {digits})"
    return (
        f"count({value}) AS n, {r(f'avg({value})')} AS mean, {r(f'min({value})')} AS min, {r(f'max({value})')} AS max, {r(f'stddev_samp({value})')} AS sd, {r(f'sum({value})')} AS total, "
        f"count(*) FILTER ({value} > 0) AS n_pos, {r(f'avg({value}) FILTER ({value} > 0)')} AS mean_pos, count(*) FILTER ({value} < 0) AS n_neg, {r(f'avg({value}) FILTER ({value} < 0)')} AS mean_neg, count(*) FILTER ({value} = 0) AS n_zero"
    )


def box_sql(source: str, by: str, value: str = "value") -> str:
    """Box plots of ``source`` by ``by`` as SQL."""
    return f"""
q AS (SELECT {by}, count({value}) AS n, min({value}) AS mn, quantile_cont({value}, 0.25) AS p25, quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS p75, max({value}) AS mx FROM {source} GROUP BY {by}),
b AS (SELECT q.*, x.{value} AS v FROM {source} x JOIN q USING ({by})),
box AS (SELECT {by}, n, round(mn, 4) AS min, round(p25, 4) AS p25, round(median, 4) AS median, round(p75, 4) AS p75, round(mx, 4) AS max,
  round(min(v) FILTER (v BETWEEN p25 - 1.5 * (p75 - p25) AND p75 + 1.5 * (p75 - p25)), 4) AS whisker_low, round(max(v) FILTER (v BETWEEN p25 - 1.5 * (p75 - p25) AND p75 + 1.5 * (p75 - p25)), 4) AS whisker_high,
  count(*) FILTER (NOT v BETWEEN p25 - 1.5 * (p75 - p25) AND p75 + 1.5 * (p75 - p25)) AS outliers, mn = mx AS degenerate FROM b GROUP BY {by}, n, mn, p25, median, p75, mx)"""
