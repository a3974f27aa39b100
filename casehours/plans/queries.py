"""Registered queries of the reference's operators, each beside its DuckDB SQL. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casehours.functions import calendar as cal
from casehours.functions import rules
from casehours.operators import browse, combine, filters, groups, ranges, shapes, stats
from casehours.plans.facts import H, LIMITS, MEMBERS, box_sql, hourly, limits, memberships, series_of, stats_sql, table
from casehours.session import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def group_series(spark: SparkSession, sf: str, metric: str = "net") -> DataFrame:
    """The regions' series: case_id, grp, year, slot_hour, value, tou."""
    return hourly(spark, sf).groupBy("case_id", "grp", "year", "slot_hour", "tou").agg(F.sum(metric).alias("value"))


G = "g AS (SELECT case_id, grp, year, slot_hour, slot_day, month, he, dow, d, season, tou, sum(net) AS value FROM h GROUP BY ALL)"

# ---------------------------------------------------------------- flagship, calendar, hour filters

WEIGHTED = """
w AS (SELECT case_id, grp, year, slot_hour, he, dow, month, count(DISTINCT entity) AS e, avg(price) AS plain, sum(price * load) AS vw, sum(load) AS sw FROM h GROUP BY ALL),
k AS (SELECT case_id, grp, count(DISTINCT entity) AS e FROM h GROUP BY ALL),
ws AS (SELECT w.case_id, w.grp, year, slot_hour, he, dow, month, CASE WHEN k.e > 1 AND sw <> 0 THEN vw / sw ELSE plain END AS value, CASE WHEN k.e > 1 THEN sw END AS weight FROM w JOIN k USING (case_id, grp))"""

WEEKDAY_HOURS = filters.HourFilter(hours_ending=tuple(range(7, 23)), weekdays=(0, 1, 2, 3, 4))


def price_series(spark: SparkSession, sf: str) -> DataFrame:
    return combine.weighted_series(hourly(spark, sf), ["case_id", "grp"], "price", "load")


@query(f"WITH {H}, {WEIGHTED} SELECT case_id, grp, {stats_sql('value')} FROM ws WHERE he BETWEEN 7 AND 22 AND dow < 5 GROUP BY ALL")
def weighted_price_stats(spark: SparkSession, sf: str) -> DataFrame:
    """C-01, J-05, A-06, F-01, A-09: load-weighted price of a region on weekdays HE 7 to 22, by case."""
    return stats.series_stats(price_series(spark, sf).filter(WEEKDAY_HOURS.predicate()), ["case_id", "grp"], ndigits=4)


@query("""
WITH s AS (SELECT min(year(l_shipdate)) AS a, max(year(l_shipdate)) AS b FROM lineitem),
y AS (SELECT range AS y FROM s, range(a, b + 1)), t AS (SELECT y, range AS slot_hour, range // 24 AS slot_day, range % 24 + 1 AS he, DATE '2000-01-01' + (range // 24)::INT AS ld FROM y, range(8784)),
c AS (SELECT *, month(ld) AS month, day(ld) AS day, NOT (y % 4 = 0 AND y % 100 <> 0 OR y % 400 = 0) AND slot_day = 59 AS phantom FROM t)
SELECT y::INT AS year, slot_hour::INT AS slot_hour, slot_day::INT AS slot_day, month::INT AS month, day::INT AS day, (isodow(CASE WHEN NOT phantom THEN make_date(y, month, CASE WHEN phantom THEN 28 ELSE day END) END) - 1)::INT AS dow, he::INT AS he, ((month % 12) // 3)::INT AS season, phantom FROM c""")
def slot_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """C-02, C-05: the calendar of the years that lineitem spans."""
    span = table(spark, sf, "lineitem").agg(F.min(F.year("l_shipdate")).alias("a"), F.max(F.year("l_shipdate")).alias("b")).first()
    return cal.calendar(spark, span["a"], span["b"] - span["a"] + 1)


@query(f"""WITH {H}, s AS (SELECT case_id, min(year) AS a, max(year) AS b FROM h GROUP BY 1)
SELECT case_id, a AS first_year, (b - a + 1)::INT AS num_years, (SELECT sum(CASE WHEN (y % 4 = 0 AND y % 100 <> 0 OR y % 400 = 0) THEN 8784 ELSE 8760 END) FROM range(a, b + 1) AS t(y))::BIGINT AS real_hours FROM s""")
def real_hours(spark: SparkSession, sf: str) -> DataFrame:
    """C-03: real hours of each case's span."""
    spans = hourly(spark, sf).groupBy("case_id").agg(F.min("year").alias("first_year"), (F.max("year") - F.min("year") + 1).alias("num_years"))
    return cal.real_hours(spans)


@query(f"""WITH {H}, s AS (SELECT case_id, entity, count(DISTINCT (year, slot_hour)) AS hours_seen, min(year) AS a, max(year) AS b FROM h GROUP BY 1, 2)
SELECT case_id, entity, hours_seen, (SELECT sum(CASE WHEN (y % 4 = 0 AND y % 100 <> 0 OR y % 400 = 0) THEN 8784 ELSE 8760 END) FROM range(a, b + 1) AS t(y))::BIGINT AS real_hours FROM s""")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """C-04, Q-08: hours that each entity has of its span."""
    return cal.coverage(hourly(spark, sf), ["case_id", "entity"])


@query(f"WITH {H} SELECT case_id, entity, {stats_sql('net')} FROM h WHERE year IN (1996, 1997, 1999) AND season IN (0, 2) AND tou = 'OnPeak' GROUP BY ALL")
def hour_filter_stats(spark: SparkSession, sf: str) -> DataFrame:
    """F-01, A-09: years, seasons and time of use together."""
    f = filters.HourFilter(years=(1996, 1997, 1999), seasons=(0, 2), tou="OnPeak")
    return stats.series_stats(series_of(hourly(spark, sf).filter(f.predicate()), "net"), ["case_id", "entity"], ndigits=4)


@query(f"WITH {H} SELECT case_id, entity, {stats_sql('load')} FROM h WHERE slot_day BETWEEN 50 AND 75 OR slot_day BETWEEN 300 AND 365 GROUP BY ALL")
def date_runs_filter(spark: SparkSession, sf: str) -> DataFrame:
    """F-02: overlapping and touching runs of days merge."""
    f = filters.HourFilter(date_runs=((60, 75), (50, 59), (340, 400), (300, 345)))
    return stats.series_stats(series_of(hourly(spark, sf).filter(f.predicate()), "load"), ["case_id", "entity"], ndigits=4)


@query(f"WITH {H}, f AS (SELECT min(year) AS f FROM h) SELECT case_id, min((year - f) * 8784 + slot_hour)::INT AS first_hour, max((year - f) * 8784 + slot_hour)::INT AS last_hour, count(*) AS cells FROM h, f GROUP BY 1")
def common_axis(spark: SparkSession, sf: str) -> DataFrame:
    """C-06: the extent of each case on one axis."""
    return cal.on_common_axis(facts_once(spark, sf)).groupBy("case_id").agg(F.min("axis_hour").cast("int").alias("first_hour"), F.max("axis_hour").cast("int").alias("last_hour"), F.count(F.lit(1)).alias("cells"))


# ---------------------------------------------------------------- boxes and ranked tables


def _box(dimension: str, dim_sql: str) -> None:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        s = group_series(spark, sf).withColumn("grp", F.concat_ws("/", "case_id", "grp"))
        return rounded(shapes.boxes(s.withColumn("entity", F.col("grp")), ["grp"], dimension))

    f.__name__ = f"box_by_{dimension}"
    f.__doc__ = f"A-10, A-14: boxes by {dimension}."
    source = f"gx AS (SELECT case_id || '/' || grp AS grp, {dim_sql} AS dim, value FROM g)"
    query(f"WITH {H}, {G}, {source}, {box_sql('gx', 'grp, dim')} SELECT * FROM box")(f)


for _d, _s in (("year", "year"), ("month", "month"), ("hourOfDay", "he"), ("dayOfWeek", "dow"), ("season", "season"), ("case", "case_id")):
    _box(_d, _s)


@query(f"""WITH {H}, e AS (SELECT DISTINCT n_name AS entity FROM nation), c AS (SELECT DISTINCT case_id FROM h), s AS (SELECT case_id, entity FROM e, c),
r AS (SELECT case_id, entity, {stats_sql('x.net')} FROM s LEFT JOIN h x USING (case_id, entity) GROUP BY ALL) SELECT * FROM r""")
def ranked_entities(spark: SparkSession, sf: str) -> DataFrame:
    """A-12: every nation in scope, those without data too."""
    h = facts_once(spark, sf)
    scope = table(spark, sf, "nation").select(F.col("n_name").alias("entity")).crossJoin(F.broadcast(h.select("case_id").distinct()))
    return stats.ranked_stats(scope, series_of(h, "net"), ["case_id", "entity"], ndigits=4)


@query(f"""WITH {H}, s AS (SELECT case_id, 'Nation ' || n_nationkey AS name, round(avg(net), 4) AS mean FROM h JOIN nation ON n_name = entity GROUP BY ALL)
SELECT case_id, name, mean, row_number() OVER (PARTITION BY case_id ORDER BY lpad(regexp_extract(name, '[0-9]+'), 12, '0'))::INT AS place FROM s""")
def ranked_nat_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """O-01, O-05: natural order of names."""
    n = table(spark, sf, "nation").select(F.col("n_name").alias("entity"), F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("name"))
    s = hourly(spark, sf).join(F.broadcast(n), "entity").groupBy("case_id", "name").agg(F.round(F.avg("net"), 4).alias("mean"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy(browse.natural_key(F.col("name")))))


@query(f"WITH {H}, s AS (SELECT case_id, entity, round(sum(net), 4) AS total FROM h GROUP BY ALL) SELECT case_id, entity, total, row_number() OVER (PARTITION BY case_id ORDER BY total DESC NULLS LAST, entity)::INT AS rank FROM s")
def ranked_by_total(spark: SparkSession, sf: str) -> DataFrame:
    """O-01: rank by a statistic, blanks last, ties by name."""
    s = hourly(spark, sf).groupBy("case_id", "entity").agg(F.round(F.sum("net"), 4).alias("total"))
    return browse.ranked_table(s, ["case_id"], "total", "entity").select("case_id", "entity", "total", "rank")


@query("SELECT DISTINCT p_type AS value FROM part ORDER BY value LIMIT 100")
def distinct_checklist(spark: SparkSession, sf: str) -> DataFrame:
    """O-02: the checklist of a column; 100 is the feature's own cap."""
    return browse.distinct_values(table(spark, sf, "part"), "p_type")


# ---------------------------------------------------------------- combining entities


@query(f"WITH {H}, {MEMBERS}, s AS (SELECT case_id, m.grp, year, slot_hour, sum(net) AS value FROM h JOIN m USING (entity) GROUP BY ALL) SELECT case_id, grp, {stats_sql('value')} FROM s GROUP BY ALL")
def group_sum(spark: SparkSession, sf: str) -> DataFrame:
    """J-05, A-01, A-13: statistics of group sums, groups overlapping."""
    f = combine.expand_groups(series_of(hourly(spark, sf), "net").drop("grp"), memberships(spark, sf))
    return stats.series_stats(combine.sum_series(f, ["case_id", "grp"]), ["case_id", "grp"], ndigits=4)


@query(f"WITH {H}, {MEMBERS}, s AS (SELECT case_id, year, slot_hour, sum(load * coef) AS value FROM h JOIN m USING (entity) WHERE m.grp = 'BOUNDARY' GROUP BY ALL) SELECT case_id, {stats_sql('value')} FROM s GROUP BY ALL")
def signed_boundary(spark: SparkSession, sf: str) -> DataFrame:
    """A-02: members with a direction."""
    f = series_of(hourly(spark, sf), "load").drop("grp").join(memberships(spark, sf).filter("grp = 'BOUNDARY'"), "entity")
    return stats.series_stats(combine.sum_series(f, ["case_id"], coef="coef"), ["case_id"], ndigits=4)


@query(f"""WITH {H}, lst AS (SELECT n_name AS entity, CASE WHEN n_nationkey % 5 = 0 THEN ' ' ELSE 'B' || n_regionkey END AS bucket FROM nation WHERE n_nationkey % 4 <> 0),
s AS (SELECT case_id, CASE WHEN lst.entity IS NULL THEN '(unlisted)' WHEN trim(bucket) = '' THEN '(blank)' ELSE trim(bucket) END AS bucket, year, slot_hour, sum(load) AS value FROM h LEFT JOIN lst USING (entity) GROUP BY ALL)
SELECT case_id, bucket, {stats_sql('value')} FROM s GROUP BY ALL""")
def bucket_sum(spark: SparkSession, sf: str) -> DataFrame:
    """J-02, A-03, T-15: sums by a list attribute, unlisted and blank kept apart."""
    n = table(spark, sf, "nation").filter("n_nationkey % 4 <> 0").select(F.col("n_name").alias("entity"), F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise(F.concat(F.lit("B"), F.col("n_regionkey").cast("string"))).alias("bucket"))
    f = groups.with_attributes(series_of(hourly(spark, sf), "load"), n, ["bucket"])
    return stats.series_stats(combine.sum_series(f, ["case_id", "bucket"]), ["case_id", "bucket"], ndigits=4)


@query(f"WITH {H}, s AS (SELECT case_id, year, slot_hour, sum(net) AS value FROM h GROUP BY ALL) SELECT case_id, {stats_sql('value')} FROM s GROUP BY ALL")
def case_total(spark: SparkSession, sf: str) -> DataFrame:
    """A-08: all entities of a case as one series."""
    return stats.series_stats(combine.sum_series(series_of(hourly(spark, sf), "net"), ["case_id"]), ["case_id"], ndigits=4)


@query(f"""WITH {H}, {MEMBERS}, a AS (SELECT entity, grp FROM m UNION ALL SELECT DISTINCT entity, 'All areas' FROM h), s AS (SELECT case_id, a.grp, year, slot_hour, avg(price) AS value FROM h JOIN a USING (entity) GROUP BY ALL)
SELECT case_id, grp, {stats_sql('value')} FROM s GROUP BY ALL""")
def area_mean(spark: SparkSession, sf: str) -> DataFrame:
    """A-05, J-06: plain means, with the group of all areas."""
    h = series_of(hourly(spark, sf), "price").drop("grp")
    m = combine.with_all_areas(memberships(spark, sf), table(spark, sf, "nation").select(F.col("n_name").alias("entity")))
    return stats.series_stats(combine.mean_series(h.join(m, "entity"), ["case_id", "grp"]), ["case_id", "grp"], ndigits=4)


@query(f"WITH {H}, {WEIGHTED} SELECT case_id, grp, year, month, round(avg(value), 4) AS mean, round(min(value), 4) AS low, round(max(value), 4) AS high, count(value) AS n FROM ws GROUP BY ALL")
def weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    """A-06: the weighted series by month."""
    s = price_series(spark, sf).groupBy("case_id", "grp", "year", cal.month_of().alias("month"))
    return s.agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"), F.count("value").alias("n"))


@query(f"""WITH {H}, x AS (SELECT *, CASE WHEN grp = 'ASIA' THEN 0.0::DOUBLE WHEN grp = 'EUROPE' AND he < 4 THEN 0.0 ELSE load END AS w1 FROM h),
t AS (SELECT case_id, grp, year, slot_hour, avg(price) AS plain, sum(price * w1) AS v1, sum(w1) AS s1, sum(price * load) AS v2, sum(load) AS s2 FROM x GROUP BY ALL),
u AS (SELECT case_id, grp, count(*) FILTER (s1 <> 0) > 0 AS first FROM t GROUP BY ALL), e AS (SELECT case_id, grp, count(DISTINCT entity) AS e FROM h GROUP BY ALL),
s AS (SELECT case_id, grp, CASE WHEN e.e = 1 THEN NULL WHEN first THEN 'w1' ELSE 'load' END AS weight_used, CASE WHEN e.e = 1 THEN plain WHEN first THEN CASE WHEN s1 <> 0 THEN v1 / s1 ELSE plain END ELSE CASE WHEN s2 <> 0 THEN v2 / s2 ELSE plain END END AS value,
  CASE WHEN e.e = 1 THEN NULL WHEN first THEN s1 ELSE s2 END AS weight FROM t JOIN u USING (case_id, grp) JOIN e USING (case_id, grp))
SELECT case_id, grp, weight_used, round(avg(value), 4) AS mean, count(value) AS n, count(*) FILTER (weight = 0) AS zero_weight_hours FROM s GROUP BY ALL""")
def weighted_mean_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """A-06, Q-13: a zero weight over all hours falls back, zero hours are plain means."""
    h = hourly(spark, sf).withColumn("w1", F.when(F.col("grp") == "ASIA", 0.0).when((F.col("grp") == "EUROPE") & (cal.he_of() < 4), 0.0).otherwise(F.col("load")))
    s = combine.weighted_series(h, ["case_id", "grp"], "price", "w1", "load")
    return s.groupBy("case_id", "grp", "weight_used").agg(F.round(F.avg("value"), 4).alias("mean"), F.count("value").alias("n"), F.count_if(F.col("weight") == 0).alias("zero_weight_hours"))


@query(f"WITH {H}, {WEIGHTED} SELECT case_id, grp, round(sum(value * weight) / sum(weight), 4) AS pooled_mean FROM ws WHERE he BETWEEN 7 AND 22 AND dow < 5 GROUP BY ALL")
def pooled_mean(spark: SparkSession, sf: str) -> DataFrame:
    """A-07: the pooled weighted mean of the kept hours."""
    return rounded(combine.pooled_mean(price_series(spark, sf).filter(WEEKDAY_HOURS.predicate()), ["case_id", "grp"]))


def _long(spark: SparkSession, sf: str) -> DataFrame:
    h = hourly(spark, sf)
    both = F.explode(F.array(F.struct(F.lit("Load (MWh)").alias("quantity"), F.col("load").alias("value")), F.struct(F.lit("Net ($)").alias("quantity"), F.col("net").alias("value"))))
    return h.select("case_id", "entity", "year", "slot_hour", both.alias("x")).select("case_id", "entity", "year", "slot_hour", "x.*").filter("not (quantity = 'Net ($)' and slot_hour % 5 = 0)")


@query(f"WITH {H} SELECT case_id, entity, 'Load - Net' AS quantity, count(*) AS n, round(sum(load - net), 4) AS total FROM h WHERE slot_hour % 5 <> 0 GROUP BY 1, 2")
def calculated_diff(spark: SparkSession, sf: str) -> DataFrame:
    """J-14: a difference, present where both operands are."""
    d = combine.derived_metric(_long(spark, sf), ["case_id", "entity", "year", "slot_hour"], "Load - Net", "Load (MWh)", "Net ($)")
    return d.groupBy("case_id", "entity", "quantity").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {H} SELECT case_id, entity, 'Load / Net' AS quantity, count(*) AS n, count(CASE WHEN net <> 0 THEN load / net END) AS n_values, round(avg(CASE WHEN abs(net) > 1 THEN load / net END), 4) AS mean FROM h WHERE slot_hour % 5 <> 0 GROUP BY 1, 2")
def calculated_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """J-14, Q-12: a ratio, null where the denominator is zero."""
    d = combine.derived_metric(_long(spark, sf).withColumn("value", F.when((F.col("quantity") == "Net ($)") & (F.col("value") == 0), 0.0).otherwise(F.col("value"))), ["case_id", "entity", "year", "slot_hour"], "Load / Net", "Load (MWh)", "Net ($)", "div")
    d = d.join(hourly(spark, sf).select("case_id", "entity", "year", "slot_hour", "net"), ["case_id", "entity", "year", "slot_hour"])
    return d.groupBy("case_id", "entity", "quantity").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), F.round(F.avg(F.when(F.abs("net") > 1, F.col("value"))), 4).alias("mean"))


COMBINED_UNITS = ("MWh", "MW", "$/MWh", "%", "zz", "k$")
COMBINED_KINDS = ("bus", "generator", "interface")
RULES_SQL = "r(kind, unit, class, temporal) AS (VALUES " + ", ".join(f"('{k}', '{u}', '{c}', '{t}')" for k, own in rules.UNIT_RULES.items() for u, c, t in own) + ")"


@query(f"""WITH {RULES_SQL}, q AS (SELECT DISTINCT ({list(COMBINED_KINDS)!r})[p_partkey % 3 + 1] AS kind, p_brand || ' (' || ({list(COMBINED_UNITS)!r})[p_size % 6 + 1] || ')' AS quantity FROM part),
u AS (SELECT *, regexp_extract(quantity, '\\(([^()]*)\\)[^()]*$', 1) AS unit FROM q)
SELECT u.kind, quantity, u.unit, class, coalesce(temporal, 'MEAN') AS temporal, coalesce(class IN ('EXTENSIVE', 'RATE'), false) AS can_group,
  CASE WHEN class IS NULL THEN 'no rule for the unit' WHEN class = 'INTENSIVE' THEN 'an intensive quantity does not add up over entities' END AS reason
FROM u LEFT JOIN r ON u.kind = r.kind AND u.unit = r.unit""")
def combinable_quantities(spark: SparkSession, sf: str) -> DataFrame:
    """F-16, T-09, A-26: which quantities (brands of parts, with units in turn) may be summed over entities."""
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    quantity = F.concat("p_brand", F.lit(" ("), pick(COMBINED_UNITS, F.col("p_size") % 6), F.lit(")"))
    q = table(spark, sf, "part").select(pick(COMBINED_KINDS, F.col("p_partkey") % 3).alias("kind"), quantity.alias("quantity")).distinct()
    return groups.combinable(q, rules.unit_rules(spark))


@query(f"WITH {H} SELECT case_id, entity, 'SUM' AS temporal, round(sum(load), 4) AS total FROM h GROUP BY 1, 2 UNION ALL SELECT case_id, entity, 'MEAN', NULL FROM h GROUP BY 1, 2")
def period_total(spark: SparkSession, sf: str) -> DataFrame:
    """A-26: a total only where the unit's temporal rule allows it."""
    h = hourly(spark, sf)
    u = h.select("case_id", "entity", F.explode(F.array(F.struct(F.lit("MWh").alias("unit"), F.col("load").alias("value")), F.struct(F.lit("$/MWh").alias("unit"), F.col("price").alias("value")))).alias("x")).select("case_id", "entity", "x.*")
    r = rules.unit_rules(spark).filter("kind = 'generator'").select("unit", "temporal")
    return rounded(combine.period_total(u.join(r, "unit"), ["case_id", "entity"])).select("case_id", "entity", "temporal", "total")


# ---------------------------------------------------------------- column filters and keep-sets


@query(f"""WITH {H}, k AS (SELECT case_id, entity FROM h GROUP BY ALL HAVING avg(net) > 0), s AS (SELECT case_id, grp, year, slot_hour, sum(net) AS value FROM h SEMI JOIN k USING (case_id, entity) GROUP BY ALL) SELECT case_id, grp, {stats_sql('value')} FROM s GROUP BY ALL""")
def keepset_group(spark: SparkSession, sf: str) -> DataFrame:
    """F-08: a filter on statistics chooses entities before they are summed."""
    f = series_of(facts_once(spark, sf), "net")
    own = stats.series_stats(f, ["case_id", "entity"])
    kept = filters.keep_set(f, own, filters.range_filter(F.col("mean"), low=0.0) & (F.col("mean") > 0), ["case_id", "entity"])
    return stats.series_stats(combine.sum_series(kept, ["case_id", "grp"]), ["case_id", "grp"], ndigits=4)


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(trim(p_name)), 'al') OR contains(lower(trim(p_name)), 'en')")
def text_filter(spark: SparkSession, sf: str) -> DataFrame:
    """F-04: any typed piece occurs in the displayed cell."""
    return table(spark, sf, "part").filter(filters.text_filter(F.col("p_name"), "AL,\nEn")).select("p_partkey", "p_name")


@query("SELECT p_brand, count(*) AS parts FROM part WHERE trim(p_brand) IN ('Brand#11', 'Brand#23', 'Brand#55') GROUP BY 1")
def values_filter(spark: SparkSession, sf: str) -> DataFrame:
    """F-05: exact displayed cells."""
    return table(spark, sf, "part").filter(filters.values_filter(F.col("p_brand"), ["Brand#11", "Brand#23 ", "Brand#55"])).groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"))


@query("SELECT s_suppkey, round(s_acctbal, 4) AS s_acctbal FROM supplier WHERE s_acctbal BETWEEN 0 AND 5000.5")
def range_filter(spark: SparkSession, sf: str) -> DataFrame:
    """F-06: inclusive bounds, null fails."""
    return rounded(table(spark, sf, "supplier").filter(filters.range_filter(F.col("s_acctbal"), 0.0, 5000.5)).select("s_suppkey", "s_acctbal"))


@query(f"WITH {MEMBERS} SELECT entity, list_sort(list(DISTINCT grp)) AS groups FROM m GROUP BY 1 HAVING list_has_any(list(DISTINCT grp), ['ASIA', 'BOUNDARY'])")
def membership_any(spark: SparkSession, sf: str) -> DataFrame:
    """F-07, J-13: entities in any of the chosen groups."""
    m = groups.reverse_memberships(memberships(spark, sf))
    return m.filter(filters.membership_filter(F.col("groups"), ["ASIA", "BOUNDARY"]))


@query(f"""WITH {H}, a AS (SELECT n_name AS entity, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE r_name END AS area FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0),
e AS (SELECT DISTINCT entity FROM h) SELECT e.entity FROM e LEFT JOIN a USING (entity) WHERE a.entity IS NULL OR a.area IN ('ASIA', 'EUROPE')""")
def area_scope(spark: SparkSession, sf: str) -> DataFrame:
    """F-11: unlisted entities stay, listed ones of a blank or other area go."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    a = n.filter("n_nationkey % 4 <> 0").join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("entity"), F.when(F.col("n_nationkey") % 6 != 0, F.col("r_name")).alias("area"))
    return filters.in_area_scope(hourly(spark, sf).select("entity").distinct(), a, ["ASIA", "EUROPE"])


@query(f"WITH {H} SELECT case_id, entity, count(*) FILTER (month = 2 AND he = 3 AND year = 1996) AS n FROM h GROUP BY ALL HAVING count(*) FILTER (month = 2 AND he = 3 AND year = 1996) > 0")
def without_empty_rows(spark: SparkSession, sf: str) -> DataFrame:
    """F-12, F-13: rows without a value in the kept hours are dropped."""
    h = facts_once(spark, sf)
    kept = h.filter(filters.HourFilter(years=(1996,), hours_ending=(3,), date_runs=((31, 59),)).predicate()).groupBy("case_id", "entity").agg(F.count("net").alias("n"))
    shown, _ = filters.split_empty(filters.with_presence(h.select("case_id", "entity").distinct(), h, ["case_id", "entity"]).join(kept, ["case_id", "entity"], "left").fillna(0, ["n"]))
    return shown


# ---------------------------------------------------------------- limits and ranges

RANGE = """
s AS (SELECT case_id, entity, year, slot_hour, month, he, dow, net AS value FROM h),
p AS (SELECT *, max(greatest(value, 0)) OVER w AS peak, min(least(value, 0)) OVER w AS trough FROM s WINDOW w AS (PARTITION BY case_id, entity)),
j AS (SELECT p.*, upper, lower, CASE WHEN upper > 0 THEN upper ELSE peak END AS up FROM p LEFT JOIN sides ON sides.case_id = p.case_id AND sides.interface = p.entity AND sides.month = p.month),
r AS (SELECT *, CASE WHEN value < 0 AND lower < 0 THEN -abs(value / lower) WHEN value < 0 AND (lower IS NULL OR up <= 0) THEN -abs(value / trough) WHEN up > 0 THEN value / up ELSE 0 END AS ratio,
  CASE WHEN value < 0 AND lower < 0 THEN 'lower:limit' WHEN value < 0 AND (lower IS NULL OR up <= 0) THEN 'lower:peak' ELSE 'upper:' || CASE WHEN upper > 0 THEN 'limit' ELSE 'peak' END END AS used FROM j)"""


def facts_once(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly facts as a table, for queries that read them more than once."""
    return written(hourly(spark, sf), "hourly-facts")


def cases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("case_id")).distinct()


def ranged(spark: SparkSession, sf: str) -> DataFrame:
    h = series_of(facts_once(spark, sf), "net")
    lim = ranges.two_sided(ranges.limits_for_cases(limits(spark, sf), h.select("case_id").distinct()), ["case_id", "interface"]).withColumnRenamed("interface", "entity")
    return ranges.percent_of_range(ranges.hourly_limits(h, lim, ["case_id", "entity"]), ["case_id", "entity"])


@query(f"WITH {H}, {LIMITS}, {RANGE} SELECT case_id, entity, count(ratio) AS n, round(avg(ratio), 4) AS mean, round(min(ratio), 4) AS low, round(max(ratio), 4) AS high FROM r WHERE he BETWEEN 7 AND 22 AND dow < 5 GROUP BY ALL")
def percent_of_range(spark: SparkSession, sf: str) -> DataFrame:
    """W-04, J-07, J-08: percent of range over unfiltered extremes, masked afterwards."""
    return ranged(spark, sf).filter(WEEKDAY_HOURS.predicate()).groupBy("case_id", "entity").agg(F.count("ratio").alias("n"), F.round(F.avg("ratio"), 4).alias("mean"), F.round(F.min("ratio"), 4).alias("low"), F.round(F.max("ratio"), 4).alias("high"))


@query(f"""WITH {H}, {LIMITS}, {RANGE}, c AS (SELECT case_id, entity, count(*) FILTER (used = 'upper:limit') AS a, count(*) FILTER (used = 'upper:peak') AS b, count(*) FILTER (used = 'lower:limit') AS x, count(*) FILTER (used = 'lower:peak') AS y FROM r WHERE he BETWEEN 7 AND 22 AND dow < 5 GROUP BY ALL)
SELECT case_id, entity, CASE WHEN a > 0 AND b > 0 THEN 'mixed' WHEN a > 0 THEN 'limit' WHEN b > 0 THEN 'peak' END AS upper_by, CASE WHEN x > 0 AND y > 0 THEN 'mixed' WHEN x > 0 THEN 'limit' WHEN y > 0 THEN 'peak' END AS lower_by FROM c""")
def range_label(spark: SparkSession, sf: str) -> DataFrame:
    """W-05: what the shown hours were divided by."""
    return ranges.range_labels(ranged(spark, sf).filter(WEEKDAY_HOURS.predicate()), ["case_id", "entity"])


@query(f"""WITH {MEMBERS}, {LIMITS}, t AS (SELECT case_id, grp, month, CASE WHEN coef >= 0 THEN upper ELSE -lower END AS u, CASE WHEN coef >= 0 THEN lower ELSE -upper END AS l FROM m JOIN sides ON interface = entity)
SELECT case_id, grp, month::INT AS month, CASE WHEN count(u) = count(*) THEN sum(u) END AS upper, CASE WHEN count(l) = count(*) THEN sum(l) END AS lower FROM t GROUP BY ALL""")
def boundary_range(spark: SparkSession, sf: str) -> DataFrame:
    """A-19: limits of a boundary; a reversed member swaps sides, a missing side makes it null."""
    lim = ranges.two_sided(ranges.limits_for_cases(limits(spark, sf), cases(spark, sf)), ["case_id", "interface"]).withColumnRenamed("interface", "entity")
    return combine.boundary_limits(lim, memberships(spark, sf), ["case_id", "grp"])


@query(f"""WITH {H}, {LIMITS}, x AS (SELECT h.case_id, h.entity, s.side, CASE WHEN h.load IS NOT NULL THEN CASE s.side WHEN 'upper' THEN upper ELSE lower END END AS lim FROM h LEFT JOIN sides ON sides.case_id = h.case_id AND sides.interface = h.entity AND sides.month = h.month, (VALUES ('upper'), ('lower')) AS s(side))
SELECT case_id, entity, side, count(*) AS hours, count(lim) AS drawn, round(sum(lim), 4) AS total FROM x GROUP BY ALL HAVING count(lim) > 0""")
def limit_line_hours(spark: SparkSession, sf: str) -> DataFrame:
    """J-09: limit lines of MW series, a blank side left out."""
    h = series_of(facts_once(spark, sf), "load")
    lim = ranges.two_sided(ranges.limits_for_cases(limits(spark, sf), h.select("case_id").distinct()), ["case_id", "interface"]).withColumnRenamed("interface", "entity")
    lines = ranges.limit_lines(ranges.hourly_limits(h, lim, ["case_id", "entity"]), "MW", ["case_id", "entity"])
    return lines.groupBy("case_id", "entity", "side").agg(F.count(F.lit(1)).alias("hours"), F.count("limit").alias("drawn"), F.round(F.sum("limit"), 4).alias("total"))


@query(f"""WITH {H}, u AS (SELECT n_name AS entity, sum(s_acctbal) FILTER (s_acctbal > 0) AS pmax, sum(s_acctbal) AS pmin, count(*) FILTER (NOT s_acctbal > 0) AS capless FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), s AS (SELECT case_id, entity, avg(load) AS mean FROM h GROUP BY ALL)
SELECT case_id, entity, round(mean / nullif(pmax, 0), 8) AS cf, round(pmin, 4) AS pmin, CASE WHEN pmax IS NULL THEN 0 ELSE capless END AS capless FROM s LEFT JOIN u USING (entity)""")
def capacity_factor(spark: SparkSession, sf: str) -> DataFrame:
    """A-20, J-10, Q-14: mean over summed caps."""
    n = table(spark, sf, "nation")
    units = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("pmax"), F.col("s_acctbal").alias("pmin"))
    members = table(spark, sf, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("series"), F.col("s_suppkey").alias("entity"))
    caps = ranges.nameplate(members, units, ["series"]).withColumnRenamed("series", "entity")
    mean = hourly(spark, sf).groupBy("case_id", "entity").agg(F.avg("load").alias("mean"))
    return mean.join(caps, "entity", "left").select("case_id", "entity", F.round(stats.capacity_factor(F.col("mean"), F.col("pmax")), 8).alias("cf"), F.round("pmin", 4).alias("pmin"), "capless")


AUDIT = """
x AS (SELECT entity AS interface, month, max(net) AS hi, min(net) AS lo FROM h GROUP BY ALL),
f AS (SELECT lim.interface, lim.month, side, CASE side WHEN 'MAX' THEN hi ELSE lo END AS flow, value AS lim FROM lim JOIN x ON x.interface = lim.interface AND x.month = lim.month WHERE scope_case IS NULL)"""


@query(f"""WITH {H}, {LIMITS}, {AUDIT} SELECT interface, month::INT AS month, side, round(flow, 4) AS flow, round(lim, 4) AS limit, CASE WHEN lim IS NULL THEN 'no limit' WHEN CASE side WHEN 'MAX' THEN flow - lim ELSE lim - flow END > 0.01::DOUBLE * abs(lim) THEN 'exceeded' WHEN side = 'MAX' AND lim <= 0 THEN 'ceiling' WHEN side = 'MIN' AND lim >= 0 THEN 'floor'
WHEN sign(flow) = -sign(lim) THEN 'opposite sign' WHEN abs(flow) / abs(lim) >= 0.5::DOUBLE THEN '50-100%' WHEN abs(flow) / abs(lim) >= 0.01::DOUBLE THEN 'under 50%' ELSE 'under 1%' END AS finding FROM f""")
def limit_audit(spark: SparkSession, sf: str) -> DataFrame:
    """A-27: extreme flows against limits."""
    h = series_of(hourly(spark, sf), "net")
    return rounded(ranges.limit_audit(ranges.flow_extremes(h), limits(spark, sf).filter("scope_case is null").drop("scope_case")))


@query(f"""WITH {LIMITS}, p AS (SELECT interface, side, count(DISTINCT value) AS levels, count(*) AS cells, count(*) FILTER (value IS NULL) AS blank, count(*) FILTER (abs(value) BETWEEN 81000 AND 90000) AS near FROM lim WHERE scope_case IS NULL GROUP BY ALL)
SELECT count(*) AS rows, sum(cells)::BIGINT AS cells, sum(blank)::BIGINT AS blank_cells, sum(near)::BIGINT AS near_threshold, count(*) FILTER (levels > 1) AS varying FROM p""")
def limit_profile(spark: SparkSession, sf: str) -> DataFrame:
    """A-28: a profile of a limits table."""
    return ranges.limit_profile(limits(spark, sf).filter("scope_case is null"))


@query(f"""WITH {H}, l AS (SELECT n_name, n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN substr(n_name, 1, 2) || '  ' || substr(n_name, 3) ELSE n_name || '?' END AS interface FROM nation), e AS (SELECT DISTINCT entity FROM h)
SELECT interface, CASE WHEN EXISTS (FROM e WHERE trim(entity) = trim(interface)) THEN 'exact' WHEN EXISTS (FROM e WHERE lower(trim(entity)) = lower(trim(interface))) THEN 'case' WHEN EXISTS (FROM e WHERE regexp_replace(lower(entity), '\\s+', '', 'g') = regexp_replace(lower(interface), '\\s+', '', 'g')) THEN 'spaces' ELSE 'none' END AS match FROM l""")
def limit_names(spark: SparkSession, sf: str) -> DataFrame:
    """J-17, Q-17: limit names against flow names."""
    k, n = F.col("n_nationkey") % 4, F.col("n_name")
    names = table(spark, sf, "nation").select(F.when(k == 0, n).when(k == 1, F.lower(n)).when(k == 2, F.concat(F.substring(n, 1, 2), F.lit("  "), F.expr("substr(n_name, 3)"))).otherwise(F.concat(n, F.lit("?"))).alias("interface"))
    return ranges.limit_name_match(names, hourly(spark, sf).select(F.col("entity").alias("interface")).distinct())
