"""Registered queries, second part: shapes, merges, keys, quality and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casehours import sinks
from casehours.functions import calendar as cal
from casehours.functions import cells, fuel
from casehours.operators import browse, groups, merge, series, shapes, stats
from casehours.plans.facts import H, LEAP, MEMBERS, RATE, hourly, memberships, series_of, table
from casehours.plans.queries import G, group_series, query, rounded
from casehours.session import written

# ---------------------------------------------------------------- curves, stacks, overlays


@query(f"""WITH {H}, {G}, k AS (SELECT case_id, grp, value, row_number() OVER w AS rank, count(*) OVER (PARTITION BY case_id, grp) AS n FROM g WHERE tou = 'OnPeak' WINDOW w AS (PARTITION BY case_id, grp ORDER BY value, year, slot_hour))
SELECT case_id, grp, rank::INT AS rank, n, round(CASE WHEN n > 1 THEN (rank - 1) / (n - 1) * 100 ELSE 0 END, 4) AS pct, round(value, 4) AS value FROM k""")
def duration_curve(spark: SparkSession, sf: str) -> DataFrame:
    """W-01: on-peak values ascending."""
    return rounded(shapes.duration_curve(group_series(spark, sf).filter("tou = 'OnPeak'"), ["case_id", "grp"]))


@query(f"""WITH {H}, {G}, k AS (SELECT case_id, grp, value, row_number() OVER (PARTITION BY case_id, grp ORDER BY value, year, slot_hour) AS rank FROM g), s AS (SELECT case_id, grp, max(rank) AS n FROM k GROUP BY ALL), p AS (SELECT case_id, grp, n, range AS point FROM s, range(1000))
SELECT case_id, grp, point::INT AS point, round(value, 4) AS value FROM p JOIN k USING (case_id, grp) WHERE rank = floor(point / 999 * (n - 1) + 0.5) + 1""")
def duration_resampled(spark: SparkSession, sf: str) -> DataFrame:
    """W-01: a curve at 1,000 places."""
    return rounded(shapes.resampled_curve(shapes.duration_curve(group_series(spark, sf), ["case_id", "grp"]), ["case_id", "grp"]))


@query(f"""WITH {H}, {G}, o AS (SELECT case_id, grp, round(sum(value), 4) AS total FROM g GROUP BY ALL) SELECT case_id, grp, total, row_number() OVER (PARTITION BY case_id ORDER BY total DESC, grp)::INT AS stack_rank FROM o""")
def stack_order(spark: SparkSession, sf: str) -> DataFrame:
    """W-03: lines by total."""
    return rounded(shapes.stack_order(group_series(spark, sf), ["case_id"], "grp"))


@query(f"""WITH {H}, gl AS (SELECT case_id, grp, year, slot_hour, sum(load) AS value FROM h GROUP BY ALL), o AS (SELECT case_id, grp, row_number() OVER (PARTITION BY case_id ORDER BY sum(value) DESC, grp) AS stack_rank FROM gl GROUP BY case_id, grp),
t AS (SELECT DISTINCT case_id, year, slot_hour FROM gl), d AS (SELECT t.*, o.grp, stack_rank, coalesce(value, 0) AS v FROM t JOIN o USING (case_id) LEFT JOIN gl ON gl.case_id = t.case_id AND gl.grp = o.grp AND gl.year = t.year AND gl.slot_hour = t.slot_hour),
r AS (SELECT case_id, grp, stack_rank, sum(v) OVER (PARTITION BY case_id, year, slot_hour ORDER BY stack_rank) AS running FROM d)
SELECT case_id, grp, stack_rank::INT AS stack_rank, count(*) AS hours, round(sum(running), 4) AS total, round(max(running), 4) AS peak FROM r GROUP BY ALL""")
def stack_totals(spark: SparkSession, sf: str) -> DataFrame:
    """W-02: running totals in stack order."""
    s = written(group_series(spark, sf, "load"), "stack-series")  # read for the order and for the hours
    st = shapes.stacked(s, shapes.stack_order(s, ["case_id"], "grp"), ["case_id"], "grp")
    return rounded(st.groupBy("case_id", "grp", "stack_rank").agg(F.count(F.lit(1)).alias("hours"), F.sum("running").alias("total"), F.max("running").alias("peak")))


@query(f"WITH {H}, {G} SELECT case_id || ' ' || grp || ' ' || year AS line, count(value) AS n, round(sum(value), 4) AS total, min(slot_hour) AS first_hour, max(slot_hour) AS last_hour FROM g GROUP BY 1")
def overlay_years(spark: SparkSession, sf: str) -> DataFrame:
    """W-06: each year as its own line on one slot axis."""
    s = shapes.overlay_years(group_series(spark, sf), ["case_id", "grp"])
    return rounded(s.groupBy("line").agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.min("slot_hour").alias("first_hour"), F.max("slot_hour").alias("last_hour")))


@query(f"WITH {H}, {G} SELECT case_id, grp, year, slot_day::INT AS slot_day, round(avg(value), 4) AS mean, round(min(value), 4) AS min, round(max(value), 4) AS max FROM g GROUP BY ALL")
def daily_profile(spark: SparkSession, sf: str) -> DataFrame:
    """A-15: days."""
    return rounded(shapes.daily(group_series(spark, sf), ["case_id", "grp"]))


@query(f"WITH {H}, {G} SELECT case_id, grp, year, slot_day::INT AS slot_day, " + ", ".join(f"round(max(value) FILTER (he = {h}), 4) AS h{h}" for h in range(1, 25)) + " FROM g GROUP BY ALL")
def day_hour_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """A-16: days by hours."""
    return rounded(shapes.day_hour_matrix(group_series(spark, sf), ["case_id", "grp"]))


@query(f"WITH {H}, {G}, e AS (SELECT case_id, grp, min(value) AS lo, max(value) AS hi FROM g GROUP BY ALL) SELECT case_id, grp, round(lo, 4) AS low, round(CASE WHEN hi > lo THEN hi ELSE lo + 1 END, 4) AS high, lo < 0 AND hi > 0 AS diverging FROM e")
def colour_scale(spark: SparkSession, sf: str) -> DataFrame:
    """A-16: one scale over all years."""
    return rounded(shapes.colour_scale(group_series(spark, sf), ["case_id", "grp"]))


@query(f"WITH {H}, {G} SELECT case_id, grp, strftime(date_trunc('week', d), '%Y-%m-%d') AS period, count(*) AS n, min((dow * 24 + he - 1))::INT AS first_hour, max(dow * 24 + he - 1)::INT AS last_hour, round(sum(value), 4) AS total FROM g GROUP BY 1, 2, 3")
def period_cut_week(spark: SparkSession, sf: str) -> DataFrame:
    """A-17: weeks from Monday, across New Year."""
    p = shapes.with_period(group_series(spark, sf), "week").withColumn("period", F.date_format("period", "yyyy-MM-dd"))
    return rounded(p.groupBy("case_id", "grp", "period").agg(F.count(F.lit(1)).alias("n"), F.min("axis_hour").cast("int").alias("first_hour"), F.max("axis_hour").cast("int").alias("last_hour"), F.sum("value").alias("total")))


@query(f"""WITH {H}, {G}, l AS (SELECT case_id, grp, ((day(d) - 1) * 24 + he - 1)::INT AS axis_hour, list_sort(list(value)) AS v, avg(value) AS mean FROM g GROUP BY ALL)
SELECT case_id, grp, axis_hour, round(mean, 4) AS mean, round(v[floor(0.1::DOUBLE * (len(v) - 1))::INT + 1], 4) AS p10, round(v[ceil(0.9::DOUBLE * (len(v) - 1))::INT + 1], 4) AS p90, len(v)::INT AS periods FROM l""")
def period_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A-18: mean, p10 and p90 of each hour of the month."""
    return rounded(shapes.period_summary(shapes.with_period(group_series(spark, sf), "month"), ["case_id", "grp"]).withColumn("axis_hour", F.col("axis_hour").cast("int")))


XY = """
x0 AS (SELECT year, slot_hour, sum(value) AS value FROM g WHERE grp <> 'EUROPE' AND year <> 1997 GROUP BY ALL), y0 AS (SELECT year, slot_hour, sum(value) AS value FROM g WHERE grp <> 'ASIA' GROUP BY ALL),
x AS (SELECT dense_rank() OVER (ORDER BY year) AS k, slot_hour, value AS x FROM x0), y AS (SELECT dense_rank() OVER (ORDER BY year) AS k, slot_hour, value AS y FROM y0), xy AS (SELECT k, slot_hour, x, y FROM x JOIN y USING (k, slot_hour))"""


def _xy(spark: SparkSession, sf: str) -> DataFrame:
    total = lambda kept: F.sum(F.when(F.expr(kept), F.col("value")))
    both = group_series(spark, sf).groupBy("year", "slot_hour").agg(total("grp <> 'EUROPE' and year <> 1997").alias("x"), total("grp <> 'ASIA'").alias("y"))
    both = written(both, "xy-series")  # read for the years and for the hours, of either series
    one = lambda c: both.filter(F.col(c).isNotNull()).select("year", "slot_hour", F.col(c).alias("value"))
    return shapes.xy_pairs(one("x"), one("y"))


@query(f"WITH {H}, {G}, {XY} SELECT k::INT AS k, slot_hour, round(x, 4) AS x, round(y, 4) AS y FROM xy")
def xy_pair(spark: SparkSession, sf: str) -> DataFrame:
    """J-11, W-10: hours of the k-th years kept."""
    return rounded(_xy(spark, sf))


@query(f"WITH {H}, {G}, {XY} SELECT (slot_hour % 24 + 1)::INT AS he, CASE WHEN count(*) >= 2 THEN round(regr_slope(y, x), 4) END AS slope, CASE WHEN count(*) >= 2 THEN round(regr_intercept(y, x), 4) END AS intercept, CASE WHEN count(*) >= 2 THEN round(regr_r2(y, x), 4) END AS r2, count(*) AS n, CASE WHEN count(*) < 2 THEN 'fewer than two points' END AS refusal FROM xy GROUP BY 1")
def xy_fit(spark: SparkSession, sf: str) -> DataFrame:
    """A-21: least squares by hour of day."""
    return rounded(stats.line_fit(_xy(spark, sf).withColumn("he", cal.he_of()), ["he"]))


THIN = "a AS (SELECT case_id, grp, (year - (SELECT min(year) FROM h)) * 8784 + slot_hour AS hour, value FROM g)"


@query(f"""WITH {H}, {G}, {THIN}, r AS (SELECT *, hour - row_number() OVER (PARTITION BY case_id, grp ORDER BY hour) AS run, min(hour) OVER (PARTITION BY case_id, grp) AS x0, max(hour) OVER (PARTITION BY case_id, grp) AS x1 FROM a),
c AS (SELECT *, least(floor((hour - x0) / greatest(x1 - x0, 1) * 200), 199)::INT AS "column" FROM r)
SELECT case_id, grp, run::INT AS run, "column", arg_min(hour, (value, hour))::INT AS low_hour, round(min(value), 4) AS low, arg_max(hour, (value, -hour))::INT AS high_hour, round(max(value), 4) AS high FROM c GROUP BY ALL""")
def downsample(spark: SparkSession, sf: str) -> DataFrame:
    """W-07: extremes of 200 stretches, apart at gaps."""
    s = cal.on_common_axis(written(group_series(spark, sf), "series"))
    t = shapes.thinned(s, ["case_id", "grp"], "axis_hour", 200)
    return rounded(t.select("case_id", "grp", F.col("run").cast("int").alias("run"), "column", F.col("low_hour").cast("int").alias("low_hour"), "low", F.col("high_hour").cast("int").alias("high_hour"), "high"))


@query(f"WITH {H}, {G}, {THIN} SELECT case_id, grp, arg_min(hour, (value, hour))::INT AS low_hour, round(min(value), 4) AS low, arg_max(hour, (value, -hour))::INT AS high_hour, round(max(value), 4) AS high FROM a WHERE hour BETWEEN 10000 AND 40000 GROUP BY ALL")
def window_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """W-09: highest and lowest hour in a window."""
    s = cal.on_common_axis(written(group_series(spark, sf), "series")).filter("axis_hour between 10000 and 40000")
    e = shapes.window_extremes(s, ["case_id", "grp"], "axis_hour")
    return rounded(e.withColumn("low_hour", F.col("low_hour").cast("int")).withColumn("high_hour", F.col("high_hour").cast("int")))


#: Columns of the sheet: the cases, and years that hold all ship dates.
SHEET = [(c, y) for c in ("A", "N", "R") for y in range(1992, 2003)]


@query(f"""WITH {H}, s AS (SELECT range::INT AS slot_hour FROM range(8784)), w AS (SELECT slot_hour, {", ".join(f"sum(net) FILTER (case_id = '{c}' AND year = {y}) AS {c}{y}" for c, y in SHEET)} FROM h GROUP BY 1)
SELECT slot_hour, month(DATE '2000-01-01' + (slot_hour // 24)::INT)::INT AS month, day(DATE '2000-01-01' + (slot_hour // 24)::INT)::INT AS day, (slot_hour % 24 + 1)::INT AS he, {", ".join(f'round({c}{y}, 4) AS "{c} {y}"' for c, y in SHEET)} FROM s LEFT JOIN w USING (slot_hour)""")
def hourly_wide(spark: SparkSession, sf: str) -> DataFrame:
    """K-02: slot rows, a column per series and year, all cases and years."""
    s = hourly(spark, sf).groupBy(F.col("case_id").alias("series"), "year", "slot_hour").agg(F.sum("net").alias("value"))
    return rounded(sinks.hourly_wide(s, SHEET, spark))


@query(f"""WITH {H}, s AS (SELECT DISTINCT case_id AS series FROM h), v AS (SELECT case_id AS series, year, slot_hour, sum(load) AS value FROM h GROUP BY ALL), b AS (SELECT min(year) AS a, max(year) AS b FROM h),
yy AS (SELECT range AS y FROM b, range(a, b + 1)), t AS (SELECT y AS year, range AS slot_hour FROM yy, range(8784) WHERE {LEAP} OR range // 24 <> 59)
SELECT series, year::INT AS year, month(DATE '2000-01-01' + (slot_hour // 24)::INT)::INT AS month, count(*) AS cells, count(value) AS filled FROM (SELECT * FROM s, t) LEFT JOIN v USING (series, year, slot_hour) GROUP BY ALL""")
def hourly_long(spark: SparkSession, sf: str) -> DataFrame:
    """K-03: a cell for every real hour of the span, counted by month."""
    s = hourly(spark, sf).groupBy(F.col("case_id").alias("series"), "year", "slot_hour").agg(F.sum("load").alias("value"))
    span = table(spark, sf, "lineitem").agg(F.min(F.year("l_shipdate")).alias("a"), F.max(F.year("l_shipdate")).alias("b")).first()
    return sinks.hourly_long(s, spark, span["a"], span["b"] - span["a"] + 1).groupBy("series", "year", "month").agg(F.count(F.lit(1)).alias("cells"), F.count("value").alias("filled"))


# ---------------------------------------------------------------- merges and quality

OFFERS = """
o AS (SELECT case_id, entity, year, slot_hour, CASE WHEN slot_hour % 9 = 0 THEN NULL ELSE load END AS value, 1 AS src_rank, 'a' AS src_file FROM h WHERE slot_hour % 3 <> 1
  UNION ALL SELECT case_id, entity, year, slot_hour, load + 1, 2, 'b' FROM h WHERE slot_hour % 2 = 0)"""


def _offers(spark: SparkSession, sf: str) -> DataFrame:
    h = written(hourly(spark, sf).select("case_id", "entity", "year", "slot_hour", "load"), "hourly-facts").withColumn("kind", F.lit("area")).withColumn("quantity", F.lit("Load (MWh)"))
    a = h.filter("slot_hour % 3 <> 1").select(*merge.CELL, F.when(F.col("slot_hour") % 9 != 0, F.col("load")).alias("value"), F.lit(1).alias("src_rank"), F.lit("a").alias("src_file"))
    b = h.filter("slot_hour % 2 = 0").select(*merge.CELL, (F.col("load") + 1).alias("value"), F.lit(2).alias("src_rank"), F.lit("b").alias("src_file"))
    return a.unionByName(b)


@query(f"WITH {H}, {OFFERS}, f AS (SELECT *, row_number() OVER (PARTITION BY case_id, entity, year, slot_hour ORDER BY src_rank) AS rn FROM o) SELECT case_id, entity, src_file, count(*) AS cells, count(value) AS filled, round(sum(value), 4) AS total FROM f WHERE rn = 1 GROUP BY ALL")
def first_wins_merge(spark: SparkSession, sf: str) -> DataFrame:
    """W-08: the first file owns a cell, blanks included."""
    m = merge.first_wins(_offers(spark, sf))
    return rounded(m.groupBy("case_id", "entity", "src_file").agg(F.count(F.lit(1)).alias("cells"), F.count("value").alias("filled"), F.sum("value").alias("total")))


@query(f"WITH {H}, {OFFERS}, a AS (SELECT * FROM o WHERE src_file = 'a'), b AS (SELECT * FROM o WHERE src_file = 'b'), u AS (SELECT * FROM a UNION ALL SELECT b.* FROM b ANTI JOIN a USING (case_id, entity, year, slot_hour)) SELECT case_id, src_file, count(*) AS cells, count(value) AS filled, round(sum(value), 4) AS total FROM u GROUP BY ALL")
def append_tables(spark: SparkSession, sf: str) -> DataFrame:
    """J-16: held cells stay."""
    o = _offers(spark, sf)
    u = merge.append_cells(o.filter("src_file = 'a'"), o.filter("src_file = 'b'"))
    return rounded(u.groupBy("case_id", "src_file").agg(F.count(F.lit(1)).alias("cells"), F.count("value").alias("filled"), F.sum("value").alias("total")))


@query(f"WITH {H}, {OFFERS}, c AS (SELECT case_id, entity, year, slot_hour FROM o GROUP BY ALL HAVING count(DISTINCT src_file) > 1) SELECT case_id, 'area' AS kind, 'Load (MWh)' AS quantity, count(*) AS overlapping FROM c GROUP BY 1")
def overlap_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Q-09: cells that several files offer."""
    return merge.overlap_notes(_offers(spark, sf))


@query("""WITH e AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0), i AS (SELECT c_custkey AS k, lower(c_name) AS name, round(c_acctbal, 4) AS bal FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(e.k, i.k) AS k, CASE WHEN e.k IS NOT NULL THEN e.name ELSE i.name END AS name, seg, bal FROM e FULL JOIN i ON e.k = i.k""")
def list_merge(spark: SparkSession, sf: str) -> DataFrame:
    """J-15: known rows stay, new keys and columns come in."""
    c = table(spark, sf, "customer")
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    new = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lower("c_name").alias("name"), F.round("c_acctbal", 4).alias("bal"))
    return groups.merge_lists(old, new, "k")


@query("""WITH i AS (SELECT p_brand, p_size, list_sort(list(DISTINCT p_name)) AS m FROM part GROUP BY ALL), w AS (SELECT DISTINCT 'Brand#' || (n_nationkey % 6) || (n_nationkey % 6) AS p_brand, n_nationkey::INT AS p_size, n_name FROM nation)
SELECT n_name, w.p_brand, w.p_size, CASE WHEN m IS NULL THEN 'unresolved' WHEN len(m) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN len(m) = 1 THEN m[1] END AS entity FROM w LEFT JOIN i USING (p_brand, p_size)""")
def key_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """J-03, J-04: composite keys that match none, one or several names."""
    k = F.col("n_nationkey")
    w = table(spark, sf, "nation").select("n_name", F.concat(F.lit("Brand#"), (k % 6).cast("string"), (k % 6).cast("string")).alias("p_brand"), k.cast("int").alias("p_size"))
    index = table(spark, sf, "part").select("p_brand", "p_size", F.col("p_name").alias("entity"))
    return groups.resolve_keys(w, index, ["p_brand", "p_size"]).select("n_name", "p_brand", "p_size", "status", "entity")


@query(f"WITH {H}, {MEMBERS}, x AS (SELECT DISTINCT entity FROM h WHERE entity > 'C'), mm AS (SELECT * FROM m WHERE entity NOT LIKE 'I%') SELECT (SELECT count(DISTINCT grp) FROM mm) AS groups, (SELECT count(*) FROM mm WHERE coef < 0) AS reversed, (SELECT count(*) FROM x SEMI JOIN mm USING (entity)) AS mapped, (SELECT count(DISTINCT entity) FROM mm ANTI JOIN x USING (entity)) AS off_list, (SELECT count(*) FROM x ANTI JOIN mm USING (entity)) AS unmapped")
def group_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """A-30, U-04: members on and off the axis."""
    axis = hourly(spark, sf).filter("entity > 'C'").select("entity").distinct()
    return groups.group_coverage(memberships(spark, sf).filter("entity not like 'I%'"), axis)


@query(f"WITH {MEMBERS} SELECT entity, list_sort(list(DISTINCT grp)) AS groups FROM m GROUP BY 1")
def reverse_membership(spark: SparkSession, sf: str) -> DataFrame:
    """J-13: groups of each entity."""
    return groups.reverse_memberships(memberships(spark, sf))


@query("""WITH m AS (SELECT 'N' AS case_id, 'area' AS kind, lower(r_name) || ' ' AS entity FROM region WHERE r_regionkey < 2 UNION ALL SELECT 'N', 'bus', n_name FROM nation), a AS (SELECT n_name AS entity, r_name AS area FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT m.case_id, m.entity, a.area FROM m JOIN a USING (entity) WHERE kind <> 'area' AND lower(trim(a.area)) IN (SELECT lower(trim(entity)) FROM m WHERE kind = 'area')""")
def overlap_check(spark: SparkSession, sf: str) -> DataFrame:
    """J-12, Q-16: stack members inside an area of the same stack."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    m = r.filter("r_regionkey < 2").select(F.lit("N").alias("case_id"), F.lit("area").alias("kind"), F.concat(F.lower("r_name"), F.lit(" ")).alias("entity")).unionByName(n.select(F.lit("N").alias("case_id"), F.lit("bus").alias("kind"), F.col("n_name").alias("entity")))
    a = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("entity"), F.col("r_name").alias("area"))
    return groups.overlap_offenders(m, a)


@query("SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS copies FROM orders GROUP BY ALL HAVING count(*) > 1")
def dup_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Q-03: rows that one source has more than once for a key."""
    o = table(spark, sf, "orders")
    c = o.select(F.lit("o").alias("src_file"), F.lit("c").alias("case_id"), F.lit("k").alias("kind"), F.lit("q").alias("quantity"), F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("slot_hour"))
    return merge.duplicate_cells(c).select(F.col("entity").alias("o_custkey"), F.col("slot_hour").alias("day"), "copies")


@query(f"WITH {H} SELECT case_id, year, slot_hour, count(DISTINCT CASE WHEN entity < 'NATION_2' THEN 'OnPeak' ELSE tou END)::BIGINT AS labels FROM h GROUP BY ALL HAVING count(DISTINCT CASE WHEN entity < 'NATION_2' THEN 'OnPeak' ELSE tou END) > 1")
def tou_conflict(spark: SparkSession, sf: str) -> DataFrame:
    """Q-04: hours with two labels."""
    h = hourly(spark, sf).withColumn("tou", F.when(F.col("entity") < "NATION_2", "OnPeak").otherwise(F.col("tou")))
    return merge.tou_conflicts(h, ["case_id"])


@query(f"""WITH {H}, y AS (SELECT DISTINCT case_id, entity, year FROM h WHERE NOT (entity < 'NATION_2' AND year = 1998)), s AS (SELECT case_id, entity, min(year) AS a, max(year) AS b, list(year) AS l FROM y GROUP BY ALL)
SELECT case_id, entity, a AS first_year, b AS last_year, len(list_filter(range(a, b + 1), lambda x: NOT list_contains(l, x)))::INT AS gaps, CASE WHEN len(list_filter(range(a, b + 1), lambda x: NOT list_contains(l, x))) > 0 THEN 'years are missing' END AS refusal FROM s""")
def year_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Q-05, U-02: years missing inside a span."""
    h = hourly(spark, sf).filter("not (entity < 'NATION_2' and year = 1998)")
    return merge.year_gaps(h, ["case_id", "entity"]).select("case_id", "entity", "first_year", "last_year", F.size("missing_years").alias("gaps"), "refusal")


@query(f"""WITH {H}, s AS (SELECT case_id, entity, min(year) AS a, max(year) AS b FROM h WHERE NOT (entity LIKE '%3' AND year > 1998) GROUP BY ALL), w AS (SELECT *, min(a) OVER (PARTITION BY case_id) AS ca, max(b) OVER (PARTITION BY case_id) AS cb FROM s)
SELECT case_id, entity, a AS first_year, b AS last_year, ca AS case_first, cb AS case_last FROM w WHERE a <> ca OR b <> cb""")
def span_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Q-10: tables whose span is not their case's."""
    h = hourly(spark, sf).filter("not (entity like '%3' and year > 1998)")
    return merge.span_mismatches(h.groupBy("case_id", "entity").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year")))


@query("""WITH n AS (SELECT p_name AS q FROM part UNION ALL SELECT replace(p_name, ' ', '  ') FROM part WHERE p_partkey % 7 = 0) SELECT regexp_replace(q, '\\s+', '', 'g') AS squeezed, list_sort(list(DISTINCT q)) AS spellings FROM n GROUP BY 1 HAVING count(DISTINCT q) > 1""")
def spelling_clash(spark: SparkSession, sf: str) -> DataFrame:
    """Q-06: names that differ in spaces only."""
    p = table(spark, sf, "part")
    n = p.select(F.col("p_name").alias("quantity")).unionByName(p.filter("p_partkey % 7 = 0").select(F.regexp_replace("p_name", " ", "  ").alias("quantity")))
    return merge.spelling_clashes(n)


@query("SELECT p_partkey, regexp_extract(p_name || ' (' || p_brand || ') x (' || p_type || ')', '\\(([^()]*)\\)[^()]*$', 1) AS unit FROM part")
def unit_of(spark: SparkSession, sf: str) -> DataFrame:
    """T-09: the unit in the last parentheses."""
    q = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") x ("), "p_type", F.lit(")"))
    return table(spark, sf, "part").select("p_partkey", browse.unit_of(q).alias("unit"))


@query(r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '1,2' || p_size || '.5' WHEN 1 THEN p_size || 'd' WHEN 2 THEN '-.5e' || (p_size % 3) WHEN 3 THEN 'NaN' WHEN 4 THEN '' ELSE p_size || '.' END AS cell FROM part)
SELECT p_partkey, round(CASE WHEN regexp_full_match(replace(cell, ',', ''), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN replace(cell, ',', '')::DOUBLE END, 6) AS value FROM t""")
def strict_number(spark: SparkSession, sf: str) -> DataFrame:
    """T-02: whole cells that are finite numbers."""
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    cell = F.when(k == 0, F.concat(F.lit("1,2"), s, F.lit(".5"))).when(k == 1, F.concat(s, F.lit("d"))).when(k == 2, F.concat(F.lit("-.5e"), (F.col("p_size") % 3).cast("string"))).when(k == 3, "NaN").when(k == 4, "").otherwise(F.concat(s, F.lit(".")))
    return table(spark, sf, "part").select("p_partkey", F.round(cells.number(cell), 6).alias("value"))


#: Cells, the cleaned fuel and the fuel group of each.
FUEL_ROWS = (
    ("PV", "Solar", "Solar"), ("Hydro", "Hydro", "Hydro"), ("hydro  pumped", "Pumped Storage", "Storage"), ("NG", "Natural Gas", "Thermal"), ("Wnd turbine", "Wind", "Wind"), ("Coal", "Coal", "Thermal"),
    ("lng", "Natural Gas", "Thermal"), ("MWh", "Battery Storage", "Storage"), ("Hydrogen", "Hydrogen", "Thermal"), ("", "Unknown", "Unknown"), ("Mystery", "Unrecognised", "Unrecognised"), ("(unlisted)", "Unlisted", "Unlisted"),
    ("none", "Unknown", "Unknown"), ("Unknown", "Unknown", "Unknown"), (" (blank) ", "Unknown", "Unknown"), ("-", "Unknown", "Unknown"), ("--", "Unknown", "Unknown"), ("N/A", "Unknown", "Unknown"), ("null", "Unknown", "Unknown"),
    ("Combustion  Turbine 3", "Natural Gas", "Thermal"), ("DF No. 2", "Distillate Fuel Oil", "Thermal"), ("Li-Ion 4h", "Battery Storage", "Storage"), ("wood chips", "Biomass", "Thermal"), ("geo-1", "Geothermal", "Thermal"), ("es 2", "Battery Storage", "Storage"),
)
FUEL_CASES, FUEL_CLEAN, FUEL_GROUP = zip(*FUEL_ROWS, strict=True)


@query(f"SELECT ({list(FUEL_CLEAN)!r})[p_partkey % 25 + 1] AS clean_fuel, ({list(FUEL_GROUP)!r})[p_partkey % 25 + 1] AS fuel_group, count(*) AS units, round(sum(p_retailprice), 4) AS total FROM part GROUP BY ALL")
def clean_fuel(spark: SparkSession, sf: str) -> DataFrame:
    """T-11, T-12, A-04: cleaned fuels of units (parts, given fuels in turn) and sums by them."""
    p = table(spark, sf, "part")
    cell = F.element_at(F.array(*[F.lit(c) for c in FUEL_CASES]), (F.col("p_partkey") % 25 + 1).cast("int"))
    u = p.select(F.col("p_name").alias("entity"), cell.alias("fuel_type"), F.when(cell == "(unlisted)", cell).otherwise("").alias("technology"), F.when(cell == "(unlisted)", cell).alias("sub_type"), "p_retailprice")
    return fuel.with_clean_fuel(u).groupBy("clean_fuel", "fuel_group").agg(F.count(F.lit(1)).alias("units"), F.round(F.sum("p_retailprice"), 4).alias("total"))


@query("SELECT 'p_brand' AS column, count(DISTINCT p_brand) AS distinct, CASE WHEN count(DISTINCT p_brand) <= 256 AND count(DISTINCT p_brand) * 8 <= count(*) THEN 'enum' ELSE 'text' END AS kind FROM part UNION ALL SELECT 'p_name', count(DISTINCT p_name), CASE WHEN count(DISTINCT p_name) <= 256 AND count(DISTINCT p_name) * 8 <= count(*) THEN 'enum' ELSE 'text' END FROM part".replace("AS distinct", 'AS "distinct"').replace("AS column", 'AS "column"'))
def column_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """A-24: undeclared columns are enum or text by cardinality."""
    return groups.column_kinds(table(spark, sf, "part").select("p_brand", "p_name"))


@query(f"""WITH {H}, y AS (SELECT DISTINCT case_id, entity, year FROM h WHERE (year + length(entity)) % 3 <> 0), r AS (SELECT *, year - row_number() OVER (PARTITION BY case_id, entity ORDER BY year) AS run FROM y),
b AS (SELECT case_id, entity, min(year) AS a, max(year) AS b FROM r GROUP BY case_id, entity, run) SELECT case_id, entity, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS years FROM b GROUP BY ALL""")
def year_runs(spark: SparkSession, sf: str) -> DataFrame:
    """T-21: runs of years as text."""
    return browse.year_runs(hourly(spark, sf).filter("(year + length(entity)) % 3 <> 0"), ["case_id", "entity"])


@query(f"WITH {MEMBERS} SELECT grp, sha256(string_agg(entity, chr(31) ORDER BY entity)) AS signature FROM m GROUP BY 1")
def member_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """T-22: an order-free signature of each group's members."""
    m = memberships(spark, sf).groupBy("grp").agg(F.collect_list("entity").alias("e"))
    return m.select("grp", browse.member_signature(F.col("e")).alias("signature"))


@query(f"""WITH e AS (SELECT event_type AS entity, ts::DATE AS d, year(ts)::INT AS y, hour(ts) AS hr, value FROM events),
f AS (SELECT entity, y AS year, ((dayofyear(d) - 1 + CASE WHEN NOT {LEAP} AND month(d) >= 3 THEN 1 ELSE 0 END) * 24 + hr)::INT AS slot_hour, sum(value) * {RATE}::DOUBLE AS value FROM e GROUP BY ALL)
SELECT entity, year, (slot_hour // 24)::INT AS slot_day, round(avg(value), 4) AS mean, round(min(value), 4) AS min, round(max(value), 4) AS max FROM f GROUP BY ALL""")
def event_hours(spark: SparkSession, sf: str) -> DataFrame:
    """C-01, A-15: events as hourly facts, by day."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("entity"), F.year("ts").alias("year"), cal.slot_hour(F.to_date("ts"), F.hour("ts") + 1).cast("int").alias("slot_hour"), "value")
    facts = e.groupBy("entity", "year", "slot_hour").agg((F.sum("value") * RATE).alias("value"))
    return rounded(shapes.daily(facts, ["entity"]))


@query(f"WITH {H}, z AS (SELECT case_id, entity, CASE WHEN entity LIKE '%4' THEN 0.0 WHEN entity LIKE '%5' AND slot_hour % 7 <> 0 THEN 0.0 ELSE net END AS value FROM h) SELECT case_id, entity, count(*) FILTER (value <> 0) = 0 AS all_zero FROM z GROUP BY ALL")
def all_zero(spark: SparkSession, sf: str) -> DataFrame:
    """A-22: series whose values are all zero; others have zeros in most hours."""
    zero = F.col("entity").like("%4") | (F.col("entity").like("%5") & (F.col("slot_hour") % 7 != 0))
    return stats.all_zero(hourly(spark, sf).withColumn("value", F.when(zero, 0.0).otherwise(F.col("net"))), ["case_id", "entity"])


@query(f"""WITH {H}, {MEMBERS}, s AS (SELECT 'nation' AS series_id, year, slot_hour, sum(load) AS value, count(*) AS c FROM h WHERE case_id = 'N' AND entity = 'NATION_3' GROUP BY ALL
  UNION ALL SELECT 'group', year, slot_hour, sum(load * coef), count(*) FROM h JOIN m USING (entity) WHERE case_id = 'N' AND m.grp = 'BOUNDARY' GROUP BY ALL
  UNION ALL SELECT 'frozen', year, slot_hour, sum(load * coef), count(*) FROM h JOIN m USING (entity) WHERE case_id = 'N' AND m.grp = 'BOUNDARY' AND entity IN ('NATION_1', 'NATION_2') GROUP BY ALL
  UNION ALL SELECT 'case', year, slot_hour, sum(load), count(*) FROM h WHERE case_id = 'R' GROUP BY ALL)
SELECT series_id, count(*) AS hours, round(sum(value), 4) AS total, sum(c)::BIGINT AS contributors FROM s GROUP BY 1""")
def series_specs(spark: SparkSession, sf: str) -> DataFrame:
    """A-01, A-02, A-08, F-09: an entity, a group, a frozen group and a whole case, resolved in one job."""
    facts = series_of(hourly(spark, sf), "load").select("case_id", F.lit("area").alias("kind"), F.lit("Load (MWh)").alias("quantity"), "entity", "year", "slot_hour", "value")
    q = ("area", "Load (MWh)")
    rows = [("nation", "N", *q, "NATION_3", None, None), ("group", "N", *q, None, "BOUNDARY", None), ("frozen", "N", *q, None, "BOUNDARY", ["NATION_1", "NATION_2"]), ("case", "R", *q, None, None, None)]
    specs = spark.createDataFrame(rows, "series_id string, case_id string, kind string, quantity string, entity string, grp string, members array<string>")
    s = series.resolve(specs, facts, memberships(spark, sf).withColumn("kind", F.lit("area")))
    return rounded(s.groupBy("series_id").agg(F.count(F.lit(1)).alias("hours"), F.sum("value").alias("total"), F.sum("contributors").alias("contributors")))
