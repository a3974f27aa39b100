"""Registered queries, fifth part: stacks thinned together, boxes of several dimensions, runs from tables, spans and imports of whole studies, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casehours.functions import calendar as cal
from casehours.functions import rules
from casehours.operators import browse, filters, groups, merge, ranges, series, shapes, stats
from casehours.plans.facts import H, LIMITS, MEMBERS, hourly, limits, memberships, series_of, stats_sql, table
from casehours.plans.file_queries import _written
from casehours.plans.queries import G, group_series, query, rounded
from casehours.session import written
from casehours.sources import lists
from casehours.sources.catalog import import_actions

# ---------------------------------------------------------------- boxes, stacks

BOX_DIMENSIONS = {"case": "case_id", "year": "year", "month": "month", "hourOfDay": "he", "dayOfWeek": "dow", "season": "season"}

_BOX_ROWS = "gx AS (" + " UNION ALL ".join(f"SELECT grp, '{d}' AS dimension, {c}::VARCHAR AS dim, value FROM g" for d, c in BOX_DIMENSIONS.items()) + ")"


def _box_all_sql() -> str:
    inside = "v BETWEEN p25 - 1.5 * (p75 - p25) AND p75 + 1.5 * (p75 - p25)"
    return f"""WITH {H}, {G}, {_BOX_ROWS},
q AS (SELECT grp, dimension, dim, count(value) AS n, min(value) AS mn, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS p75, max(value) AS mx FROM gx GROUP BY ALL),
b AS (SELECT q.*, x.value AS v FROM gx x JOIN q ON q.grp = x.grp AND q.dimension = x.dimension AND q.dim IS NOT DISTINCT FROM x.dim)
SELECT grp, dimension, dim, n, round(mn, 4) AS min, round(p25, 4) AS p25, round(median, 4) AS median, round(p75, 4) AS p75, round(mx, 4) AS max, round(min(v) FILTER ({inside}), 4) AS whisker_low, round(max(v) FILTER ({inside}), 4) AS whisker_high,
  count(*) FILTER (NOT {inside}) AS outliers, mn = mx AS degenerate FROM b GROUP BY grp, dimension, dim, n, mn, p25, median, p75, mx"""


@query(_box_all_sql())
def box_by_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """A-14: boxes of each region by case, year, month, hour, weekday and season, from one scan by grouping sets."""
    return rounded(shapes.boxes_by_dimensions(group_series(spark, sf), ["grp"], list(BOX_DIMENSIONS)))


_STACK = f"""WITH {H}, gl AS (SELECT case_id, grp, year, slot_hour, sum(load) AS value FROM h WHERE he % 5 <> 0 OR grp <> 'ASIA' GROUP BY ALL),
o AS (SELECT case_id, grp, row_number() OVER (PARTITION BY case_id ORDER BY sum(value) DESC, grp) AS stack_rank FROM gl GROUP BY case_id, grp),
t AS (SELECT DISTINCT case_id, year, slot_hour FROM gl), d AS (SELECT t.*, o.grp, stack_rank, coalesce(value, 0) AS v FROM t JOIN o USING (case_id) LEFT JOIN gl ON gl.case_id = t.case_id AND gl.grp = o.grp AND gl.year = t.year AND gl.slot_hour = t.slot_hour),
r AS (SELECT case_id, grp, stack_rank, (year - (SELECT min(year) FROM h)) * 8784 + slot_hour AS hour, sum(v) OVER (PARTITION BY case_id, year, slot_hour ORDER BY stack_rank) AS running FROM d),
hr AS (SELECT DISTINCT case_id, hour FROM r), ends AS (SELECT case_id, min(hour) AS x0, max(hour) AS x1 FROM hr GROUP BY 1),
c AS (SELECT case_id, hour, hour - row_number() OVER (PARTITION BY case_id ORDER BY hour) AS run, least(floor((hour - x0) / greatest(x1 - x0, 1) * 100), 99)::INT AS "column" FROM hr JOIN ends USING (case_id)),
e AS (SELECT case_id, run, "column", stack_rank, arg_min(hour, (running, hour)) AS lo, arg_max(hour, (running, -hour)) AS hi FROM r JOIN c USING (case_id, hour) GROUP BY ALL),
k AS (SELECT case_id, run, "column", lo AS hour FROM e UNION SELECT case_id, run, "column", hi FROM e)
SELECT case_id, run::INT AS run, "column", hour::INT AS hour, grp, stack_rank::INT AS stack_rank, round(running, 4) AS running FROM k JOIN r USING (case_id, hour)"""


@query(_STACK)
def downsample_stack(spark: SparkSession, sf: str) -> DataFrame:
    """W-07: a stack thinned to 100 stretches; every line keeps the same hours, those of the extremes of any running total."""
    s = written(_lines_of_stack(spark, sf), "stack-series")
    hours = cal.on_common_axis(shapes.stack_hours(s, shapes.stack_order(s, ["case_id"], "grp"), ["case_id"], "grp"))
    kept = shapes.thinned_stack(hours, ["case_id"], "axis_hour", 100)
    rows = shapes.stack_rows(kept, ["case_id", "run", "column", "axis_hour"], "grp")
    return rounded(rows.select("case_id", F.col("run").cast("int").alias("run"), "column", F.col("axis_hour").cast("int").alias("hour"), "grp", "stack_rank", "running"))


def _lines_of_stack(spark: SparkSession, sf: str) -> DataFrame:
    """Loads of the regions; one of them lacks hours that others have."""
    h = hourly(spark, sf).filter((cal.he_of() % 5 != 0) | (F.col("grp") != "ASIA"))
    return h.groupBy("case_id", "grp", "year", "slot_hour").agg(F.sum("load").alias("value"))


# ---------------------------------------------------------------- runs of days from a table

RUNS = """
runs AS (SELECT ['A', 'N'][o_orderkey % 2 + 1] AS case_id, (o_custkey * 13) % 92 * 4 - 1 AS a, (o_custkey * 13) % 92 * 4 - 1 + o_orderkey % 3 - 1 AS b FROM orders),
rr AS (SELECT DISTINCT case_id, greatest(least(a, b), 0) AS a, least(greatest(a, b), 365) AS b FROM runs WHERE least(a, b) <= 365 AND greatest(a, b) >= 0)"""


def day_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A run of days for every order, forwards or backwards, partly outside the year; case R has none."""
    k, first = F.col("o_orderkey"), (F.col("o_custkey") * 13) % 92 * 4 - 1
    return table(spark, sf, "orders").select(F.when(k % 2 == 0, "A").otherwise("N").alias("case_id"), first.cast("int").alias("first_day"), (first + k % 3 - 1).cast("int").alias("last_day"))


@query(f"""WITH {H}, {RUNS}, days AS (SELECT DISTINCT case_id, day FROM rr, range(366) AS d(day) WHERE day BETWEEN a AND b),
kept AS (SELECT h.* FROM h WHERE NOT EXISTS (FROM rr WHERE rr.case_id = h.case_id) OR EXISTS (FROM days WHERE days.case_id = h.case_id AND days.day = h.slot_day))
SELECT case_id, entity, {stats_sql('load')} FROM kept GROUP BY ALL""")
def date_runs_table(spark: SparkSession, sf: str) -> DataFrame:
    """F-02: runs of days for each case from a table, merged, joined by buckets of days."""
    kept = filters.in_runs(series_of(hourly(spark, sf), "load"), day_runs(spark, sf), ["case_id"])
    return stats.series_stats(kept, ["case_id", "entity"], ndigits=4)


@query(f"""WITH {RUNS}, m AS (SELECT *, CASE WHEN a <= max(b) OVER w + 1 THEN 0 ELSE 1 END AS apart FROM rr WINDOW w AS (PARTITION BY case_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(apart) OVER (PARTITION BY case_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT case_id, min(a)::INT AS first_day, max(b)::INT AS last_day FROM i GROUP BY case_id, island""")
def merged_day_runs(spark: SparkSession, sf: str) -> DataFrame:
    """F-02: overlapping and touching runs of a table as one."""
    return filters.merged_runs(day_runs(spark, sf), ["case_id"])


# ---------------------------------------------------------------- spans and imports of a study

SPANS = """
slots AS (SELECT case_id, grp AS slot, min(year)::INT AS first_year, max(year)::INT AS last_year FROM h GROUP BY ALL),
cs AS (SELECT case_id, min(first_year) AS case_first, max(last_year) AS case_last FROM slots GROUP BY 1),
land AS (SELECT n_name AS file, r_name AS slot, n_nationkey AS k, ['A', 'N', 'R'][n_nationkey % 3 + 1] AS case_id FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'all ' || r_name, r_name, 99, 'A' FROM region),
lf AS (SELECT land.*, s.first_year AS slot_first, s.last_year AS slot_last, case_first, case_last, CASE WHEN k % 4 = 0 THEN 'replace' ELSE 'add' END AS mode,
    CASE WHEN k = 99 OR k % 5 = 2 THEN case_last + 1 WHEN k % 5 = 3 THEN case_last + 3 WHEN k % 5 = 4 THEN case_first + 300 ELSE case_first END AS first_year,
    CASE WHEN k = 99 OR k % 5 = 2 THEN case_last + 1 WHEN k % 5 = 3 THEN case_last + 3 WHEN k % 5 = 4 THEN case_first + 300 WHEN k % 5 = 1 THEN case_first ELSE case_last END AS last_year
  FROM land JOIN slots s USING (case_id, slot) JOIN cs USING (case_id)),
rf AS (SELECT *, CASE WHEN mode = 'add' THEN least(first_year, slot_first) ELSE first_year END AS rfirst, CASE WHEN mode = 'add' THEN greatest(last_year, slot_last) ELSE last_year END AS rlast FROM lf),
vf AS (SELECT *, CASE WHEN mode = 'add' AND (first_year > slot_last + 1 OR last_year < slot_first - 1) THEN 'the files and the table leave years out' WHEN mode = 'add' AND rlast - rfirst >= 256 THEN 'a case has at most 256 years'
    WHEN NOT (rfirst <= case_first AND rlast >= case_last) THEN 'the years do not contain the case''s' END AS reason FROM rf),
ju AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'refused' WHEN rfirst = case_first AND rlast = case_last THEN 'accepted' ELSE 'extends' END AS verdict FROM vf)"""


def landing_files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The tables of each case (a region's is a slot), and files that land on them: a year more, a gap, a part, the same."""
    slots = hourly(spark, sf).groupBy("case_id", F.col("grp").alias("slot")).agg(F.min("year").cast("int").alias("first_year"), F.max("year").cast("int").alias("last_year"))
    slots = written(slots, "slots")
    cases = slots.groupBy("case_id").agg(F.min("first_year").alias("case_first"), F.max("last_year").alias("case_last"))
    n, r, k = table(spark, sf, "nation"), table(spark, sf, "region"), F.col("k")
    files = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("file"), F.col("r_name").alias("slot"), F.col("n_nationkey").cast("int").alias("k"), F.element_at(F.array(*map(F.lit, "ANR")), (F.col("n_nationkey") % 3 + 1).cast("int")).alias("case_id"))
    files = files.unionByName(r.select(F.concat(F.lit("all "), "r_name").alias("file"), F.col("r_name").alias("slot"), F.lit(99).alias("k"), F.lit("A").alias("case_id")))
    a, b = F.col("case_first"), F.col("case_last")
    odd = F.when((k == 99) | (k % 5 == 2), b + 1).when(k % 5 == 3, b + 3).when(k % 5 == 4, a + 300)
    landed = files.join(slots.withColumnsRenamed({"first_year": "slot_first", "last_year": "slot_last"}), ["case_id", "slot"]).join(cases, "case_id")
    landed = landed.withColumn("mode", F.when(k % 4 == 0, "replace").otherwise("add")).withColumn("first_year", F.coalesce(odd, a)).withColumn("last_year", F.coalesce(odd, F.when(k % 5 == 1, a).otherwise(b)))
    return slots, landed


@query(f"WITH {H}, {SPANS} SELECT file, case_id, slot, mode, rfirst::INT AS result_first, rlast::INT AS result_last, verdict, reason FROM ju")
def landing_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Q-10: files that land on tables, accepted, refused or extending their case."""
    _, landed = landing_files(spark, sf)
    return merge.judged_spans(landed).select("file", "case_id", "slot", "mode", "result_first", "result_last", "verdict", "reason")


@query(f"""WITH {H}, {SPANS}, held AS (SELECT case_id, slot, min(rfirst) AS f, max(rlast) AS l FROM ju WHERE verdict = 'extends' GROUP BY ALL), target AS (SELECT case_id, min(f) AS f, max(l) AS l FROM held GROUP BY 1),
standing AS (SELECT case_id, slot, f, l FROM held UNION ALL SELECT case_id, slot, first_year, last_year FROM slots ANTI JOIN held USING (case_id, slot)),
d AS (SELECT t.case_id, t.f, t.l, list_sort(coalesce(list(DISTINCT s.slot) FILTER (s.f <> t.f OR s.l <> t.l), [])) AS differ FROM target t JOIN standing s USING (case_id) GROUP BY ALL)
SELECT case_id, f::INT AS first_year, l::INT AS last_year, CASE WHEN len(differ) = 0 THEN 'extended' ELSE 'refused' END AS verdict, array_to_string(differ, ', ') AS differ FROM d""")
def extend_together(spark: SparkSession, sf: str) -> DataFrame:
    """Q-10: a case is extended if all its tables come to the same years; else the ones that differ are named."""
    slots, landed = landing_files(spark, sf)
    held = merge.judged_spans(landed).filter("verdict = 'extends'").groupBy("case_id", "slot").agg(F.min("result_first").alias("first_year"), F.max("result_last").alias("last_year"))
    return merge.settled_spans(slots, held).select("case_id", "first_year", "last_year", "verdict", F.array_join("differ", ", ").alias("differ"))


IMPORTS = """
hh AS (SELECT case_id, grp, count(DISTINCT (year, slot_hour)) AS hours_seen, min(year)::INT AS first_year, max(year)::INT AS last_year FROM h GROUP BY ALL),
held AS (SELECT *, CASE WHEN grp = 'ASIA' THEN 'interface' ELSE 'bus' END AS kind, CASE WHEN grp <> 'ASIA' THEN grp END AS quantity,
    (SELECT sum(CASE WHEN (y % 4 = 0 AND y % 100 <> 0 OR y % 400 = 0) THEN 8784 ELSE 8760 END) FROM range(first_year, last_year + 1) AS t(y))::BIGINT AS real_hours FROM hh),
fl AS (SELECT s_name AS src_file, ['A', 'N', 'S' || s_nationkey % 4][s_suppkey % 3 + 1] AS case_id, CASE WHEN r_name = 'ASIA' THEN 'interface' ELSE 'bus' END AS kind, CASE WHEN r_name <> 'ASIA' THEN r_name END AS quantity,
    CASE WHEN s_suppkey % 7 = 0 AND r_name = 'AFRICA' THEN 'long' ELSE 'wide' END AS shape, 1997 + (s_suppkey % 5)::INT AS y, CASE WHEN s_suppkey % 11 = 0 THEN 'no header row' END AS reason FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
sl AS (SELECT case_id, kind, quantity, count(DISTINCT src_file) AS files, count(DISTINCT shape) AS shapes, min(y) AS a, max(y) AS b FROM fl WHERE reason IS NULL GROUP BY ALL)"""


def _import_actions_sql(mode: str) -> str:
    return f"""SELECT '{mode}' AS mode, sl.case_id, sl.kind, sl.quantity, NOT EXISTS (FROM held WHERE held.case_id = sl.case_id) AS case_is_new, CASE WHEN x.case_id IS NULL THEN 'create' ELSE '{mode}' END AS action, files, files > 1 AND conflict IS NULL AS merges, conflict,
  CASE WHEN '{mode}' = 'replace' AND hours_seen < real_hours THEN 'replaces ' || hours_seen || ' of ' || real_hours || ' hours; add keeps them' END AS note,
  CASE WHEN conflict IS NULL THEN array_to_string(list_transform(CASE WHEN x.case_id IS NOT NULL AND '{mode}' = 'replace' THEN range(least(a, x.first_year), greatest(b, x.last_year) + 1) ELSE range(a, b + 1) END, lambda y: y::VARCHAR), ',') END AS years
FROM (SELECT *, CASE WHEN files > 1 AND shapes > 1 THEN 'the files differ in shape' WHEN files > 1 AND kind = 'interface' THEN 'the files'' quantity was not read' END AS conflict FROM sl) sl
LEFT JOIN held x ON x.case_id = sl.case_id AND x.kind = sl.kind AND x.quantity IS NOT DISTINCT FROM sl.quantity"""


@query(f"WITH {H}, {IMPORTS} {_import_actions_sql('add')} UNION ALL {_import_actions_sql('replace')}")
def import_actions_of_files(spark: SparkSession, sf: str) -> DataFrame:
    """S-14: files against what a study holds: tables created, added to or replaced, mixed shapes, quantities not read."""
    h = hourly(spark, sf)
    seen = cal.coverage(h, ["case_id", "grp"]).join(h.groupBy("case_id", "grp").agg(F.min("year").cast("int").alias("first_year"), F.max("year").cast("int").alias("last_year")), ["case_id", "grp"])
    kind = lambda g: F.when(F.col(g) == "ASIA", "interface").otherwise("bus").alias("kind")
    quantity = lambda g: F.when(F.col(g) != "ASIA", F.col(g)).alias("quantity")
    held = written(seen.select("case_id", kind("grp"), quantity("grp"), "first_year", "last_year", "hours_seen", "real_hours"), "held-tables")
    n, r, k = table(spark, sf, "nation"), table(spark, sf, "region"), F.col("s_suppkey")
    regions = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
    rows = table(spark, sf, "supplier").join(regions, F.col("s_nationkey") == F.col("n_nationkey"))
    case = F.when(k % 3 == 0, "A").when(k % 3 == 1, "N").otherwise(F.concat(F.lit("S"), (F.col("s_nationkey") % 4).cast("string")))
    year = (F.lit(1997) + k % 5).cast("int")
    files = rows.select(F.col("s_name").alias("src_file"), case.alias("case_id"), kind("r_name"), quantity("r_name"), F.when((k % 7 == 0) & (F.col("r_name") == "AFRICA"), "long").otherwise("wide").alias("shape"), year.alias("first_year"), year.alias("last_year"), F.when(k % 11 == 0, "no header row").alias("reason"))
    out = [import_actions(files, held, mode).withColumn("mode", F.lit(mode)) for mode in ("add", "replace")]
    return out[0].unionByName(out[1]).withColumn("files", F.size("files").cast("long")).withColumn("years", F.array_join("years", ","))


# ---------------------------------------------------------------- groups through areas, hazards, operands


@query(f"""WITH {MEMBERS}, e AS (SELECT s_name AS entity, s_suppkey AS k, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
ar AS (SELECT entity, CASE WHEN k % 9 <> 0 THEN n_name END AS area FROM e WHERE k % 10 <> 0), own AS (SELECT entity, 'BOUNDARY' AS grp FROM e WHERE k % 3 = 0 UNION SELECT entity, 'G' || k % 4 FROM e WHERE k % 5 = 0),
o AS (SELECT entity, list_sort(list(grp)) AS own_groups FROM own GROUP BY 1), a AS (SELECT m.entity AS area, list_sort(list(DISTINCT grp)) AS area_groups FROM m GROUP BY 1),
j AS (SELECT e.entity, area, coalesce(own_groups, []) AS own_groups, coalesce(area_groups, []) AS area_groups FROM e LEFT JOIN ar USING (entity) LEFT JOIN o USING (entity) LEFT JOIN a USING (area))
SELECT entity, area, array_to_string(own_groups, ',') AS own_groups, array_to_string(area_groups, ',') AS area_groups, array_to_string(list_sort(list_distinct(own_groups || area_groups)), ',') AS groups FROM j""")
def groups_through_areas(spark: SparkSession, sf: str) -> DataFrame:
    """J-13: groups that hold a unit, and those that hold its area; some units have no area, some groups hold both."""
    k = F.col("s_suppkey")
    units = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_name").alias("entity"), "n_name")
    area_of = units.filter(k % 10 != 0).select("entity", F.when(k % 9 != 0, F.concat(F.lit(" "), "n_name")).otherwise(" ").alias("area"))
    own = units.filter(k % 3 == 0).select("entity", F.lit("BOUNDARY").alias("grp")).unionByName(units.filter(k % 5 == 0).select("entity", F.concat(F.lit("G"), (k % 4).cast("string")).alias("grp")))
    got = groups.memberships_of(units, own, area_of, memberships(spark, sf))
    return got.select("entity", "area", *(F.array_join(c, ",").alias(c) for c in ("own_groups", "area_groups", "groups")))


TRADES = ("Import Flow(MWh)", "Load (MWh)", "Export Revenue (k$)")


@query(f"""WITH {H}, {MEMBERS}, f AS (SELECT case_id, entity, 'Import Flow(MWh)' AS q, load AS v FROM h JOIN nation ON n_name = entity WHERE n_nationkey % 4 = 1 UNION ALL SELECT case_id, entity, 'Export Revenue (k$)', net FROM h WHERE case_id <> 'R' UNION ALL SELECT case_id, entity, 'Load (MWh)', load FROM h),
t AS (SELECT DISTINCT case_id, entity, q FROM f WHERE v <> 0 AND q <> 'Load (MWh)'), p AS (SELECT case_id, grp, q, count(*) AS n FROM t JOIN (SELECT DISTINCT entity, grp FROM m) m USING (entity) GROUP BY ALL HAVING count(*) > 1)
SELECT case_id, grp, string_agg(q, ', ' ORDER BY q) AS metrics, max(n) AS traders, string_agg(q, ', ' ORDER BY q) || ': members that trade with each other are counted twice' AS caveat FROM p GROUP BY ALL""")
def trade_hazards(spark: SparkSession, sf: str) -> DataFrame:
    """Q-13: groups whose sums would count trade twice; those with one trading member or none have no caveat."""
    h = hourly(spark, sf).join(table(spark, sf, "nation").select(F.col("n_name").alias("entity"), "n_nationkey"), "entity")
    values = (F.when(F.col("n_nationkey") % 4 == 1, F.col("load")), F.col("load"), F.when(F.col("case_id") != "R", F.col("net")))
    each = F.explode(F.array(*(F.struct(F.lit(q).alias("quantity"), v.alias("value")) for q, v in zip(TRADES, values, strict=True))))
    facts = h.select("case_id", "entity", each.alias("x")).select("case_id", "entity", "x.*")
    got = merge.group_hazards(facts, memberships(spark, sf), rules.area_rules(spark))
    return got.withColumn("metrics", F.array_join("metrics", ", "))


AREA_COLUMNS = ("Generation (MWh)", "Load (MWh)", "Installed Capacity (MW)", "Export Flow (MWh)", "Import Flow(MWh)", "Gen - Load")


@query(f"""WITH q AS (SELECT DISTINCT 'C' || s_nationkey AS case_id, ({list(AREA_COLUMNS)!r})[s_suppkey % 6 + 1] AS quantity, (s_suppkey % 10 + s_nationkey) % 3 <> 0 AS held, (s_suppkey % 10 + s_nationkey) % 3 <> 1 AS fresh FROM supplier WHERE s_suppkey % 4 <> 3),
d(metric, a, b) AS (VALUES {", ".join(f"('{m}', '{a}', '{b}')" for m, a, b, _ in rules.AREA_DERIVED)}),
x AS (SELECT c.case_id, metric, EXISTS (FROM q WHERE q.case_id = c.case_id AND quantity = a AND held) AS ha, EXISTS (FROM q WHERE q.case_id = c.case_id AND quantity = b AND held) AS hb, EXISTS (FROM q WHERE q.case_id = c.case_id AND quantity = a AND fresh) AS fa, EXISTS (FROM q WHERE q.case_id = c.case_id AND quantity = b AND fresh) AS fb,
  EXISTS (FROM q WHERE q.case_id = c.case_id AND quantity = metric AND (held OR fresh)) AS own FROM (SELECT DISTINCT case_id FROM q) c, d)
SELECT case_id, metric FROM x WHERE (ha OR fa) AND (hb OR fb) AND NOT (ha AND hb) AND NOT (fa AND fb) AND NOT own""")
def operands_that_arrive_apart(spark: SparkSession, sf: str) -> DataFrame:
    """Q-18: calculated metrics whose operands came with different loads."""
    k, c = F.col("s_suppkey"), F.col("s_nationkey")
    mark = (k % 10 + c) % 3
    rows = table(spark, sf, "supplier").filter(k % 4 != 3).select(F.concat(F.lit("C"), c.cast("string")).alias("case_id"), F.element_at(F.array(*map(F.lit, AREA_COLUMNS)), (k % 6 + 1).cast("int")).alias("quantity"), mark.alias("mark"))
    return series.operands_apart(rows.filter("mark <> 0"), rows.filter("mark <> 1"), rules.derived_metrics(spark))


# ---------------------------------------------------------------- limits files


def limits_file(spark: SparkSession, sf: str) -> str:
    """A limits file of the suppliers, out of order in many ways: a blank marker title, second markers, rows that repeat or lack a name or a side."""
    k = F.col("s_suppkey")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("Max").alias("side")), F.struct(F.lit(1).alias("turn"), F.lit(" min ").alias("side"))))
    month = lambda m: F.when((k + m) % 13 == 0, "").when((k + m) % 17 == 0, "99999").when((k + m) % 19 == 0, "95,000").when((k + m) % 23 == 0, "85000.5").when(k % 6 == 0, "100").otherwise((k % 50 * 10 + m).cast("string"))
    cell = lambda m: F.when(month(m).contains(","), F.concat(F.lit('"'), month(m), F.lit('"'))).otherwise(month(m))
    rows = table(spark, sf, "supplier").select("s_suppkey", sides.alias("x"))
    name = F.when(k % 29 == 0, "").otherwise(F.concat(F.lit("IF "), F.when(k % 31 == 0, k - 1).otherwise(k).cast("string")))
    line = F.concat_ws(",", name, (F.lit(2030) + k % 3).cast("string"), F.when(k % 37 == 0, "either").otherwise(F.col("x.side")), *(cell(m) for m in range(1, 13)), F.when(k % 41 == 0, "MAX").otherwise("note"))
    body = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", F.col("x.turn").alias("turn"), line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))  # one file of limits is small: two rows an interface
    head = "INTERFACELIMITSCHEDULE_MONTHLY\nall values in MW\n\nInterface Name,Year,," + ",".join(lists.MONTHS) + ",Start of note\n"
    return _written(spark, body.select(F.lit("limits.csv").alias("name"), F.concat(F.lit(head), "body").alias("text")), "limits") + "/limits.csv"


_MONTH_SQL = "CASE WHEN (k + m) % 13 = 0 THEN NULL WHEN (k + m) % 17 = 0 THEN 99999 WHEN (k + m) % 19 = 0 THEN 95000 WHEN (k + m) % 23 = 0 THEN 85000.5 WHEN k % 6 = 0 THEN 100 ELSE k % 50 * 10 + m END"
LAYOUT = f"""
r AS (SELECT s_suppkey AS k, turn, CASE WHEN s_suppkey % 29 = 0 THEN '' ELSE 'IF ' || CASE WHEN s_suppkey % 31 = 0 THEN s_suppkey - 1 ELSE s_suppkey END END AS name,
    CASE WHEN s_suppkey % 37 <> 0 THEN CASE turn WHEN 0 THEN 'MAX' ELSE 'MIN' END WHEN s_suppkey % 41 = 0 THEN 'MAX' END AS side, CASE WHEN s_suppkey % 37 <> 0 THEN 2 WHEN s_suppkey % 41 = 0 THEN 15 END AS marker_at,
    (s_suppkey % 37 <> 0)::INT + (s_suppkey % 41 = 0)::INT AS markers, list_transform(range(1, 13), lambda m: ({_MONTH_SQL.replace('k', 's_suppkey')})::DOUBLE) AS v FROM supplier, range(2) AS t(turn)),
p AS (SELECT *, row_number() OVER (PARTITION BY name, side ORDER BY k, turn) AS place FROM r), x AS (SELECT *, side IS NOT NULL AND name <> '' AND place = 1 AS read FROM p)"""


@query(f"""WITH {LAYOUT} SELECT count(DISTINCT name) FILTER (read) AS interfaces, count(*) FILTER (read) AS rows, count(*) FILTER (side IS NOT NULL AND name <> '' AND place > 1) AS duplicate_rows, count(*) FILTER (side IS NULL) AS rows_without_side, count(*) FILTER (side IS NOT NULL AND name = '') AS rows_without_name,
  count(DISTINCT marker_at) FILTER (read) AS marker_columns, count(*) FILTER (read AND markers > 1) AS second_markers, count(DISTINCT k % 3) FILTER (read) AS distinct_years,
  sum(len(list_filter(v, lambda y: y IS NULL))) FILTER (read)::BIGINT AS blank_cells, sum(len(list_filter(v, lambda y: y > 90000))) FILTER (read)::BIGINT AS no_limit_cells, sum(len(list_filter(v, lambda y: y > 90000 AND y <> 99999))) FILTER (read)::BIGINT AS odd_no_limits, sum(len(list_filter(v, lambda y: y BETWEEN 81000 AND 90000))) FILTER (read)::BIGINT AS near_threshold,
  count(*) FILTER (read AND len(list_distinct(list_filter(v, lambda y: y <= 90000))) > 1) AS varying, CASE WHEN count(DISTINCT marker_at) FILTER (read) = 1 THEN min(marker_at) FILTER (read) = 2 END AS marker_title_blank, 1 AS finer_columns FROM x""")
def limits_layout(spark: SparkSession, sf: str) -> DataFrame:
    """A-28: the layout of a limits file and what its cells hold, from the raw cells."""
    return lists.limits_layout(spark, limits_file(spark, sf))


FINDINGS = """
fx AS (SELECT entity AS interface, month, max(net) AS hi, min(net) AS lo FROM h GROUP BY ALL),
f AS (SELECT side, CASE side WHEN 'MAX' THEN hi ELSE lo END AS flow, value AS lim FROM lim JOIN fx USING (interface, month) WHERE scope_case IS NULL),
fd AS (SELECT side, CASE WHEN lim IS NULL THEN 'no limit' WHEN CASE side WHEN 'MAX' THEN flow - lim ELSE lim - flow END > 0.01::DOUBLE * abs(lim) THEN 'exceeded' WHEN side = 'MAX' AND lim <= 0 THEN 'ceiling' WHEN side = 'MIN' AND lim >= 0 THEN 'floor'
  WHEN sign(flow) = -sign(lim) THEN 'opposite sign' WHEN abs(flow) / abs(lim) >= 0.5::DOUBLE THEN '50-100%' WHEN abs(flow) / abs(lim) >= 0.01::DOUBLE THEN 'under 50%' ELSE 'under 1%' END AS finding FROM f)"""


@query(f"""WITH {H}, {LIMITS}, {FINDINGS}, c AS (SELECT side, finding, count(*) AS n, grouping(side, finding) AS level FROM fd GROUP BY ROLLUP (side, finding))
SELECT side, finding, n, round(n / CASE level WHEN 0 THEN max(n) FILTER (level = 1) OVER (PARTITION BY side) ELSE max(n) OVER () END, 6) AS share FROM c""")
def limit_finding_shares(spark: SparkSession, sf: str) -> DataFrame:
    """A-27: shares of the findings by side and over all month-sides."""
    audit = ranges.limit_audit(ranges.flow_extremes(series_of(hourly(spark, sf), "net")), limits(spark, sf).filter("scope_case is null").drop("scope_case"))
    return rounded(ranges.finding_shares(audit), 6)


# ---------------------------------------------------------------- cells and labels


def cell_text_ctes(source: str, value: str) -> str:
    """CTEs s1 to s3: the rows of ``source`` with ``cell``, the text of ``value`` as a single-precision number."""
    # halves are rounded away from zero, and printf rounds them to even: the next double is no half
    tried = [f"printf('%.{n}e', f::DOUBLE * 1.0000000000000002::DOUBLE)" for n in (6, 7, 8)]
    return f"""
s1 AS (SELECT *, ({value})::FLOAT AS f FROM {source}),
s2 AS (SELECT *, CASE WHEN {tried[0]}::DOUBLE::FLOAT = f THEN {tried[0]} WHEN {tried[1]}::DOUBLE::FLOAT = f THEN {tried[1]} ELSE {tried[2]} END AS t FROM s1 WHERE f IS NOT NULL AND isfinite(f) UNION ALL SELECT *, NULL FROM s1 WHERE f IS NULL OR NOT isfinite(f)),
s3 AS (SELECT *, regexp_replace(replace(split_part(ltrim(t, '-'), 'e', 1), '.', ''), '0+$', '') AS dg, split_part(t, 'e', 2)::INT AS pw, CASE WHEN t LIKE '-%' THEN '-' ELSE '' END AS sg FROM s2),
s4 AS (SELECT *, CASE WHEN t IS NULL THEN '' WHEN abs(f) < 1e9 AND f = floor(f) THEN f::BIGINT::VARCHAR
  WHEN pw >= 9 OR pw < -6 THEN sg || left(dg, 1) || CASE WHEN length(dg) > 1 THEN '.' || substr(dg, 2) ELSE '' END || 'e' || CASE WHEN pw < 0 THEN '-' ELSE '+' END || abs(pw)
  WHEN pw < 0 THEN sg || '0.' || repeat('0', -pw - 1) || dg ELSE sg || left(dg, pw + 1) || '.' || substr(dg, pw + 2) END AS cell FROM s3)"""


#: Powers of ten by which prices become numbers of every size.
POWERS = (1e-12, 1e-9, 1e-7, 1e-5, 1e-3, 1.0, 1e2, 1e4, 1e6, 1e8)
_RAW = f"""raw AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE (l_partkey + l_suppkey) % 50 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE WHEN 3 THEN '-0.0'::DOUBLE WHEN 4 THEN l_partkey ELSE
  l_extendedprice * ([{", ".join(f"{p!r}::DOUBLE" for p in POWERS)}])[l_orderkey % 10 + 1] * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * {1 / 7!r}::DOUBLE END AS raw FROM lineitem)"""


@query(f"""WITH {_RAW}, {cell_text_ctes("raw", "raw")},
z AS (SELECT *, ltrim(cell, '-') AS u FROM s4), y AS (SELECT *, lpad(split_part(u, '.', 1), greatest(3, length(split_part(u, '.', 1)))::INT, '0') AS w, split_part(u, '.', 2) AS fr FROM z),
x AS (SELECT *, regexp_replace(left(w, length(w) - 2), '^0+([0-9])', '\\1') AS whole, regexp_replace(right(w, 2) || fr, '0+$', '') AS rest FROM y)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cell, CASE WHEN cell = '' THEN '' WHEN cell LIKE '%e%' THEN split_part(cell, 'e', 1) || 'e' || CASE WHEN split_part(cell, 'e', 2)::INT - 2 >= 0 THEN '+' ELSE '' END || (split_part(cell, 'e', 2)::INT - 2)
  ELSE CASE WHEN cell LIKE '-%' AND whole || rest <> '0' THEN '-' ELSE '' END || whole || CASE WHEN rest <> '' THEN '.' || rest ELSE '' END END AS ratio FROM x""")
def cell_texts_of_any_size(spark: SparkSession, sf: str) -> DataFrame:
    """T-18: numbers from 1e-9 to 1e13, blanks, -0 and what is not finite, as cells and as ratios."""
    li, kind = table(spark, sf, "lineitem"), (F.col("l_partkey") + F.col("l_suppkey")) % 50
    sized = F.col("l_extendedprice") * F.element_at(F.array(*map(F.lit, POWERS)), (F.col("l_orderkey") % 10 + 1).cast("int")) * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1) * (1 / 7)
    raw = F.when(kind == 0, None).when(kind == 1, float("nan")).when(kind == 2, float("inf")).when(kind == 3, -0.0).when(kind == 4, F.col("l_partkey").cast("double")).otherwise(sized)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    cells = li.select(*keys, raw.alias("raw")).select(*keys, browse.cell_text(F.col("raw")).alias("cell"))
    return cells.withColumn("ratio", browse.percent_text_as_ratio(F.col("cell")))


@query(f"""WITH {H}, d AS (SELECT DISTINCT year, slot_hour, slot_day FROM h), s AS (SELECT min(year) AS y0 FROM h), a AS (SELECT *, (365 - slot_day * 3) AS other FROM d),
n AS (SELECT *, least(slot_day, greatest(least(other, 365), 0)) AS p, greatest(slot_day, greatest(least(other, 365), 0)) AS q FROM a),
m AS (SELECT *, strftime(DATE '2000-01-01' + p::INT, '%b ') || day(DATE '2000-01-01' + p::INT) AS lp, strftime(DATE '2000-01-01' + q::INT, '%b ') || day(DATE '2000-01-01' + q::INT) AS lq FROM n)
SELECT year, slot_hour, CASE WHEN p = q THEN lp ELSE lp || ' ' || chr(8211) || ' ' || lq END AS days, 'HE ' || (slot_hour % 24 + 1) AS of_day, (['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'])[(slot_hour % 168) // 24 + 1] || ' HE ' || (slot_hour % 24 + 1) AS of_week,
  'day ' || ((slot_hour % 744) // 24 + 1) || ' HE ' || (slot_hour % 24 + 1) AS of_month, slot_hour || ' of ' || year || ' (' || strftime(DATE '2000-01-01' + slot_day::INT, '%b ') || day(DATE '2000-01-01' + slot_day::INT) || ', hour ending ' || (slot_hour % 24 + 1) || ')' AS of_span FROM m""")
def hour_labels(spark: SparkSession, sf: str) -> DataFrame:
    """T-21: ranges of days, hours on the axis of a day, a week and a month, hours of a span."""
    h = hourly(spark, sf).select("year", "slot_hour").distinct()
    first = h.agg(F.min("year").alias("first_year"))
    day, hour = cal.day_of_slot(), F.col("slot_hour")
    at = h.join(F.broadcast(first)).withColumn("axis_hour", (F.col("year") - F.col("first_year")) * cal.SLOT_HOURS + hour)
    return at.select("year", "slot_hour", browse.range_label(day, 365 - day * 3).alias("days"), browse.axis_label("day", hour % 24).alias("of_day"), browse.axis_label("week", hour % 168).alias("of_week"), browse.axis_label("month", hour % 744).alias("of_month"), browse.span_hour_label(F.col("first_year"), F.col("axis_hour")).alias("of_span"))
