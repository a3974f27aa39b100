"""Registered queries, fourth part: files. Export files, lists and tables are written from the test tables and read back.

A file holds a month of a case (or a table of the benchmark's fixed size), so that no task holds more than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casehours import sinks
from casehours.functions import calendar as cal
from casehours.operators import groups, merge, stats
from casehours.plans.facts import H, LIMITS, MEMBERS, hourly, limits, memberships, series_of, stats_sql, table
from casehours.plans.queries import query, rounded
from casehours.plans.text_queries import pick
from casehours.session import scratch, written
from casehours.sources import exports, lists
from casehours.sources.catalog import catalog, import_plan
from casehours.streaming.append import append_files

# ---------------------------------------------------------------- export files

#: How a long file's rows go wrong, by hour of the year: each row has one cause at most.
LONG_FAULTS = ((11, "bad date or hour"), (13, "blank or quoted id"), (17, "bad time of use"), (19, "ragged row"), (23, "bad cell"))
WIDE_FAULTS = ((29, "bad date or hour"), (31, "bad time of use"), (37, "field beyond the header"), (41, "bad cell"))


def _fault(faults: tuple, wanted: str):
    """Does the hour's row have this fault? The first that applies counts."""
    out = F.lit(False)
    for n, name in reversed(faults):
        out = F.when(F.col("slot_hour") % n == 0, name == wanted).otherwise(out)
    return out


def _fault_sql(faults: tuple) -> str:
    return "CASE " + " ".join(f"WHEN slot_hour % {n} = 0 THEN '{name}'" for n, name in faults) + " END"


def _written(spark: SparkSession, files: DataFrame, name: str) -> str:
    """The folder into which ``files`` (name, text) were written."""
    place = scratch(spark, name)
    sinks.write_texts(files, place).agg(F.sum("bytes")).collect()
    return place


def _month_name(suffix: str):
    return F.format_string("%s~%d-%02d" + suffix, "case_id", "year", "month")


def _with_date(h: DataFrame) -> DataFrame:
    d = F.make_date("year", cal.month_of(), cal.monthday_of())
    return h.withColumn("month", cal.month_of()).withColumn("date", F.date_format(d, "M/d/yyyy")).withColumn("he", cal.he_of())


def long_files(spark: SparkSession, sf: str, faulty: bool) -> str:
    """Area exports of two metrics, a file for each month of a case: CRLF, padded header; perhaps with faults."""
    h = _with_date(hourly(spark, sf))
    wrong = lambda name: _fault(LONG_FAULTS, name) if faulty else F.lit(False)
    cells = [
        F.when(wrong("bad date or hour"), "13/45/1996").otherwise(F.col("date")),
        F.col("he").cast("string"),
        F.when(wrong("bad time of use"), "sometimes").otherwise(F.col("tou")),
        F.when(wrong("blank or quoted id"), "").otherwise(F.col("entity")),
        F.when(wrong("bad cell"), "n.a.").otherwise(F.col("load").cast("string")),
        F.when(F.col("slot_hour") % 9 == 0, "").otherwise(F.concat(F.lit(" "), F.col("net").cast("string"))),
    ]
    line = F.concat_ws(",", *cells, F.when(wrong("ragged row"), "9"))
    body = h.groupBy("case_id", "year", "month").agg(F.array_join(F.array_sort(F.collect_list(line)), "\r\n").alias("body"))
    text = F.concat(F.lit("Date, Hour, TOU, Name,Load (MWh), Net ($) \r\n"), "body", F.lit("\r\n"))
    return _written(spark, body.select(_month_name(".csv").alias("name"), text.alias("text")), "long-exports")


def wide_files(spark: SparkSession, sf: str, faulty: bool = False, kind: str = "area") -> str:
    """Exports of the load with a column for each nation, a file for each month of a case; bus exports have an id row."""
    names = table(spark, sf, "nation").orderBy("n_nationkey").select("n_name", "n_nationkey").collect()  # 25 rows
    h = _with_date(hourly(spark, sf))
    by = h.groupBy("case_id", "year", "month", "date", "he", "slot_hour", "tou").pivot("entity", [r["n_name"] for r in names]).agg(F.sum("load"))
    wrong = lambda name: _fault(WIDE_FAULTS, name) if faulty else F.lit(False)
    own = [F.coalesce(F.col(f"`{r['n_name']}`").cast("string"), F.lit("")) for r in names]
    own[0] = F.when(wrong("bad cell"), "?").otherwise(own[0])
    cells = [F.when(wrong("bad date or hour"), "2/30/1996").otherwise(F.col("date")), F.col("he").cast("string"), F.when(wrong("bad time of use"), "").otherwise(F.col("tou")), *own]
    line = F.concat_ws(",", *cells, F.when(wrong("field beyond the header"), "7"))
    body = by.groupBy("case_id", "year", "month").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    y = F.col("year").cast("string")
    head = [F.concat(F.lit(f"{kind.title()} Hourly 'Load (MWh)' Data for Year "), y), F.lit(""), F.concat(F.lit("(From the first hour of 1/1/"), y, F.lit(" to the last hour of 12/31/"), y, F.lit(". Column identifier -- Name)")), F.lit("")]
    if kind == "bus":
        head.append(F.lit(",,BusNumber," + ",".join(str(1000 + r["n_nationkey"]) for r in names)))
    head.append(F.lit("Date, Hour, TOU," + ",".join(r["n_name"] for r in names)))
    return _written(spark, body.select(_month_name(".txt").alias("name"), F.concat_ws("\n", *head, "body").alias("text")), "wide-exports")


def _files(spark: SparkSession, place: str, pattern: str) -> DataFrame:
    return exports.ranked_files(catalog(spark, place, pattern))


FILES = "f AS (SELECT DISTINCT case_id, year, month FROM h), n AS (SELECT case_id, case_id || '~' || year || '-' || lpad(month::VARCHAR, 2, '0') AS stem, year FROM f)"


@query(f"""WITH {H}, {FILES} SELECT stem || '.csv' AS src_file, 'area' AS kind, 'long' AS shape, NULL AS quantity, NULL::INT AS first_year, 6 AS columns, case_id || '~' || year AS case_id, NULL AS reason FROM n
UNION ALL SELECT stem || '.txt', 'bus', 'wide', 'Load (MWh)', year, 28, case_id || '~' || year, NULL FROM n""")
def export_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """S-01, S-04, S-05, S-13: what the files are, from their first lines alone."""
    both = [catalog(spark, p, "*-??.csv") for p in (long_files(spark, sf, False), wide_files(spark, sf, kind="bus"))]
    files = both[0].unionByName(both[1])
    case = F.regexp_extract("src_file", r"^(.*)-\d\d\.", 1)
    return files.select("src_file", "kind", "shape", "quantity", "first_year", F.size("columns").alias("columns"), case.alias("case_id"), "reason")


@query(f"""WITH {H}, {FILES} SELECT case_id, 'area' AS kind, NULL AS quantity, list_sort(list(stem || '.csv')) AS files, NULL AS conflict FROM n GROUP BY 1""")
def import_plans(spark: SparkSession, sf: str) -> DataFrame:
    """S-13, S-14: the case is in the file name; files of one case and kind build one table."""
    files = catalog(spark, long_files(spark, sf, False))
    return import_plan(files.withColumn("case_id", F.substring_index("src_file", "~", 1)))


def _long_facts(spark: SparkSession, sf: str, faulty: bool = False, retained: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    files = catalog(spark, long_files(spark, sf, faulty)).withColumn("case_id", F.substring_index("src_file", "~", 1))
    return exports.read_long(spark, exports.ranked_files(files), retained)


@query(f"""WITH {H} SELECT case_id, entity, 'Load (MWh)' AS quantity, count(*) AS cells, count(load) AS filled, round(sum(load), 4) AS total, min(year) AS first_year FROM h GROUP BY ALL
UNION ALL SELECT case_id, entity, 'Net ($)', count(*), count(*) FILTER (slot_hour % 9 <> 0), round(sum(net) FILTER (slot_hour % 9 <> 0), 4), min(year) FROM h GROUP BY ALL""")
def long_export(spark: SparkSession, sf: str) -> DataFrame:
    """S-02, J-01: long exports as facts, written and read back."""
    facts, _ = _long_facts(spark, sf)
    return rounded(facts.groupBy("case_id", "entity", "quantity").agg(F.count(F.lit(1)).alias("cells"), F.count("value").alias("filled"), F.sum("value").alias("total"), F.min("year").alias("first_year")))


@query(f"WITH {H} SELECT case_id, count(*) AS cells, round(sum(load), 4) AS total FROM h GROUP BY 1")
def retained_columns(spark: SparkSession, sf: str) -> DataFrame:
    """F-14: only the retained metric is read."""
    facts, _ = _long_facts(spark, sf, retained=["Load (MWh)"])
    return rounded(facts.groupBy("case_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total")))


@query(f"WITH {H}, q AS (SELECT case_id || '~' || year || '-' || lpad(month::VARCHAR, 2, '0') || '.csv' AS src_file, {_fault_sql(LONG_FAULTS)} AS cause FROM h) SELECT src_file, cause, count(*) AS rows FROM q WHERE cause IS NOT NULL GROUP BY ALL")
def long_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Q-01: rows that cannot be read, each counted against one cause."""
    return _long_facts(spark, sf, faulty=True)[1]


@query(f"WITH {H}, d AS (SELECT count(DISTINCT n_name) AS n FROM nation), t AS (SELECT case_id, year, slot_hour, entity, sum(load) AS v FROM h GROUP BY ALL), x AS (SELECT case_id, year, count(DISTINCT slot_hour) AS hours FROM t GROUP BY ALL), s AS (SELECT case_id, year, count(*) AS filled, round(sum(v), 4) AS total FROM t GROUP BY ALL) SELECT case_id, year, 'Load (MWh)' AS quantity, hours * n AS cells, filled, total FROM x JOIN s USING (case_id, year), d")
def wide_export(spark: SparkSession, sf: str) -> DataFrame:
    """S-03, S-04: wide exports as facts, written and read back; a cell for every column and hour."""
    files = catalog(spark, wide_files(spark, sf)).withColumn("case_id", F.substring_index("src_file", "~", 1))
    facts, _ = exports.read_wide(spark, exports.ranked_files(files))
    return rounded(facts.groupBy("case_id", "year", "quantity").agg(F.count(F.lit(1)).alias("cells"), F.count("value").alias("filled"), F.sum("value").alias("total")))


@query(f"WITH {H} SELECT case_id, (1000 + n_nationkey)::VARCHAR AS entity, round(sum(load), 4) AS total FROM h JOIN nation ON n_name = entity GROUP BY ALL")
def wide_bus_export(spark: SparkSession, sf: str) -> DataFrame:
    """S-05: columns of bus exports are known by the id row, not by their names."""
    files = catalog(spark, wide_files(spark, sf, kind="bus")).withColumn("case_id", F.substring_index("src_file", "~", 1))
    facts, _ = exports.read_wide(spark, exports.ranked_files(files))
    return rounded(facts.groupBy("case_id", "entity").agg(F.sum("value").alias("total")).filter("total is not null"))


@query(f"WITH {H}, r AS (SELECT DISTINCT case_id, year, month, slot_hour FROM h), q AS (SELECT case_id || '~' || year || '-' || lpad(month::VARCHAR, 2, '0') || '.txt' AS src_file, {_fault_sql(WIDE_FAULTS)} AS cause FROM r) SELECT src_file, cause, count(*) AS rows FROM q WHERE cause IS NOT NULL GROUP BY ALL")
def wide_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Q-02: rows of wide exports that cannot be read."""
    files = catalog(spark, wide_files(spark, sf, faulty=True)).withColumn("case_id", F.substring_index("src_file", "~", 1))
    return exports.read_wide(spark, exports.ranked_files(files))[1]


WIDE_COLUMNS = 5900


@query(f"""WITH {H}, c AS (SELECT l_partkey % {WIDE_COLUMNS} AS k, count(*)::DOUBLE AS v FROM lineitem GROUP BY 1) SELECT kind, {WIDE_COLUMNS} AS columns, count(*) AS filled, sum(v) AS total, max(k)::BIGINT AS last FROM c, (VALUES ('bus'), ('interface')) AS t(kind) GROUP BY ALL""")
def widest_exports(spark: SparkSession, sf: str) -> DataFrame:
    """S-03, S-05: headers of 5,900 columns, far beyond the first 64 KiB of a file, are read whole."""
    counts = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % WIDE_COLUMNS).alias("k")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    every = spark.range(WIDE_COLUMNS).select(F.col("id").alias("k")).join(counts, "k", "left")  # one row of a file
    row = every.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce(F.col("v").cast("string"), F.lit("")).alias("t")))), lambda x: x["t"]), ",").alias("row"))
    names = [f"INTERFACE_NAME_{k:05d}" for k in range(WIDE_COLUMNS)]
    texts = []
    for kind in ("bus", "interface"):
        head = [f"{kind.title()} Hourly 'Flow (MW)' Data for Year 2034", "", "(From the first hour of 1/1/2034 to the last hour of 12/31/2034. Column identifier -- Name)", ""]
        head += [",,BusNumber," + ",".join(str(k) for k in range(WIDE_COLUMNS))] if kind == "bus" else []
        head += ["Date,Hour,TOU," + ",".join(names)]
        texts.append(row.select(F.lit(f"{kind}.txt").alias("name"), F.concat(F.lit("\n".join(head) + "\n1/1/2034,1,OffPeak,"), "row").alias("text")))
    facts, bad = exports.read_wide(spark, exports.ranked_files(catalog(spark, _written(spark, texts[0].unionByName(texts[1]), "widest"))))
    last = F.max(F.when(F.col("value").isNotNull(), F.regexp_extract("entity", r"(\d+)$", 1).cast("long")))
    found = facts.groupBy("kind").agg(F.count(F.lit(1)).cast("int").alias("columns"), F.count("value").alias("filled"), F.sum("value").alias("total"), last.alias("last"))
    return found.join(bad, F.lit(False), "left_anti") if not bad.limit(1).count() else found.limit(0)


@query(f"WITH {H} SELECT case_id || '~' || year || '-' || lpad(month::VARCHAR, 2, '0') || '.csv' AS src_file, year, count(*) AS rows, count(DISTINCT entity) AS entities FROM h GROUP BY case_id, year, month")
def axis_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A-23: rows, years and entities that each file carries."""
    return exports.axis_scan(_long_facts(spark, sf, retained=["Load (MWh)"])[0])


@query(f"WITH {H}, t AS (SELECT count(DISTINCT (case_id, year)) AS n FROM h), e AS (SELECT entity, list_sort(list(DISTINCT case_id || year)) AS files FROM h GROUP BY 1) SELECT entity, files, len(files) = n AS in_every FROM e, t")
def entity_files(spark: SparkSession, sf: str) -> DataFrame:
    """A-25: which files (a case's year) carry each entity, and whether all do."""
    h = hourly(spark, sf).select("entity", F.concat("case_id", F.col("year").cast("string")).alias("src_file"))
    return groups.entity_files(h)


@query(f"WITH {H} SELECT entity AS name, min((year * 10000 + slot_hour)::BIGINT) AS src_order FROM h GROUP BY 1")
def name_union(spark: SparkSession, sf: str) -> DataFrame:
    """U-01: all names that files carry, in the order in which they are first seen."""
    return groups.union_of_names(hourly(spark, sf).select(F.col("entity").alias("name"), (F.col("year") * 10000 + F.col("slot_hour")).cast("long").alias("src_order")))


@query(f"""WITH {H}, s AS (SELECT case_id, CASE WHEN year % 2 = 0 THEN 'area' ELSE 'bus' END AS kind, 'f' || year AS src_file, entity FROM h), n AS (SELECT src_file, count(DISTINCT entity) AS in_source FROM s GROUP BY 1)
SELECT case_id, kind, src_file, count(DISTINCT entity) AS kept, any_value(in_source) AS in_source FROM s JOIN n USING (src_file) WHERE entity NOT LIKE '%1' GROUP BY case_id, kind, src_file""")
def load_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """A-29: entities that each file's table keeps, against those that the file has."""
    s = hourly(spark, sf).select("case_id", F.when(F.col("year") % 2 == 0, "area").otherwise("bus").alias("kind"), F.concat(F.lit("f"), F.col("year").cast("string")).alias("src_file"), "entity")
    return groups.source_counts(s.filter("entity not like '%1'"), s.select("src_file", F.col("entity").alias("name")))


@query(f"WITH {H}, s AS (SELECT case_id, CASE WHEN year % 2 = 0 THEN 'area' ELSE 'bus' END AS kind, 'f' || year AS src_file FROM h) SELECT case_id, list_sort(list(DISTINCT src_file) FILTER (kind = 'area')) AS area, list_sort(list(DISTINCT src_file) FILTER (kind = 'bus')) AS bus FROM s GROUP BY 1")
def inventory_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """A-29: the files behind each case's tables, a column for each kind."""
    s = hourly(spark, sf).select("case_id", F.when(F.col("year") % 2 == 0, "area").otherwise("bus").alias("kind"), F.concat(F.lit("f"), F.col("year").cast("string")).alias("src_file"))
    return groups.inventory(s, ["area", "bus"])


@query(f"""WITH {H}, f AS (SELECT DISTINCT case_id AS src_file, entity AS name FROM h), w AS (SELECT src_file, n_name AS name FROM (SELECT DISTINCT src_file FROM f), nation)
SELECT src_file, list_sort(list(name)) AS absent FROM w ANTI JOIN (FROM f WHERE name NOT LIKE '%2') USING (src_file, name) GROUP BY 1""")
def absent_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Q-08: retained columns that a file does not carry."""
    f = hourly(spark, sf).select(F.col("case_id").alias("src_file"), F.col("entity").alias("name"))
    return merge.coverage_notes(f, table(spark, sf, "nation").select(F.col("n_name").alias("name")), f.filter("name not like '%2'"))


@query(f"WITH {H} SELECT DISTINCT c.case_id, l.entity FROM (SELECT DISTINCT case_id FROM h) c, (SELECT n_name AS entity FROM nation UNION ALL SELECT r_name FROM region) l WHERE NOT EXISTS (FROM h WHERE h.case_id = c.case_id AND h.entity = l.entity AND month = 2)")
def entities_without_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Q-08: entities of the list that a case has no row of (in February); regions are listed too and have none."""
    h = written(hourly(spark, sf).select("case_id", "entity", "slot_hour"), "hourly-facts")
    names = table(spark, sf, "nation").select(F.col("n_name").alias("entity")).unionByName(table(spark, sf, "region").select(F.col("r_name").alias("entity")))
    listed = names.join(F.broadcast(h.agg(F.collect_set("case_id").alias("cases")))).select("entity", F.explode("cases").alias("case_id"))
    return merge.entities_without_rows(listed, h.filter(cal.month_of() == 2), ["case_id"])


# ---------------------------------------------------------------- lists, limits, memberships


def list_file(spark: SparkSession, sf: str) -> str:
    """A bus list of the suppliers: banner, quoting, blank and repeated keys, cells that say nothing, a column of its own."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit('"'), F.col("s_name"), F.lit(', ""east"""'))
    cells = [F.when(k % 10 == 0, " ").when(k % 10 == 1, (k - 1 + 2).cast("string")).otherwise(k.cast("string")), name, pick(["138", "1,100.5", "NA", "'69"], k), pick(["YES", "false", "?"], k), pick(["0", "45.5", "x"], k), F.col("s_nationkey").cast("string")]
    cells[1], cells[2] = cells[1], F.concat(F.lit('"'), cells[2], F.lit('"'))
    rows = table(spark, sf, "supplier").select("s_suppkey", F.concat_ws(",", *cells).alias("line"))
    body = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "line"))), lambda x: x["line"]), "\n").alias("body"))  # one list is one file
    head = "BUS_GENERAL,exported\nBusID, Name,BaseKV,Monitored,Latitude,Zone of mine\n"
    return _written(spark, body.select(F.lit("buses.csv").alias("name"), F.concat(F.lit(head), "body").alias("text")), "lists") + "/buses.csv"


LISTED = """
r AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 10 = 1 THEN s_suppkey + 1 ELSE s_suppkey END AS bus, s_name || ', "east"' AS name, s_nationkey FROM supplier)"""


@query(f"""WITH {LISTED}, f AS (SELECT *, row_number() OVER (PARTITION BY bus ORDER BY k) AS rn FROM r WHERE bus IS NOT NULL)
SELECT bus::INT AS "BusID", name AS "Name", CASE k % 4 WHEN 0 THEN 138 WHEN 1 THEN 1100.5 WHEN 3 THEN 69 END::DOUBLE AS "BaseKV", CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS "Monitored", CASE k % 3 WHEN 1 THEN 45.5::DOUBLE END AS "Latitude", s_nationkey::VARCHAR AS "Zone of mine" FROM f WHERE rn = 1""")
def reference_list(spark: SparkSession, sf: str) -> DataFrame:
    """S-06: a list of buses, typed; the first row of a key stays, rows without key go."""
    return lists.read_list(spark, list_file(spark, sf), "bus_list")


@query(f"""WITH {LISTED} SELECT count(*) AS rows, count(*) FILTER (bus IS NULL) AS blank_keys, count(bus) - count(DISTINCT bus) AS repeated_keys, ['Zone of mine'] AS undeclared, ['LoadArea', 'Longitude', 'PSSEArea', 'PSSEZone', 'Type', 'VA', 'VM'] AS missing FROM r""")
def list_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Q-11: blank and repeated keys, undeclared and missing columns of a list."""
    return lists.list_quality(spark, list_file(spark, sf), "bus_list")


@query(f"""WITH {LIMITS} SELECT interface, side, month::INT AS month, CASE WHEN interface LIKE '%9' THEN NULL ELSE round(value, 4) END AS value FROM lim WHERE scope_case IS NULL""")
def monthly_limits(spark: SparkSession, sf: str) -> DataFrame:
    """S-07: limits as a schedule of twelve months; the side is found by its value, blanks and 99999 are no limit."""
    months = F.transform(F.array_sort(F.collect_list(F.struct("month", F.when(F.col("interface").like("%9"), "99999").otherwise(F.coalesce(F.col("value").cast("string"), F.lit(""))).alias("t")))), lambda x: x["t"])
    rows = limits(spark, sf).filter("scope_case is null").groupBy("interface", "side").agg(F.array_join(months, ",").alias("cells"))
    line = F.concat_ws(",", "interface", F.lit("2035"), F.initcap("side"), "cells")
    body = rows.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))  # 25 interfaces
    head = "INTERFACELIMITSCHEDULE_MONTHLY\n\nInterface Name,Year,Kind," + ",".join(lists.MONTHS) + "\n"
    place = _written(spark, body.select(F.lit("limits.csv").alias("name"), F.concat(F.lit(head), "body").alias("text")), "limits")
    return rounded(lists.read_limits(spark, f"{place}/limits.csv").drop("scope_case"))


def membership_file(spark: SparkSession, rows: DataFrame, titles: list[str], order: str) -> str:
    """A membership file of a small grouping, in order."""
    line = F.concat_ws(",", *[F.coalesce(F.col(t).cast("string"), F.lit("")) for t in titles])
    body = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    text = F.concat(F.lit(",".join(titles) + "\n"), "body")
    return _written(spark, body.select(F.lit("members.csv").alias("name"), text.alias("text")), "members") + "/members.csv"


@query("SELECT n_name AS entity, r_name AS grp, 1 AS coef FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 4")
def area_membership(spark: SparkSession, sf: str) -> DataFrame:
    """S-08: areas of groups; rows without a name go, repeated ones count once."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.when(F.col("n_nationkey") % 5 != 4, F.col("n_name")).alias("Name"), F.col("r_name").alias("Grouping"))
    both = rows.unionByName(rows.withColumn("n_nationkey", F.col("n_nationkey") + 100))
    got = lists.read_membership(spark, membership_file(spark, both, ["Name", "Grouping"], "n_nationkey"), {"name": "Name", "grp": "Grouping"})
    return lists.area_members(got).select("entity", "grp", "coef")


@query("""WITH w AS (SELECT n_nationkey AS k, n_name AS entity, 'G' || n_regionkey AS grp FROM nation)
SELECT grp, CASE WHEN k % 4 IN (0, 1) THEN 'U' || k END AS entity, CASE WHEN k % 4 IN (0, 1) THEN 'resolved' WHEN k % 4 = 2 THEN 'unresolved' ELSE 'bad bus number' END AS status FROM w""")
def generator_membership(spark: SparkSession, sf: str) -> DataFrame:
    """S-09, J-03: generators by name, or by bus and unit id; what cannot be resolved keeps its reason."""
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    units = n.select(F.concat(F.lit("U"), k.cast("string")).alias("entity"), k.cast("int").alias("bus_id"), F.lit("1").alias("unit_id"))
    name = F.when(k % 4 == 0, F.concat(F.lit("U"), k.cast("string")))
    bus = F.when(k % 4 == 3, "n. a. bus").when(k % 4 != 0, F.when(k % 4 == 2, (k + 500).cast("string")).otherwise(F.concat(k.cast("string"), F.lit(".0"))))
    rows = n.select(k.alias("k"), name.alias("Name"), bus.alias("Bus ID"), F.lit("01").alias("Unit ID"), F.concat(F.lit("G"), F.col("n_regionkey").cast("string")).alias("Grouping"))
    got = lists.read_membership(spark, membership_file(spark, rows, ["Name", "Bus ID", "Unit ID", "Grouping"], "k"), {"name": "Name", "bus_id": "Bus ID", "unit_id": "Unit ID", "grp": "Grouping"})
    return lists.generator_members(got, units).select("grp", "entity", "status")


@query("SELECT 'G' || n_regionkey AS grp, n_nationkey::INT AS bus_id, CASE WHEN n_nationkey % 3 = 0 THEN 'unresolved' ELSE 'resolved' END AS status, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS entity FROM nation")
def bus_membership(spark: SparkSession, sf: str) -> DataFrame:
    """S-10, J-04: buses of groups by their id, resolved through the list."""
    n = table(spark, sf, "nation")
    rows = n.select("n_nationkey", F.concat(F.col("n_nationkey").cast("string"), F.lit(".0")).alias("BusID"), F.concat(F.lit("G"), F.col("n_regionkey").cast("string")).alias("Grouping"))
    got = lists.read_membership(spark, membership_file(spark, rows, ["BusID", "Grouping"], "n_nationkey"), {"bus_id": "BusID", "grp": "Grouping"})
    index = n.filter("n_nationkey % 3 <> 0").select(F.col("n_nationkey").cast("int").alias("bus_id"), F.col("n_name").alias("entity"))
    return groups.resolve_keys(got.withColumn("bus_id", groups.bus_id_of(F.col("bus_id"))), index, ["bus_id"]).select("grp", "bus_id", "status", "entity")


@query(f"""WITH {MEMBERS}, k AS (SELECT m.*, n_nationkey AS k FROM m JOIN nation ON n_name = entity WHERE m.grp = 'BOUNDARY')
SELECT entity, grp, CASE WHEN k % 7 = 0 OR k % 5 = 1 THEN NULL ELSE coef END AS coef, CASE WHEN k % 5 = 1 THEN 'unreadable direction' WHEN k % 7 = 0 THEN 'both directions' END AS refusal FROM k""")
def interface_membership(spark: SparkSession, sf: str) -> DataFrame:
    """S-11, T-14: directed members; both directions of one pair, and words that are none, are refused."""
    m = memberships(spark, sf).filter("grp = 'BOUNDARY'").join(table(spark, sf, "nation").select(F.col("n_name").alias("entity"), F.col("n_nationkey").alias("k")), "entity")
    said = F.when(F.col("k") % 5 == 1, "upwards").when(F.col("coef") < 0, "Reversed").otherwise("")
    rows = m.select("k", F.col("entity").alias("Name"), F.col("grp").alias("Grouping"), said.alias("Direction"))
    again = m.filter("k % 7 = 0").select((F.col("k") + 100).alias("k"), F.col("entity").alias("Name"), F.col("grp").alias("Grouping"), F.when(F.col("coef") < 0, "fwd").otherwise("rev").alias("Direction"))
    path = membership_file(spark, rows.unionByName(again), ["Name", "Grouping", "Direction"], "k")
    got = lists.interface_members(lists.read_membership(spark, path, {"name": "Name", "grp": "Grouping", "direction": "Direction"}))
    return got.select("entity", "grp", "coef", "refusal")


# ---------------------------------------------------------------- sinks, studies, appends


@query(f"WITH {H} SELECT case_id, entity, {stats_sql('net')} FROM h GROUP BY ALL")
def statistics_csv(spark: SparkSession, sf: str) -> DataFrame:
    """K-01: a statistics table written as CSV with its descriptor, and read back."""
    place, rows = scratch(spark, "statistics"), stats.series_stats(series_of(hourly(spark, sf), "net"), ["case_id", "entity"], ndigits=4)
    sinks.write_table(rows, place, ["case_id", "entity"], {"Cases": "A, N, R", "Variable": "Net ($)", "Hours": "all hours"})
    assert [r["value"] for r in spark.read.text(f"{place}/descriptor").collect()] == ["# Cases: A, N, R", "# Variable: Net ($)", "# Hours: all hours"]
    return spark.read.schema(rows.schema).option("header", "true").csv(f"{place}/rows")


@query(f"""WITH {MEMBERS} SELECT entity AS "Name", grp AS "Grouping", CASE WHEN coef < 0 THEN 'reversed' ELSE 'forward' END AS "Direction" FROM m""")
def membership_csv(spark: SparkSession, sf: str) -> DataFrame:
    """K-04: memberships written as CSV in order, and read back."""
    place = scratch(spark, "memberships")
    sinks.write_memberships(memberships(spark, sf).withColumn("src_order", F.hash("grp", "entity")), place)
    return spark.read.option("header", "true").csv(place)


@query(f"WITH {H} SELECT case_id, entity, year, count(*) AS cells, round(sum(load), 4) AS total FROM h GROUP BY ALL")
def saved_study(spark: SparkSession, sf: str) -> DataFrame:
    """K-05, S-15: a study saved, one case saved again, and loaded."""
    h = hourly(spark, sf).select("case_id", F.lit("area").alias("kind"), F.lit("Load (MWh)").alias("quantity"), "entity", "year", "slot_hour", F.col("load").alias("value"))
    place = scratch(spark, "study")
    sinks.save_study(place, facts=h.withColumn("value", F.when(F.col("case_id") != "A", F.col("value"))), memberships=memberships(spark, sf))
    sinks.save_study(place, facts=h.filter("case_id = 'A'"))
    facts = sinks.load_study(spark, place, "facts")
    return rounded(facts.groupBy("case_id", "entity", F.col("year").cast("int").alias("year")).agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total")))


@query(f"WITH {H} SELECT case_id, 'Load (MWh)' AS quantity, count(*) AS cells, round(sum(load), 4) AS total FROM h GROUP BY ALL UNION ALL SELECT case_id, 'Net ($)', count(*), round(sum(net) FILTER (slot_hour % 9 <> 0), 4) FROM h GROUP BY ALL")
def appended_study(spark: SparkSession, sf: str) -> DataFrame:
    """M-01, J-16: export files appended to a study; appending the same files once more changes nothing."""
    files, study = long_files(spark, sf, False), scratch(spark, "appended")
    for _ in range(2):
        append_files(spark, files, study, "*~????-??.csv")
    cells = spark.read.parquet(f"{study}/cells")
    return rounded(cells.groupBy("case_id", "quantity").agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total")))
