"""Registered queries, third part: cells, labels, rules, scopes and refusals, fed from columns of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casehours.functions import cells, fuel, rules
from casehours.operators import browse, filters, groups, merge, ranges, series, shapes, stats
from casehours.plans.facts import H, LIMITS, MEMBERS, hourly, limits, memberships, series_of, stats_sql, table
from casehours.plans.queries import G, RULES_SQL, cases, group_series, query, rounded


def pick(choices: list, k: Column) -> Column:
    """The k-th choice, in turn; choices are columns or texts."""
    each = [c if isinstance(c, Column) else F.lit(c) for c in choices]
    return F.element_at(F.array(*each), (F.pmod(k, F.lit(len(each))) + 1).cast("int"))


def pick_sql(choices: list[str], k: str) -> str:
    """The same as SQL; choices are SQL expressions."""
    return f"([{', '.join(choices)}])[({k}) % {len(choices)} + 1]"


def quoted(texts) -> list[str]:
    return ["'" + t.replace("'", "''") + "'" for t in texts]


# ---------------------------------------------------------------- cells


@query("""SELECT p_partkey, CASE WHEN p_partkey % 8 IN (0, 1, 7) THEN trim(p_name) END AS cell FROM part""")
def blank_cells(spark: SparkSession, sf: str) -> DataFrame:
    """T-01: wrapped, quoted and blank cells of a list."""
    n = F.col("p_name")
    raw = pick([F.concat(F.lit(" #"), n, F.lit("# ")), F.concat(F.lit("'"), n), " NA ", "n/a", "  ", "#N/A", "Null", F.concat(F.lit("  "), n, F.lit(" "))], F.col("p_partkey"))
    return table(spark, sf, "part").select("p_partkey", cells.normalized(raw).alias("cell"))


@query("SELECT o_orderkey % 7 AS k, CASE WHEN o_orderkey % 7 < 3 THEN true WHEN o_orderkey % 7 < 6 THEN false END AS value, count(*) AS orders FROM orders GROUP BY ALL")
def boolean_cells(spark: SparkSession, sf: str) -> DataFrame:
    """T-03: yes, no and unknown."""
    raw = pick(["TRUE", "yes", "1", "False", "NO", "0", "maybe"], F.col("o_orderkey"))
    return table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 7).alias("k"), cells.boolean(raw).alias("value")).agg(F.count(F.lit(1)).alias("orders"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def iso_dates(spark: SparkSession, sf: str) -> DataFrame:
    """T-04: dates at the beginning of a cell; days that do not exist are null."""
    d = F.col("o_orderdate")
    raw = pick([F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy/M/d"), F.date_format(d, "yyyy-MM-dd'T'HH:mm"), "2023-02-30", "n. d."], F.col("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(cells.iso_date(raw), "yyyy-MM-dd").alias("day"))


@query("""WITH c AS (SELECT l_linenumber % 6 AS k, l_quantity AS q FROM lineitem) SELECT k, count(*) AS cells, count(*) FILTER (k = 3 OR k = 5) AS bad, round(sum(CASE k WHEN 0 THEN q WHEN 1 THEN -.5 WHEN 2 THEN 150 WHEN 4 THEN NULL END), 4) AS total FROM c GROUP BY 1""")
def value_cells(spark: SparkSession, sf: str) -> DataFrame:
    """T-05: values of exports; padding, exponents, blanks and what cannot be read."""
    raw = pick([F.concat(F.lit("  "), F.col("l_quantity").cast("string"), F.lit(" ")), "-.5", "1.5e2", "12x", " ", "1,2"], F.col("l_linenumber"))
    out = table(spark, sf, "lineitem").groupBy((F.col("l_linenumber") % 6).cast("long").alias("k"))
    return rounded(out.agg(F.count(F.lit(1)).alias("cells"), F.count_if(cells.value_is_bad(raw)).alias("bad"), F.sum(cells.value_cell(raw)).alias("total")))


HOUR_CELLS = (("1", 1), ("24.0", 24), ("7:00", None), ("13.5", None), ("25", None), ("0", None), (" 5 ", 5), ("9.", 9), ("", None))


@query(f"SELECT o_orderkey % 9 AS k, {pick_sql([str(h or 'NULL') for _, h in HOUR_CELLS], 'o_orderkey')} AS he, count(*) AS n FROM orders GROUP BY ALL")
def hour_cells(spark: SparkSession, sf: str) -> DataFrame:
    """T-06: hour-ending cells."""
    he = cells.hour_ending(pick([c for c, _ in HOUR_CELLS], F.col("o_orderkey")))
    return table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 9).alias("k"), he.alias("he")).agg(F.count(F.lit(1)).alias("n"))


TOU_CELLS = (("OnPeak", "OnPeak"), ("off-peak", "OffPeak"), (" ON PEAK ", "OnPeak"), ("Off_Peak", "OffPeak"), ("peak", None), ("", None))


@query(f"SELECT o_orderkey % 6 AS k, {pick_sql([repr(t) if t else 'NULL' for _, t in TOU_CELLS], 'o_orderkey')} AS tou, count(*) AS n FROM orders GROUP BY ALL")
def tou_cells(spark: SparkSession, sf: str) -> DataFrame:
    """T-07: time of use in any case and punctuation."""
    tou = cells.time_of_use(pick([c for c, _ in TOU_CELLS], F.col("o_orderkey")))
    return table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 6).alias("k"), tou.alias("tou")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 6 < 4 THEN strftime(l_shipdate, '%Y-%m-%d') END AS day FROM lineitem")
def export_dates(spark: SparkSession, sf: str) -> DataFrame:
    """T-08: M/D/YYYY with a midnight time; other times and days that do not exist are refused."""
    d = F.date_format("l_shipdate", "M/d/yyyy")
    raw = pick([d, F.concat(d, F.lit(" 0:00")), F.concat(F.lit(" "), d, F.lit(" 12:00:00 AM")), F.concat(d, F.lit(" 00:00:00")), F.concat(d, F.lit(" 1:00")), "2/29/2023"], F.col("l_linenumber"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.date_format(cells.export_date(raw), "yyyy-MM-dd").alias("day"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN '0' WHEN 2 THEN 'A' || p_size ELSE p_size::VARCHAR END AS unit_id, CASE WHEN p_partkey % 3 < 2 THEN p_size::INT END AS bus_id FROM part""")
def unit_ids(spark: SparkSession, sf: str) -> DataFrame:
    """T-10: unit ids without leading zeros, in capitals; bus ids perhaps written 101.0."""
    s = F.col("p_size").cast("string")
    unit = pick([F.concat(F.lit(" 00"), s), F.concat(s, F.lit(" ")), F.concat(F.lit("0a"), s), "0"], F.col("p_partkey"))
    bus = pick([F.concat(F.lit(" "), s), F.concat(s, F.lit(".0")), F.concat(s, F.lit(".5"))], F.col("p_partkey"))
    return table(spark, sf, "part").select("p_partkey", groups.unit_id_norm(unit).alias("unit_id"), groups.bus_id_of(bus).alias("bus_id"))


DIRECTIONS = (("", 1), ("Forward", 1), (" +1 ", 1), ("FWD", 1), ("reversed", -1), ("-", -1), ("Rev", -1), ("sideways", None))


@query(f"SELECT s_suppkey, {pick_sql([str(c) if c else 'NULL' for _, c in DIRECTIONS], 's_suppkey')}::INT AS coef FROM supplier")
def direction_cells(spark: SparkSession, sf: str) -> DataFrame:
    """T-14: directions as signs; other words are refused."""
    return table(spark, sf, "supplier").select("s_suppkey", cells.direction(pick([c for c, _ in DIRECTIONS], F.col("s_suppkey"))).alias("coef"))


# ---------------------------------------------------------------- labels


@query(r"""WITH n AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'P' || s_suppkey || ' North' WHEN 1 THEN ' W0' || s_suppkey || '_AB_CD' WHEN 2 THEN 'Pth 03 East' WHEN 3 THEN 'A-B ' || s_suppkey ELSE s_name END AS name FROM supplier)
SELECT s_suppkey, CASE WHEN regexp_matches(trim(name), '^([A-Za-z]+ ?\d*)[\s_]') THEN regexp_extract(trim(name), '^([A-Za-z]+ ?\d*)[\s_]', 1) ELSE substr(trim(name), 1, 4) END AS prefix FROM n""")
def name_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """T-16: leading tokens of interface names."""
    k = F.col("s_suppkey").cast("string")
    name = pick([F.concat(F.lit("P"), k, F.lit(" North")), F.concat(F.lit(" W0"), k, F.lit("_AB_CD")), "Pth 03 East", F.concat(F.lit("A-B "), k), F.col("s_name")], F.col("s_suppkey"))
    return table(spark, sf, "supplier").select("s_suppkey", browse.prefix_of(name).alias("prefix"))


def displayed_sql(x: str, kind: str) -> str:
    whole = f"floor({x}{' * 100' if kind == 'ratio' else ''} + 0.5)::BIGINT"
    if kind == "count":
        return f"{whole}::VARCHAR"
    sign = "%" if kind == "ratio" else ""
    text = f"{whole} || '%'" if kind == "ratio" else f"format('{{:,}}', {whole})"
    return f"CASE WHEN {x} <> 0 AND {whole} = 0 THEN CASE WHEN {x} > 0 THEN '<1{sign}' ELSE '>-1{sign}' END ELSE {text} END"


@query(f"""WITH v AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN s_acctbal / 9000 WHEN 2 THEN s_acctbal * 1000 ELSE s_acctbal END AS x FROM supplier)
SELECT s_suppkey, {displayed_sql('x', 'quantity')} AS quantity, {displayed_sql('x', 'ratio')} AS ratio, {displayed_sql('x', 'count')} AS count FROM v""")
def displayed_cells(spark: SparkSession, sf: str) -> DataFrame:
    """T-17: displayed quantities, ratios and counts of large, small, negative and zero values."""
    b = F.col("s_acctbal")
    v = table(spark, sf, "supplier").select("s_suppkey", pick([F.lit(0.0), b / 9000, b * 1000, b], F.col("s_suppkey")).alias("x"))
    return v.select("s_suppkey", *[browse.displayed(F.col("x"), c).alias(c) for c in ("quantity", "ratio", "count")])


@query(f"""WITH v AS (SELECT s_suppkey, {displayed_sql('s_acctbal', 'quantity')} AS shown FROM supplier) SELECT s_suppkey, shown FROM v WHERE contains(shown, '1,') OR shown IN ('5,000', '-12', '')""")
def displayed_filter(spark: SparkSession, sf: str) -> DataFrame:
    """F-04, F-05: filters on numbers match what is shown, separators included."""
    s, b = table(spark, sf, "supplier"), F.col("s_acctbal")
    typed = filters.text_filter(b, "1\n", "quantity") & browse.displayed(b).contains("1,")
    return s.filter(typed | filters.values_filter(b, ["5,000", "-12", ""], "quantity")).select("s_suppkey", browse.displayed(b).alias("shown"))


@query("SELECT p_partkey, regexp_replace(p_retailprice::FLOAT::VARCHAR, '\\.0$', '') AS cell FROM part")
def cell_texts(spark: SparkSession, sf: str) -> DataFrame:
    """T-18: the shortest text of a single-precision number."""
    return table(spark, sf, "part").select("p_partkey", browse.cell_text(F.col("p_retailprice")).alias("cell"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'bus ' || s_suppkey ELSE s_name || ' (' || s_suppkey || ')' END AS label FROM supplier")
def bus_labels(spark: SparkSession, sf: str) -> DataFrame:
    """T-19: names with ids; an id alone where the name is blank."""
    name = F.when(F.col("s_suppkey") % 6 == 0, " ").when(F.col("s_suppkey") % 3 != 0, F.col("s_name"))
    return table(spark, sf, "supplier").select("s_suppkey", browse.bus_label(name, F.col("s_suppkey")).alias("label"))


SCALED = ("MWh", "MW", "$", "%", "MWh")


@query(f"WITH u AS (SELECT DISTINCT {pick_sql(quoted(SCALED), 'p_partkey')} AS unit FROM part) SELECT CASE unit WHEN 'MW' THEN 'MWh' ELSE unit END AS scale, string_agg(unit, ' / ' ORDER BY unit) AS label FROM u GROUP BY 1")
def scale_labels(spark: SparkSession, sf: str) -> DataFrame:
    """T-20: units of one scale share a label."""
    return browse.scale_labels(table(spark, sf, "part").select(pick(list(SCALED), F.col("p_partkey")).alias("unit")))


@query(f"WITH {H} SELECT slot_day::INT AS slot_day, strftime(DATE '2000-01-01' + slot_day::INT, '%b %-d') AS label, count(*) AS cells FROM h GROUP BY ALL")
def day_labels(spark: SparkSession, sf: str) -> DataFrame:
    """T-21: slot days as text."""
    day = F.floor(F.col("slot_hour") / 24).cast("int")
    return hourly(spark, sf).groupBy(day.alias("slot_day")).agg(F.count(F.lit(1)).alias("cells")).withColumn("label", browse.day_label(F.col("slot_day")))


@query(f"WITH {H} SELECT 'years 1996, 1997; days 0-58; HE 7, 8; OnPeak' AS hours, case_id, count(*) AS n FROM h WHERE year IN (1996, 1997) AND slot_day <= 58 AND he IN (7, 8) AND tou = 'OnPeak' GROUP BY ALL UNION ALL SELECT 'all hours', case_id, count(*) FROM h GROUP BY ALL")
def filter_labels(spark: SparkSession, sf: str) -> DataFrame:
    """T-23: the hour filter of a table as text, beside what it keeps."""
    f = {"years": (1996, 1997), "date_runs": ((0, 58),), "hours_ending": (7, 8), "tou": "OnPeak"}
    h = hourly(spark, sf)
    some = h.filter(filters.HourFilter(**f).predicate()).groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).withColumn("hours", F.lit(browse.filter_label(**f)))
    return some.unionByName(h.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).withColumn("hours", F.lit(browse.filter_label())))


@query(f"WITH {H} SELECT entity, season::INT AS season, (month - 1)::INT AS month, (he - 1)::INT AS he, count(*) AS n FROM h GROUP BY ALL")
def point_colours(spark: SparkSession, sf: str) -> DataFrame:
    """T-24: the category that colours a point: season, month, hour."""
    own = [shapes.calendar_category(by).cast("int").alias(by) for by in ("season", "month", "he")]
    return hourly(spark, sf).groupBy("entity", *own).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH c AS (SELECT p_brand, CASE p_partkey % 3 WHEN 0 THEN 'Solar' WHEN 1 THEN 'Natural Gas' ELSE 'Pumped Storage' END AS f, CASE p_partkey % 3 WHEN 0 THEN 'Solar' WHEN 1 THEN 'Thermal' ELSE 'Storage' END AS g FROM part)
SELECT 'Fuel Type (Cleaned)' AS attribute, f AS value, count(*) AS units FROM c GROUP BY ALL UNION ALL SELECT 'Fuel Group', g, count(*) FROM c GROUP BY ALL""")
def derived_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """T-13: attributes that a list does not have but its columns give."""
    u = table(spark, sf, "part").select(F.col("p_name").alias("entity"), pick(["PV", "gas turbine", "psh"], F.col("p_partkey")).alias("fuel_type"), F.lit("").alias("technology"), F.lit(None).cast("string").alias("sub_type"))
    clean = fuel.with_clean_fuel(u)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("attribute"), of().alias("value")) for name, of in fuel.DERIVED.items()]))
    return clean.select(each.alias("x")).groupBy("x.attribute", "x.value").agg(F.count(F.lit(1)).alias("units"))


# ---------------------------------------------------------------- rules, scopes, refusals

#: Metrics, the group and the rank of each.
METRICS = (
    ("Load (MWh)", "Load", 0), ("Unserved Load (MWh)", "Load", 100), ("Generation (MWh)", "Generation", 0), ("Spillage (MWh)", "Generation", 100), ("LMP - Energy ($/MWh)", "Prices", 100), ("RD A. S. Price", "Ancillary services", 100),
    ("Import Flow(MWh)", "Interchange & losses", 0), ("Load Payment (k$)", "Costs & revenue", 100), ("CO2 Cost", "Emissions", 100), ("Gen - Load", "Calculations", 100), ("Wheel price of nobody", "Prices", 500), ("Entirely new", "Other", 500),
)
TITLES = [g[0] for g in series.METRIC_GROUPS] + ["Other"]


@query(f"""WITH m(metric, title, rank) AS (VALUES {', '.join(f"('{m}', '{t}', {r})" for m, t, r in METRICS)}), p AS (SELECT {pick_sql(quoted(m for m, *_ in METRICS), 'p_partkey')} AS metric, count(*) AS parts FROM part GROUP BY 1)
SELECT metric, parts, title, (list_position({TITLES!r}, title) - 1)::INT AS group_rank, rank::INT AS rank FROM p JOIN m USING (metric)""")
def metric_groups(spark: SparkSession, sf: str) -> DataFrame:
    """O-03: metrics by display group, headline ones first, those without a rule last."""
    m = table(spark, sf, "part").groupBy(pick([m for m, *_ in METRICS], F.col("p_partkey")).alias("metric")).agg(F.count(F.lit(1)).alias("parts"))
    return series.metric_groups(m)


@query("SELECT p_brand, count(*) AS series, CASE WHEN count(*) > 10 THEN count(*) || ' series; at most 10 are drawn' END AS refusal FROM part GROUP BY 1")
def series_caps(spark: SparkSession, sf: str) -> DataFrame:
    """O-04: how many series may be drawn (brands as views, parts as series); more are refused."""
    s = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("series"))
    return s.withColumn("refusal", browse.cap_refusal(F.col("series"), "series", "drawn", browse.MOST_SERIES))


AREA_METRICS = ("Load (MWh)", "LMP - Energy ($/MWh)", "RU A. S. Price", "Import Flow(MWh)", "Net Load (MW)", "Simple Average LMP($/MWh)", "nobody's metric")
AREA_ANSWERS = "('Load (MWh)', 'SUM', 'SUM', NULL, NULL, false), ('LMP - Energy ($/MWh)', 'WEIGHTED_MEAN', 'WEIGHTED_MEAN', 'Load (MWh)', NULL, false), ('RU A. S. Price', 'WEIGHTED_MEAN', 'WEIGHTED_MEAN', 'RU A. S. Served Amount', 'RU A. S. Requirement', false), ('Import Flow(MWh)', 'SUM', 'SUM', NULL, NULL, true), ('Net Load (MW)', 'SUM', 'MEAN', NULL, NULL, false), ('Simple Average LMP($/MWh)', 'MEAN', 'MEAN', NULL, NULL, false)"
AREA_PICK = f"p AS (SELECT {pick_sql(quoted(AREA_METRICS), 'p_partkey')} AS metric, count(*) AS parts FROM part GROUP BY 1)"


def _area_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(pick(list(AREA_METRICS), F.col("p_partkey")).alias("metric")).agg(F.count(F.lit(1)).alias("parts"))


@query(f"WITH r(metric, series, temporal, weight, fallback_weight, hazard) AS (VALUES {AREA_ANSWERS}), {AREA_PICK} SELECT * FROM p LEFT JOIN r USING (metric)")
def area_rules(spark: SparkSession, sf: str) -> DataFrame:
    """S-12: the rule of each area metric, as data."""
    return _area_metrics(spark, sf).join(rules.area_rules(spark), "metric", "left")


@query(f"""WITH r(metric, series, temporal, weight, fallback_weight, hazard) AS (VALUES {AREA_ANSWERS}), {AREA_PICK}, c AS (SELECT metric, weight, fallback_weight FROM p JOIN r USING (metric) WHERE weight IS NOT NULL)
SELECT metric, CASE metric WHEN 'RU A. S. Price' THEN 'RU A. S. Requirement' END AS weight_used, CASE metric WHEN 'RU A. S. Price' THEN 'weighted by the fallback: RU A. S. Requirement' ELSE 'no weight is carried, every area counts equally: Load (MWh)' END AS caveat FROM c""")
def weight_caveats(spark: SparkSession, sf: str) -> DataFrame:
    """Q-13: weighted means whose weight, or fallback, the case did not retain."""
    return merge.missing_weights(_area_metrics(spark, sf), rules.area_rules(spark), ["RU A. S. Requirement", "Generation (MWh)"])


@query("""WITH p AS (SELECT DISTINCT p_partkey % 3 AS k FROM part), n(k, metric, input, missing) AS (VALUES (0, 'Gen - Load', 'Generation (MWh)', true), (0, 'Gen - Load', 'Load (MWh)', false), (1, 'LMP - Energy ($/MWh)', 'Load (MWh)', false)) SELECT metric, input, missing FROM n JOIN p USING (k)""")
def required_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """F-15: weights and operands that the retained metrics need, and which of them are missing."""
    retained = table(spark, sf, "part").select(pick(["Gen - Load", "LMP - Energy ($/MWh)", "Load (MWh)"], F.col("p_partkey")).alias("m")).distinct()
    return rules.required_inputs(spark, [r["m"] for r in retained.collect()])


@query(f"WITH {H} SELECT case_id, entity, {stats_sql('load')} FROM h WHERE year IN (1996, 1998) GROUP BY ALL")
def years_reconciled(spark: SparkSession, sf: str) -> DataFrame:
    """F-03: of the years asked for, those that are loaded; all or none of them is no filter."""
    h = hourly(spark, sf)
    loaded = [r["year"] for r in h.select("year").distinct().collect()]
    f = filters.HourFilter(years=(1890, 1996, 1998, 2150)).with_loaded_years(loaded)
    assert filters.HourFilter(years=(1890,)).with_loaded_years(loaded).years is None
    return stats.series_stats(series_of(h.filter(f.predicate()), "load"), ["case_id", "entity"], ndigits=4)


@query(f"WITH {H}, {G} SELECT case_id, grp, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS p75 FROM g GROUP BY ALL")
def quartiles_only(spark: SparkSession, sf: str) -> DataFrame:
    """A-11: quartiles without the rest of a box."""
    return rounded(stats.quartiles(group_series(spark, sf), ["case_id", "grp"]))


QUANTITIES = ("Load (MWh)", "Price ($/MWh)", "Rating (MVA)")


@query(f"""WITH {H}, q AS (SELECT DISTINCT case_id, {pick_sql(quoted(QUANTITIES), 'length(entity) + year')} AS quantity FROM h WHERE case_id IN ('A', 'N'))
SELECT quantity, count(DISTINCT case_id) AS cases, quantity = 'Load (MWh)' AS offered, CASE quantity WHEN 'Price ($/MWh)' THEN 'an intensive quantity does not add up over entities' WHEN 'Rating (MVA)' THEN 'no rule for the unit' END AS reason FROM q GROUP BY 1""")
def quantity_scope(spark: SparkSession, sf: str) -> DataFrame:
    """F-10: quantities of two cases, which are offered for grouping, and why others are withheld."""
    f = hourly(spark, sf).select("case_id", F.lit("bus").alias("kind"), pick(list(QUANTITIES), F.length("entity") + F.col("year")).alias("quantity"))
    can = groups.combinable(f.select("kind", "quantity").distinct(), rules.unit_rules(spark))
    return series.quantity_scope(f, ["A", "N"], "bus", can)


@query(f"""WITH {RULES_SQL}, s AS (SELECT p_partkey AS series_id, 'c' || p_partkey % 2 AS case_id, 'bus' AS kind, {pick_sql(quoted(QUANTITIES), 'p_partkey')} AS quantity, p_partkey % 5 <> 0 AS grouped, p_partkey % 7 = 0 AS needs_list, p_partkey % 14 = 0 AS has_list FROM part),
w AS (SELECT *, CASE WHEN case_id = 'c1' AND quantity = 'Load (MWh)' THEN 'exported but not retained' WHEN case_id = 'c1' AND quantity = 'Rating (MVA)' THEN 'the case does not carry the quantity' WHEN needs_list AND NOT has_list THEN 'the grouping needs a list that is not loaded'
  WHEN grouped AND quantity = 'Rating (MVA)' THEN 'no rule for the unit' WHEN grouped AND quantity = 'Price ($/MWh)' THEN 'an intensive quantity does not add up over entities' END AS reason FROM s)
SELECT *, CASE WHEN reason IS NULL THEN 'resolved' ELSE 'refused' END AS status FROM w""")
def series_refusals(spark: SparkSession, sf: str) -> DataFrame:
    """Q-20: series that resolve, and why others do not (parts as series)."""
    k = F.col("p_partkey")
    s = table(spark, sf, "part").select(k.alias("series_id"), F.concat(F.lit("c"), (k % 2).cast("string")).alias("case_id"), F.lit("bus").alias("kind"), pick(list(QUANTITIES), k).alias("quantity"), (k % 5 != 0).alias("grouped"), (k % 7 == 0).alias("needs_list"), (k % 14 == 0).alias("has_list"))
    every = s.select("case_id", "kind", "quantity").distinct()
    carried = every.filter("case_id = 'c0' or quantity = 'Price ($/MWh)'")
    can = groups.combinable(every.select("kind", "quantity").distinct(), rules.unit_rules(spark)).withColumn("can_group", F.when(F.col("class").isNotNull(), F.col("can_group")))
    return merge.resolutions(s, carried, can, every.filter("quantity <> 'Rating (MVA)'"))


@query(f"WITH {MEMBERS}, u AS (SELECT entity, grp, coef, CASE WHEN grp = 'BOUNDARY' AND length(entity) % 2 = 0 THEN 'MW' ELSE '$' END AS unit FROM m) SELECT * FROM u WHERE coef < 0 AND unit = '$'")
def reversed_members(spark: SparkSession, sf: str) -> DataFrame:
    """Q-15: reversed members of series whose unit has no direction."""
    m = memberships(spark, sf).withColumn("unit", F.when((F.col("grp") == "BOUNDARY") & (F.length("entity") % 2 == 0), "MW").otherwise("$"))
    return series.directional_refusals(m, ["MW", "MWh"])


@query(f"WITH {H} SELECT DISTINCT f.case_id, 'area' AS kind, 'Load (MWh)' AS quantity, f.entity FROM h f WHERE NOT EXISTS (FROM h x WHERE x.case_id = f.case_id AND x.entity = f.entity AND x.entity NOT LIKE '%3' AND x.year < 1997)")
def append_outside(spark: SparkSession, sf: str) -> DataFrame:
    """Q-18: entities of an append that the loaded axis lacks."""
    h = hourly(spark, sf).withColumn("kind", F.lit("area")).withColumn("quantity", F.lit("Load (MWh)"))
    return series.append_outside(h.filter("entity not like '%3' and year < 1997"), h)


@query(f"SELECT 'generator' AS kind, {pick_sql(quoted([*rules.POLYSEMOUS, 'Generation (MWh)']), 'p_partkey // 2')} AS quantity, count(*) AS parts FROM part WHERE p_partkey % 2 = 0 AND (p_partkey // 2) % 4 < 3 GROUP BY ALL")
def polysemous_quantities(spark: SparkSession, sf: str) -> DataFrame:
    """Q-19: generator quantities whose meaning depends on the technology."""
    k = F.col("p_partkey")
    q = table(spark, sf, "part").select(F.when(k % 2 == 0, "generator").otherwise("bus").alias("kind"), pick([*rules.POLYSEMOUS, "Generation (MWh)"], F.floor(k / 2)).alias("quantity"))
    return series.polysemous(q.groupBy("kind", "quantity").agg(F.count(F.lit(1)).alias("parts")))


@query("""WITH f AS (SELECT DISTINCT p_brand AS case_id, CASE WHEN p_size > 40 THEN 'Cost ($)' ELSE 'Flow (MW)' END AS quantity FROM part) SELECT case_id, 'interface' AS kind, list_sort(list(quantity)) AS quantities FROM f GROUP BY 1 HAVING count(*) > 1""")
def mixed_quantities(spark: SparkSession, sf: str) -> DataFrame:
    """Q-07: merge groups (brands) whose wide files (parts) have different quantities."""
    f = table(spark, sf, "part").select(F.col("p_brand").alias("case_id"), F.lit("interface").alias("kind"), F.when(F.col("p_size") > 40, "Cost ($)").otherwise("Flow (MW)").alias("quantity"))
    return merge.mixed_quantities(f)


@query(f"""WITH {H}, {LIMITS}, f AS (SELECT DISTINCT case_id, entity AS interface FROM h) SELECT f.case_id, count(*) FILTER (EXISTS (FROM cl WHERE cl.case_id = f.case_id AND cl.interface = f.interface)) AS matched, count(*) AS total FROM f GROUP BY 1""")
def limit_match_report(spark: SparkSession, sf: str) -> DataFrame:
    """Q-17: of each case's interfaces, those that its limits name."""
    flows = hourly(spark, sf).select("case_id", F.col("entity").alias("interface"))
    return ranges.limit_match_report(ranges.limits_for_cases(limits(spark, sf), cases(spark, sf)), flows)


@query(f"WITH {H} SELECT DISTINCT entity AS interface FROM h WHERE entity NOT IN (SELECT n_name FROM nation WHERE n_nationkey < 10)")
def paths_without_limits(spark: SparkSession, sf: str) -> DataFrame:
    """J-17: flow paths that no limit names."""
    named = limits(spark, sf).filter("scope_case = 'R'").select("interface")
    return ranges.paths_without_limits(named, hourly(spark, sf).select(F.col("entity").alias("interface")))


@query(f"""WITH {H}, y AS (SELECT case_id, entity, CASE WHEN entity LIKE '%7' THEN NULL ELSE year END AS year FROM h), s AS (SELECT case_id, entity, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS n FROM y GROUP BY ALL)
SELECT case_id, entity, first_year, last_year, CASE WHEN first_year IS NULL THEN 'no readable date' WHEN n < last_year - first_year + 1 THEN 'years are missing' END AS refusal FROM s""")
def unreadable_years(spark: SparkSession, sf: str) -> DataFrame:
    """Q-05: tables without a year that can be read are refused by that name."""
    h = hourly(spark, sf).withColumn("year", F.when(~F.col("entity").like("%7"), F.col("year")))
    return merge.year_gaps(h, ["case_id", "entity"]).drop("missing_years")


@query(f"WITH {H}, f AS (SELECT DISTINCT case_id, year FROM h), n AS (SELECT case_id, year, case_id || ' ' || (1990 + year % 3) AS name FROM f) SELECT case_id, year, name || CASE WHEN row_number() OVER (PARTITION BY name ORDER BY year) > 1 THEN ' (' || row_number() OVER (PARTITION BY name ORDER BY year) || ')' ELSE '' END AS name FROM n")
def series_names(spark: SparkSession, sf: str) -> DataFrame:
    """K-07, U-03: names from the facets that tell series apart, made unique by position."""
    e = hourly(spark, sf).select("case_id", "year").distinct().withColumn("unit", F.lit("MWh")).withColumn("cycle", (1990 + F.col("year") % 3))
    return browse.series_names(e, ["case_id", "unit", "cycle"], "year").select("case_id", "year", "name")


@query(f"WITH {H}, w AS (SELECT slot_hour, sum(net) FILTER (case_id = 'A') AS a, sum(net) FILTER (case_id = 'R') AS r FROM h GROUP BY 1) SELECT slot_hour, round(a, 4) AS a, round(r, 4) AS r FROM w WHERE slot_hour BETWEEN 1000 AND 5000 AND (a IS NOT NULL OR r IS NOT NULL)")
def window_extract(spark: SparkSession, sf: str) -> DataFrame:
    """K-06: the hours of a window, without those that are blank in every column."""
    from casehours import sinks

    wide = hourly(spark, sf).groupBy("slot_hour").agg(F.sum(F.when(F.col("case_id") == "A", F.col("net"))).alias("a"), F.sum(F.when(F.col("case_id") == "R", F.col("net"))).alias("r"))
    return rounded(sinks.window_extract(wide, 1000, 5000, ["a", "r"]))
