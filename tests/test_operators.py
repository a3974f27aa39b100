"""Single operators on tiny frames with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from casehours import sinks
from casehours.functions import calendar as cal
from casehours.functions import rules
from casehours.functions.fuel import with_clean_fuel
from casehours.operators import browse, combine, filters, groups, merge, ranges, series, shapes, stats

S = "case_id string, entity string, year int, slot_hour int, value double"


def values(spark, rows, schema=S):
    return spark.createDataFrame(rows, schema)


def test_slot_days(spark):
    got = spark.sql("select explode(array('2023-02-28','2023-03-01','2024-02-29','2024-03-01','2023-12-31')) d").select(cal.slot_day(F.to_date("d"))).collect()
    assert [r[0] for r in got] == [58, 60, 59, 60, 365]


def test_calendar_phantoms(spark):
    c = cal.calendar(spark, 2023, 2)
    assert c.count() == 2 * 8784 and c.filter("phantom").count() == 24 and c.filter("phantom and dow is null and year = 2023").count() == 24
    assert c.filter("year = 2024 and month = 1 and day = 1 and dow = 0").count() == 24
    assert {r["season"] for r in c.filter("month in (12, 1, 2)").select("season").distinct().collect()} == {0}
    with pytest.raises(ValueError):
        cal.calendar(spark, 2000, 257)


def test_runs_and_years():
    assert filters.normalized_runs([(10, 20), (21, 25), (5, 8), (400, 300), (-5, 2)]) == [(0, 2), (5, 8), (10, 25), (300, 365)]
    f = filters.HourFilter(years=(2030, 2031))
    assert f.with_loaded_years([2030, 2031]).years is None and f.with_loaded_years([2031, 2032]).years == (2031,) and f.with_loaded_years([2040]).years is None


def test_statistics(spark):
    r = stats.series_stats(values(spark, [("c", "a", 2023, k, v) for k, v in enumerate([1.0, -3.0, 0.0, None, 5.0])]), ["case_id"]).first()
    assert (r["n"], r["mean"], r["min"], r["max"], r["total"], r["n_pos"], r["mean_pos"], r["n_neg"], r["mean_neg"], r["n_zero"]) == (4, 0.75, -3, 5, 3, 2, 3, 1, -3, 1)
    assert stats.series_stats(values(spark, [("c", "a", 2023, 0, 1.0)]), ["case_id"]).first()["sd"] is None
    scope = spark.createDataFrame([("c", "a"), ("c", "gone")], "case_id string, entity string")
    got = {r["entity"]: r for r in stats.ranked_stats(scope, values(spark, [("c", "a", 2023, 0, 1.0)]), ["case_id", "entity"]).collect()}
    assert got["gone"]["n"] == 0 and got["gone"]["mean"] is None


def test_boxes(spark):
    b = stats.box_stats(values(spark, [("c", "a", 2023, k, float(v)) for k, v in enumerate([1, 2, 3, 4, 100])]), ["case_id"]).first()
    assert (b["p25"], b["median"], b["p75"], b["whisker_low"], b["whisker_high"], b["outliers"], b["degenerate"]) == (2, 3, 4, 1, 4, 1, False)


def weights(spark, rows):
    return spark.createDataFrame(rows, "case_id string, entity string, year int, slot_hour int, value double, w double, f double")


def test_weighted_means(spark):
    rows = [("c", "a", 2023, 0, 10.0, 1.0, 1.0), ("c", "b", 2023, 0, 20.0, 3.0, 1.0), ("c", "a", 2023, 1, 10.0, 0.0, 1.0), ("c", "b", 2023, 1, 20.0, 0.0, 1.0), ("c", "a", 2023, 2, None, 5.0, 1.0), ("c", "b", 2023, 2, 7.0, None, 1.0)]
    got = {r["slot_hour"]: r for r in combine.weighted_series(weights(spark, rows), ["case_id"], "value", "w", "f").collect()}
    assert [got[k]["value"] for k in range(3)] == [17.5, 15.0, 7.0] and got[0]["weight_used"] == "w"
    zero = [(*r[:5], 0.0, 2.0 if r[1] == "a" else 6.0) for r in rows[:4]]
    got = {r["slot_hour"]: r for r in combine.weighted_series(weights(spark, zero), ["case_id"], "value", "w", "f").collect()}
    assert got[0]["value"] == 17.5 and got[0]["weight_used"] == "f"
    alone = combine.weighted_series(weights(spark, [r for r in rows if r[1] == "a"]), ["case_id"], "value", "w", "f").collect()
    assert {r["slot_hour"]: r["value"] for r in alone} == {0: 10.0, 1: 10.0, 2: None} and alone[0]["weight_used"] is None
    plain = combine.weighted_series(weights(spark, rows), ["case_id"], "value", None).filter("slot_hour = 0").first()
    assert plain["value"] == 15.0 and plain["weight"] is None


def test_sums(spark):
    m = spark.createDataFrame([("a", "G", 1), ("b", "G", -1)], "entity string, grp string, coef int")
    f = values(spark, [("c", "a", 2023, 0, 5.0), ("c", "b", 2023, 0, 2.0), ("c", "a", 2023, 1, None)])
    got = {r["slot_hour"]: r["value"] for r in combine.sum_series(combine.expand_groups(f, m), ["grp"], coef="coef").collect()}
    assert got == {0: 3.0, 1: None}
    assert combine.with_all_areas(m.select("entity", "grp"), f).filter("grp = 'All areas'").count() == 2


def test_derived(spark):
    rows = [("c", 0, "A", 6.0), ("c", 0, "B", 3.0), ("c", 1, "A", 6.0), ("c", 2, "A", 6.0), ("c", 2, "B", 0.0), ("c", 3, "A", None), ("c", 3, "B", 1.0)]
    f = spark.createDataFrame(rows, "case_id string, slot_hour int, quantity string, value double")
    got = {r["slot_hour"]: r["value"] for r in combine.derived_metric(f, ["case_id", "slot_hour"], "A/B", "A", "B", "div").collect()}
    assert got == {0: 2.0, 2: None, 3: None}


def test_boundary_limits(spark):
    lim = spark.createDataFrame([("a", 1, 10.0, -4.0), ("b", 1, 7.0, None)], "entity string, month int, upper double, lower double")
    m = spark.createDataFrame([("G", "a", 1), ("G", "b", -1)], "grp string, entity string, coef int")
    r = combine.boundary_limits(lim, m, ["grp"]).first()
    assert r["upper"] is None and r["lower"] == -11.0


def test_percent_of_range(spark):
    def ratios(rows, schema=S + ", upper double, lower double"):
        return [r["ratio"] for r in ranges.percent_of_range(spark.createDataFrame(rows, schema), ["case_id"]).orderBy("slot_hour").collect()]

    assert ratios([("c", "a", 2023, 0, 5.0, 10.0, None), ("c", "a", 2023, 1, -4.0, 10.0, -8.0), ("c", "a", 2023, 2, None, 10.0, None)]) == [0.5, -0.5, None]
    assert ratios([("c", "a", 2023, 0, 5.0, None, None), ("c", "a", 2023, 1, -4.0, None, None), ("c", "a", 2023, 2, -2.0, None, 1.0)]) == [1.0, -1.0, -0.4]
    assert ratios([("c", "a", 2023, 0, -3.0, -1.0, None), ("c", "a", 2023, 1, 0.0, -1.0, None)]) == [-1.0, 0.0]


def test_limit_fallback_is_per_table(spark):
    lim = spark.createDataFrame([(None, "P", "MAX", 1, 5.0), (None, "Q", "MAX", 1, 6.0), ("x", "P", "MAX", 1, 7.0)], "scope_case string, interface string, side string, month int, value double")
    cases = spark.createDataFrame([("x",), ("y",)], "case_id string")
    got = {(r["case_id"], r["interface"]): r["value"] for r in ranges.limits_for_cases(lim, cases).collect()}
    assert got == {("x", "P"): 7.0, ("y", "P"): 5.0, ("y", "Q"): 6.0}


def test_first_wins_and_append(spark):
    schema = "case_id string, kind string, quantity string, entity string, year int, slot_hour int, value double, src_rank int, src_file string"
    row = lambda h, v, r: ("c", "area", "q", "a", 2023, h, v, r, str(r))
    f = spark.createDataFrame([row(0, None, 1), row(0, 5.0, 2), row(1, 6.0, 2)], schema)
    assert {r["slot_hour"]: r["value"] for r in merge.first_wins(f).collect()} == {0: None, 1: 6.0}
    held, fresh = f.filter("src_rank = 1"), f.filter("src_rank = 2")
    assert {r["slot_hour"]: r["value"] for r in merge.append_cells(held, fresh).collect()} == {0: None, 1: 6.0}
    assert tuple(merge.append_report(held, fresh).first()) == (2, 1, 1)
    assert merge.duplicate_cells(f.unionByName(f.filter("slot_hour = 1"))).count() == 1


def test_fit_refusals(spark):
    p = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("d", 1.0, 3.0), ("d", 2.0, 3.0)], "k string, x double, y double")
    got = {r["k"]: r for r in stats.line_fit(p, ["k"]).collect()}
    assert got["a"]["slope"] == 2 and got["b"]["refusal"] == "fewer than two points" and got["c"]["refusal"] == "x does not vary" and got["d"]["r2"] == 1.0


def test_periods(spark):
    s = values(spark, [("c", "a", 2019, cal.SLOT_HOURS - 24, 1.0), ("c", "a", 2020, 0, 3.0)])
    got = shapes.with_period(s, "week").select(F.col("period").cast("string"), "axis_hour").collect()
    assert sorted(map(tuple, got)) == [("2019-12-30", 24), ("2019-12-30", 48)]
    r = shapes.period_summary(values(spark, [("c", "a", 2000 + k, 0, float(k)) for k in range(11)]).withColumn("axis_hour", F.lit(0)), ["case_id"]).first()
    assert (r["p10"], r["p90"], r["mean"]) == (1.0, 9.0, 5.0)


def test_fuel(spark):
    rows = [("Sunbright", "NG", "", ""), ("Lake PSH 1", "Hydro", "", ""), ("a", "", "", ""), ("b", "(unlisted)", "(unlisted)", "(unlisted)"), ("c", "quux", "", ""), ("d", "", "Combined  Cycle", ""), ("e", "hydrogen blend", "", "")]
    got = {r["entity"]: (r["clean_fuel"], r["fuel_group"]) for r in with_clean_fuel(spark.createDataFrame(rows, "entity string, fuel_type string, technology string, sub_type string")).collect()}
    assert got == {"Sunbright": ("Natural Gas", "Thermal"), "Lake PSH 1": ("Pumped Storage", "Storage"), "a": ("Unknown", "Unknown"), "b": ("Unlisted", "Unlisted"), "c": ("Unrecognised", "Unrecognised"), "d": ("Combined Cycle", "Thermal"), "e": ("Hydrogen", "Thermal")}
    assert rules.required_inputs(spark, ["Gen - Load", "Generation (MWh)"]).filter("missing").count() == 1


def test_browse(spark):
    names = spark.createDataFrame([("Case 10", 1), ("case 2", 2), ("", 3), (None, 4), ("Case 2b", 5)], "name string, row_ix int")
    assert [r["row_ix"] for r in browse.sorted_table(names, "name").collect()] == [2, 5, 1, 3, 4]
    assert [r["row_ix"] for r in browse.sorted_table(names, "name", True).collect()] == [1, 5, 2, 3, 4]
    d = spark.createDataFrame([(1234.6, 0.004), (0.4, 0.5), (None, None)], "v double, r double").select(browse.displayed(F.col("v"), "quantity").alias("a"), browse.displayed(F.col("r"), "ratio").alias("b")).collect()
    assert [tuple(x) for x in d] == [("1,235", "<1%"), ("<1", "50%"), ("", "")]
    e = spark.createDataFrame([("x", "N", 1), ("x", "S", 2), ("x", "N", 3)], "case string, area string, ix int")
    assert [r["name"] for r in browse.series_names(e, ["case", "area"], "ix").orderBy("ix").collect()] == ["N", "S", "N (2)"]
    assert browse.cap_refusals(11, 31, 3) and not browse.cap_refusals(10, 30, 2)
    assert browse.filter_label(years=(2030,), tou="OnPeak") == "years 2030; OnPeak"


def test_ratio_bound(spark):
    assert spark.createDataFrame([(0.29,)], "v double").filter(filters.range_filter(F.col("v"), 29.0, 29.0, ratio=True)).count() == 1


def test_list_merge(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    b = spark.createDataFrame([(2, "z", "new"), (3, "c", "n3")], "k int, x string, y string")
    assert sorted(map(tuple, groups.merge_lists(a, b, "k").collect())) == [(1, "a", None), (2, "b", "new"), (3, "c", "n3")]
    assert tuple(groups.merge_report(a, b, "k").first()) == (1, 1, 1)


def test_resolutions(spark):
    specs = spark.createDataFrame([(1, "c", "bus", "LMP ($/MWh)", True), (2, "c", "bus", "LMP ($/MWh)", False), (3, "d", "bus", "LMP ($/MWh)", False)], "series_id int, case_id string, kind string, quantity string, grouped boolean")
    carried = spark.createDataFrame([("c", "bus", "LMP ($/MWh)")], "case_id string, kind string, quantity string")
    rule = groups.combinable(carried.select("kind", "quantity"), rules.unit_rules(spark))
    got = {r["series_id"]: r["status"] for r in merge.resolutions(specs, carried, rule).collect()}
    assert got == {1: "refused", 2: "resolved", 3: "refused"}


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([("A", 2023, 0, 1.5), ("A", 2023, 24, 2.0)], "series string, year int, slot_hour int, value double")
    long = sinks.hourly_long(s, spark, 2023, 1, kept=F.col("slot_hour") == 0)
    assert long.count() == 8760 and long.filter("value is not null").count() == 1
    wide = sinks.hourly_wide(s, [("A", 2023)], spark)
    assert wide.count() == 8784 and sinks.window_extract(wide, 0, 100, ["A"]).count() == 2
    sinks.write_table(s, str(tmp_path / "t"), ["slot_hour"], {"Cases": "A"})
    assert spark.read.text(str(tmp_path / "t" / "descriptor")).first()[0] == "# Cases: A"
    m = spark.createDataFrame([("a", "G", -1, 1)], "entity string, grp string, coef int, src_order int")
    sinks.write_memberships(m, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).first()["Direction"] == "reversed"
    with pytest.raises(ValueError):
        sinks.save_study(str(tmp_path / "x"), other=s)


def test_stack(spark):
    s = values(spark, [("c", "a", 2023, 0, 1.0), ("c", "b", 2023, 0, 5.0), ("c", "b", 2023, 1, 2.0)])
    st = shapes.stacked(s, shapes.stack_order(s, ["case_id"], "entity"), ["case_id"], "entity")
    assert {(r["entity"], r["slot_hour"]): r["running"] for r in st.collect()} == {("b", 0): 5.0, ("a", 0): 6.0, ("b", 1): 2.0, ("a", 1): 2.0}
    assert merge.stack_checks(s.withColumn("unit", F.lit("MW")), ["case_id"], "entity", "unit").first()["mixed_units"] is False


def test_thinning_and_gaps(spark):
    s = values(spark, [("c", "a", 2023, h, float(v)) for h, v in ((0, 1), (1, 9), (2, 3), (10, 4), (11, -2))])
    got = sorted(map(tuple, shapes.thinned(s, ["case_id"], "slot_hour", 1).select("low_hour", "high_hour").collect()))
    assert got == [(0, 1), (11, 10)]
    e = shapes.window_extremes(s, ["case_id"], "slot_hour").first()
    assert (e["low_hour"], e["high_hour"]) == (11, 1)
    x, y = s.filter("slot_hour < 5"), s.withColumn("year", F.lit(2025))
    assert shapes.xy_pairs(x, y).count() == 3 and shapes.pairing_refusal(x, y.unionByName(x)).first()["refusal"]


def test_metric_groups(spark):
    m = spark.createDataFrame([("Load (MWh)",), ("Load Payment (k$)",), ("RD A. S. Price",), ("Gen - Load",), ("Zzz",), ("CO2 Cost",), ("LMP - Energy ($/MWh)",)], "metric string")
    got = {r["metric"]: (r["title"], r["rank"]) for r in series.metric_groups(m).collect()}
    assert got == {"Load (MWh)": ("Load", 0), "Load Payment (k$)": ("Costs & revenue", 100), "RD A. S. Price": ("Ancillary services", 100), "Gen - Load": ("Calculations", 100), "Zzz": ("Other", 500), "CO2 Cost": ("Emissions", 100), "LMP - Energy ($/MWh)": ("Prices", 100)}


def test_displayed_cells(spark):
    df = spark.createDataFrame([(0.7,), (-0.3,), (0.006,), (-0.002,), (1234.5,), (-0.5,), (0.0,), (None,), (float("nan"),)], "v double")
    got = [tuple(r) for r in df.select(*[browse.displayed(F.col("v"), c) for c in ("quantity", "ratio", "count")]).collect()]
    assert got == [("1", "70%", "1"), (">-1", "-30%", "0"), ("<1", "1%", "0"), (">-1", ">-1%", "0"), ("1,235", "123450%", "1235"), (">-1", "-50%", "0"), ("0", "0%", "0"), ("", "", ""), ("", "", "")]


def test_prefixes(spark):
    names = ["Pth 03 East", "P12 North Tie", "W07_AB_CD__X", "(odd) name", " A-B c", "ab"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(browse.prefix_of(F.col("n"))).collect()]
    assert got == ["Pth 03", "P12", "W07", "(odd", "A-B ", "ab"]


def test_fuel_cells_that_say_nothing(spark):
    nothing = ["", "NA", "n/a", " none", "Null", "unknown", "(Blank)", "-", "--", None]
    rows = [(f"u{k}", x, "", None) for k, x in enumerate(nothing)] + [("u PSH 1", "water", "", None), ("p", "-", "Pump  Storage", None), ("q", "zzz", "-", None), ("r", "(unlisted)", "(unlisted)", "(unlisted)")]
    got = [r["clean_fuel"] for r in with_clean_fuel(spark.createDataFrame(rows, "entity string, fuel_type string, technology string, sub_type string")).orderBy("entity").collect()]
    assert sorted(got) == sorted(["Unknown"] * len(nothing) + ["Pumped Storage"] * 2 + ["Unrecognised", "Unlisted"])


def test_nameplate_without_any_cap(spark):
    members = spark.createDataFrame([("a", "u1"), ("a", "u2"), ("b", "u1"), ("b", "u3")], "series string, entity string")
    units = spark.createDataFrame([("u1", None, 1.0), ("u2", 0.0, 2.0), ("u3", 5.0, None)], "entity string, pmax double, pmin double")
    got = {r["series"]: (r["pmax"], r["pmin"], r["capless"]) for r in ranges.nameplate(members, units, ["series"]).collect()}
    assert got == {"a": (None, 3.0, 0), "b": (5.0, 1.0, 1)}


def test_first_file_wins_without_chance(spark):
    rows = [("c", "k", "q", "e", 2030, 5, v, r, f) for v, r, f in [(2.0, 1, "b"), (None, 1, "a"), (1.0, 2, "0")]]
    df = spark.createDataFrame(rows, "case_id string, kind string, quantity string, entity string, year int, slot_hour int, value double, src_rank int, src_file string")
    got = merge.first_wins(df)
    assert got.columns == df.columns and [(r["value"], r["src_file"]) for r in got.collect()] == [(None, "a")]


def test_plans_scan_the_facts_once(spark, monkeypatch):
    """Counted over the query's plan and those of the tables that it writes on its way."""
    from pyspark.sql import DataFrameWriter

    import __spark_entry__ as entry

    plans, write = [], DataFrameWriter.parquet
    plan_of = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: plans.append(plan_of(self._df)) or write(self, *a, **b))
    for name in ("weighted_price_stats", "box_by_month", "box_by_dimensions", "stack_totals", "downsample_stack", "percent_of_range", "xy_fit", "ranked_entities", "keepset_group", "common_axis", "downsample", "first_wins_merge"):
        plans.clear()
        plans.append(plan_of(entry.queries()[name](spark, "/root/testdata/sf0.001")))
        assert sum("l_returnflag" in line and "Relation" in line for plan in plans for line in plan.splitlines()) == 1, name
        assert "CartesianProduct" not in "".join(plans), name
