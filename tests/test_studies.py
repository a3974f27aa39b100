"""Cells, quantiles, stacks, runs, spans, imports and audits on small cases; workers without the package."""

import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from casehours.functions import rules
from casehours.operators import browse, filters, groups, merge, ranges, series, shapes, stats
from casehours.sources import catalog, lists


def texts(spark, values, of=browse.cell_text):
    return [r["t"] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", of(F.col("v")).alias("t")).orderBy("k").collect()]


def test_cell_texts(spark):
    cases = {42.0: "42", -7.0: "-7", 0.0: "0", -0.0: "0", 16777216.0: "16777216", 12345678.0: "12345678", 999999999.0: "1e+9", 0.1: "0.1", 1 / 3: "0.33333334", 0.25: "0.25", 0.0001: "0.0001", 1e-6: "0.000001", 1e-7: "1e-7", 1.4e-45: "1.401298e-45", 3.4028234663852886e38: "3.4028235e+38", -1.2345679e9: "-1.234568e+9", 1.2345678e-4: "0.00012345678", 1e9: "1e+9", 3957857.25: "3957857.3", -0.5: "-0.5", 123456.789: "123456.79"}
    assert texts(spark, list(cases)) == list(cases.values())
    assert texts(spark, [None, float("nan"), float("inf"), float("-inf"), 1e300]) == [""] * 5
    rng = random.Random(3)
    values = [float(np.float32((rng.random() - 0.5) * 10 ** rng.randint(-12, 12))) for _ in range(4000)]
    for v, t in zip(values, texts(spark, values), strict=True):
        assert np.float32(float(t)) == np.float32(v) and not (("." in t) and t.split("e")[0][-1] in "0."), (v, t)


def test_percent_texts_as_ratios(spark):
    cases = {"42.5": "0.425", "42": "0.42", "100": "1", "12345.6": "123.456", "5": "0.05", "0.5": "0.005", "-0.5": "-0.005", "-250": "-2.5", "0": "0", "": "", "1.5e-7": "1.5e-9", "2e+9": "2e+7", "1e+1": "1e-1", "-1000": "-10"}
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string").select("k", browse.percent_text_as_ratio(F.col("t")).alias("r"))
    assert [r["r"] for r in df.orderBy("k").collect()] == list(cases.values())


def test_cell_texts_are_compiled(spark):
    df = spark.createDataFrame([(1.5,)], "v double").select(browse.cell_text(F.col("v")).alias("t")).select("t", browse.percent_text_as_ratio(F.col("t")).alias("r"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan  # Spark interprets those, and works out anew what stands in them several times
    assert plan.count("format_string") <= 16 and df.collect() == [("1.5", "0.015")]


def test_ratios_of_odd_percent_texts(spark):
    cases = {"0.00": "0", "-0.00": "0", "007": "0.07", ".5": "0.005", "-.5": "-0.005", "100.": "1", "-99.90": "-0.999", "1010.10": "10.101", None: None}
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string").select("k", browse.percent_text_as_ratio(F.col("t")).alias("r"))
    assert [r["r"] for r in df.orderBy("k").collect()] == list(cases.values())


def box_of(values):
    p25, p50, p75 = np.quantile(values, (0.25, 0.5, 0.75))
    low, high = p25 - 1.5 * (p75 - p25), p75 + 1.5 * (p75 - p25)
    inside = [v for v in values if low <= v <= high]
    return [len(values), min(values), p25, p50, p75, max(values), min(inside), max(inside), len(values) - len(inside)]


@pytest.mark.parametrize("sorted_values, buckets", ((10_000, 1024), (3, 4), (1, 2)))
def test_quantiles_without_a_task_a_group(spark, monkeypatch, sorted_values, buckets):
    monkeypatch.setattr(stats, "SORTED_VALUES", sorted_values)
    monkeypatch.setattr(stats, "BUCKETS", buckets)
    rng = random.Random(sorted_values)
    groups_ = {"even": [float(k) for k in range(101)], "skewed": [10.0 ** rng.randint(0, 9) * rng.random() for _ in range(60)], "one": [5.0], "two": [-1.0, 2.0], "same": [0.0] * 50, "hot": [0.0] * 400 + [rng.random() for _ in range(40)], "signs": [rng.uniform(-5, 5) for _ in range(77)], None: [3.0, 1.0, 2.0, 2.0]}
    rows = [(g, v) for g, vs in groups_.items() for v in vs] + [("even", None), ("gone", None)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(3)
    got = {r["g"]: list(r)[1:-1] for r in stats.box_stats(df, ["g"]).collect()}
    assert set(got) == set(groups_)
    for g, vs in groups_.items():
        assert got[g] == pytest.approx(box_of(vs)), g
    q = {r["g"]: [r["p25"], r["median"], r["p75"]] for r in stats.quartiles(df, ["g"]).collect()}
    assert q["skewed"] == pytest.approx(list(np.quantile(groups_["skewed"], (0.25, 0.5, 0.75))))


def test_values_are_counted_before_they_meet(spark):
    """No exchange brings rows together by the group alone but for sums of counts."""
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("value"))
    counts = df.groupBy("g", F.col("value").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.groupBy("g").agg(F.min("v"), F.max("v"), F.count(F.lit(1)))
    plan = ends._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan
    boxes = stats.box_of_counts(stats.value_counts(df, ["g"]), ["g"])
    boxes.collect()
    plan = boxes._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "percentile" not in plan and "BroadcastHashJoin" in plan


def test_boxes_of_several_dimensions_scan_once(spark, tmp_path):
    rng = random.Random(4)
    rows = [("A" if k % 3 else "B", "x", 2023 + k % 2, rng.randrange(8784), rng.random()) for k in range(900)]
    spark.createDataFrame(rows, "case_id string, grp string, year int, slot_hour int, value double").write.parquet(str(tmp_path / "s"))
    s = spark.read.parquet(str(tmp_path / "s"))
    got = {(r["dimension"], r["dim"]): (r["n"], round(r["median"], 9)) for r in shapes.boxes_by_dimensions(s, ["grp"], ["case", "year", "season"]).collect()}
    for d in ("case", "year", "season"):
        for r in shapes.boxes(s, ["grp"], d).collect():
            assert got.pop((d, str(r["dim"]))) == (r["n"], round(r["median"], 9))
    assert not got


def test_stacks_thin_together(spark):
    rng = random.Random(5)
    hours, gaps = range(900), {300, 301, 700}
    lines = {n: {h: rng.uniform(-3, 9) for h in hours if h not in gaps and not (n == "b" and h == 500)} for n in "abc"}
    s = spark.createDataFrame([("k", n, 2023, h, v) for n, own in lines.items() for h, v in own.items()], "g string, line string, year int, slot_hour int, value double")
    wide = shapes.stack_hours(s, shapes.stack_order(s, ["g"], "line"), ["g"], "line")
    order = sorted("abc", key=lambda n: -sum(lines[n].values()))
    totals = {h: np.cumsum([lines[n].get(h, 0.0) for n in order]).tolist() for h in hours if h not in gaps}
    assert {r["slot_hour"]: r["totals"] for r in wide.collect()} == {h: pytest.approx(t) for h, t in totals.items()}
    kept, run, columns = {}, 0, {}
    for h in sorted(totals):
        run += h - 1 not in totals
        columns.setdefault((run, min(29, int(h / 899 * 30))), []).append(h)
    for key, own in columns.items():
        kept[key] = {f(own, key=lambda h, k=k: totals[h][k]) for k in range(3) for f in (min, max)}
    rows = shapes.stack_rows(shapes.thinned_stack(wide, ["g"], "slot_hour", 30), ["g", "run", "column", "slot_hour"], "line").collect()
    got, runs = {}, sorted({r["run"] for r in rows})
    for r in rows:
        got.setdefault(r["line"], {}).setdefault((runs.index(r["run"]) + 1, r["column"]), set()).add(r["slot_hour"])
        assert r["running"] == pytest.approx(totals[r["slot_hour"]][order.index(r["line"])])
    assert got == dict.fromkeys("abc", kept)


def test_runs_of_days(spark):
    runs = spark.createDataFrame([("a", 5, 3), ("a", 6, 8), ("a", 10, 10), ("a", -4, 0), ("a", 360, 900), ("a", 700, 800), ("b", 2, 40)], "case_id string, first_day int, last_day int")
    got = sorted((r["case_id"], r["first_day"], r["last_day"]) for r in filters.merged_runs(runs, ["case_id"]).collect())
    assert got == [("a", 0, 0), ("a", 3, 8), ("a", 10, 10), ("a", 360, 365), ("b", 2, 40)]
    assert [x[1:] for x in got[:4]] == filters.normalized_runs([(5, 3), (6, 8), (10, 10), (-4, 0), (360, 900)])
    facts = spark.range(3 * 366).select(F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("case_id"), (F.floor(F.col("id") / 3) * 24 + 7).cast("int").alias("slot_hour"))
    kept = filters.in_runs(facts, runs, ["case_id"])
    assert {r["case_id"]: r["count"] for r in kept.groupBy("case_id").count().collect()} == {"a": 1 + 6 + 1 + 6, "b": 39, "c": 366}
    assert "NestedLoop" not in kept._jdf.queryExecution().executedPlan().toString() and kept.columns == facts.columns
    many = spark.range(10_000).select(F.lit("a").alias("case_id"), (F.col("id") * 7 % 366).cast("int").alias("first_day"), (F.col("id") * 7 % 366 + F.col("id") % 2).cast("int").alias("last_day"))
    assert filters.in_runs(facts, many.filter("first_day % 5 <> 3"), ["case_id"]).filter("case_id = 'a'").count() == len({d for f in range(366) if f % 5 != 3 for d in (f, f + f % 2) if d < 366})  # odd days have runs of two


def test_spans_of_landing_files(spark):
    rows = [
        ("no case", "add", 2035, 2035, None, None, None, None, "accepted", 2035, 2035),
        ("equal", "replace", 2034, 2035, None, None, 2034, 2035, "accepted", 2034, 2035),
        ("more", "replace", 2034, 2036, 2034, 2035, 2034, 2035, "extends", 2034, 2036),
        ("later", "add", 2036, 2036, 2034, 2035, 2034, 2035, "extends", 2034, 2036),
        ("earlier", "add", 2033, 2033, 2034, 2035, 2034, 2035, "extends", 2033, 2035),
        ("inside", "add", 2035, 2035, 2034, 2035, 2034, 2035, "accepted", 2034, 2035),
        ("alone", "add", 2034, 2035, None, None, 2034, 2035, "accepted", 2034, 2035),
        ("short", "replace", 2034, 2034, None, None, 2034, 2036, "refused", 2034, 2034),
        ("apart", "replace", 2035, 2036, None, None, 2034, 2035, "refused", 2035, 2036),
        ("own years do not count", "replace", 2034, 2034, 2034, 2036, 2034, 2036, "refused", 2034, 2034),
        ("still short", "add", 2036, 2036, 2035, 2035, 2034, 2036, "refused", 2035, 2036),
        ("gap", "add", 2037, 2037, 2034, 2035, 2034, 2035, "refused", 2034, 2037),
        ("long", "add", 2036, 2290, 2034, 2035, 2034, 2035, "refused", 2034, 2290),
    ]
    df = spark.createDataFrame([r[:8] for r in rows], "name string, mode string, first_year int, last_year int, slot_first int, slot_last int, case_first int, case_last int")
    got = {r["name"]: (r["verdict"], r["result_first"], r["result_last"]) for r in merge.judged_spans(df).collect()}
    assert got == {r[0]: r[8:] for r in rows}


def test_cases_extend_together(spark):
    spans = "case_id string, slot string, first_year int, last_year int"
    committed = spark.createDataFrame([("both", "area", 2034, 2035), ("both", "gen", 2034, 2035), ("one", "area", 2034, 2035), ("left", "area", 2034, 2035), ("left", "gen", 2034, 2035), ("left", "bus", 2034, 2036), ("quiet", "area", 2034, 2034), ("apart", "area", 2034, 2034), ("apart", "gen", 2034, 2034)], spans)
    held = spark.createDataFrame([("both", "area", 2034, 2036), ("both", "gen", 2034, 2036), ("one", "area", 2034, 2036), ("left", "area", 2034, 2036), ("apart", "area", 2034, 2035), ("apart", "gen", 2033, 2034), ("new", "area", 2030, 2030)], spans)
    got = {r["case_id"]: (r["first_year"], r["last_year"], r["verdict"], r["differ"]) for r in merge.settled_spans(committed, held).collect()}
    assert got == {"both": (2034, 2036, "extended", []), "one": (2034, 2036, "extended", []), "left": (2034, 2036, "refused", ["gen"]), "apart": (2033, 2035, "refused", ["area", "gen"]), "new": (2030, 2030, "extended", [])}


def test_import_actions(spark):
    files = spark.createDataFrame([("a.csv", "A", "area", "long", None, 2034, 2034, None), ("b.csv", "A", "area", "wide", None, 2035, 2035, None), ("c.csv", "A", "bus", "wide", "LMP", 2034, 2034, None), ("d.csv", "A", "bus", "wide", "LMP", 2035, 2035, None), ("e.csv", "B", "interface", "wide", None, None, None, None), ("f.csv", "B", "interface", "wide", None, None, None, None), ("g.csv", "C", "interface", "wide", None, 2034, 2034, None), ("h.csv", "C", "bus", "wide", "x", 2034, 2034, "no header row")], "src_file string, case_id string, kind string, shape string, quantity string, first_year int, last_year int, reason string")
    held = spark.createDataFrame([("A", "bus", "LMP", 2033, 2034, 8760, 17520), ("C", "interface", None, 2034, 2034, 8760, 8760)], "case_id string, kind string, quantity string, first_year int, last_year int, hours_seen long, real_hours long")
    row = lambda r: (r["case_is_new"], r["action"], len(r["files"]), r["merges"], r["conflict"], r["note"], r["years"])
    add = {(r["case_id"], r["kind"]): row(r) for r in catalog.import_actions(files, held).collect()}
    assert add == {("A", "area"): (False, "create", 2, False, "the files differ in shape", None, None), ("A", "bus"): (False, "add", 2, True, None, None, [2034, 2035]), ("B", "interface"): (True, "create", 2, False, "the files' quantity was not read", None, None), ("C", "interface"): (False, "add", 1, False, None, None, [2034])}
    replace = {(r["case_id"], r["kind"]): row(r) for r in catalog.import_actions(files, held, "replace").collect()}
    assert replace["A", "bus"][1:] == ("replace", 2, True, None, "replaces 8760 of 17520 hours; add keeps them", [2033, 2034, 2035]) and replace["C", "interface"][5] is None
    with pytest.raises(ValueError):
        catalog.import_actions(files, held, "merge")


def test_groups_hazards_and_operands(spark):
    pairs = "entity string, grp string"
    got = groups.memberships_of(spark.createDataFrame([("u1",), ("u2",), ("u3",), ("u4",)], "entity string"), spark.createDataFrame([("u1", "G"), ("u1", "H"), ("u2 ", "G")], pairs), spark.createDataFrame([("u1", " North"), ("u2", " "), ("u3", "North"), ("u4", None)], "entity string, area string"), spark.createDataFrame([("North", "H"), ("North", "Z"), ("South", "G")], pairs))
    assert {r["entity"]: (r["own_groups"], r["area_groups"], r["groups"]) for r in got.collect()} == {"u1": (["G", "H"], ["H", "Z"], ["G", "H", "Z"]), "u2": (["G"], [], ["G"]), "u3": ([], ["H", "Z"], ["H", "Z"]), "u4": ([], [], [])}
    flow, load = "Import Flow(MWh)", "Load (MWh)"
    facts = spark.createDataFrame([("c", "a", flow, 1.0), ("c", "b", flow, 2.0), ("c", "d", flow, 0.0), ("c", "d", load, 5.0), ("c", "a", load, 5.0)], "case_id string, entity string, quantity string, value double")
    members = spark.createDataFrame([("a", "AB"), ("b", "AB"), ("b", "AB"), ("a", "AD"), ("d", "AD")], pairs)
    assert [(r["grp"], r["metrics"], r["traders"]) for r in merge.group_hazards(facts, members, rules.area_rules(spark)).collect()] == [("AB", [flow], 2)]
    names = "case_id string, quantity string"
    held = spark.createDataFrame([("c", "Generation (MWh)"), ("c", "Export Flow (MWh)"), ("c", "Import Flow(MWh)"), ("e", "Generation (MWh)")], names)
    fresh = spark.createDataFrame([("c", "Load (MWh)"), ("c", "Installed Capacity (MW)"), ("e", "Load (MWh)"), ("e", "Gen - Load")], names)
    assert {(r["case_id"], r["metric"]) for r in series.operands_apart(held, fresh, rules.derived_metrics(spark)).collect()} == {("c", "Gen - Load"), ("c", "Generation / Installed Capacity")}


def test_limits_layout_and_findings(spark, tmp_path):
    months = ",".join(lists.MONTHS)
    cells = lambda *v: ",".join(map(str, (v * 12)[:12]))
    path = tmp_path / "limits.csv"
    path.write_text(f"INTERFACELIMITSCHEDULE_MONTHLY\n\nInterface Name,Year,,{months},Week of note\nA,2034,MAX,{cells(100)},\nA,2034,min,{cells(-50, '')},x\nA,2035,MAX,{cells(1)},\nB,2035,{cells(5)},MAX\n,2034,MAX,{cells(1)},\nC,2034,Max,{cells(99999, 95000, 85000)},Min\nD,2034,none,{cells(1)},\n")
    got = lists.limits_layout(spark, str(path)).first().asDict()
    assert got == {"interfaces": 3, "rows": 4, "duplicate_rows": 1, "rows_without_side": 1, "rows_without_name": 1, "marker_columns": 2, "second_markers": 1, "distinct_years": 2, "blank_cells": 7, "no_limit_cells": 8, "odd_no_limits": 4, "near_threshold": 4, "varying": 0, "marker_title_blank": None, "finer_columns": 1}
    rows = [("MAX", 102.0, 100.0, "exceeded"), ("MAX", 101.0, 100.0, "50-100%"), ("MAX", 5.0, -10.0, "exceeded"), ("MAX", -10.05, -10.0, "ceiling"), ("MAX", -20.0, -10.0, "ceiling"), ("MIN", 3.0, 2.0, "floor"), ("MIN", -60.0, -50.0, "exceeded"), ("MIN", 5.0, -50.0, "opposite sign"), ("MAX", 0.0, 10.0, "under 1%"), ("MAX", 3.0, 10.0, "under 50%"), ("MAX", 3.0, None, "no limit"), ("MAX", None, 3.0, "no flow")]
    df = spark.createDataFrame([(k, *r[:3]) for k, r in enumerate(rows)], "k int, side string, flow double, lim double")
    found = df.select("k", "side", ranges.limit_finding(F.col("side"), F.col("flow"), F.col("lim")).alias("finding"))
    assert [r["finding"] for r in found.orderBy("k").collect()] == [r[3] for r in rows]
    shares = {(r["side"], r["finding"]): (r["n"], r["share"]) for r in ranges.finding_shares(found).collect()}
    assert shares[None, None] == (12, 1.0) and shares["MIN", None] == (3, 0.25) and shares["MIN", "floor"] == (1, pytest.approx(1 / 3))


def test_labels(spark):
    one = spark.range(1)
    say = lambda c: one.select(c.alias("x")).first()["x"]
    assert say(browse.range_label(F.lit(50), F.lit(69))) == "Feb 20 – Mar 10" and say(browse.range_label(F.lit(400), F.lit(365))) == "Dec 31" and say(browse.range_label(F.lit(0), F.lit(-3))) == "Jan 1"
    assert [say(browse.axis_label(p, F.lit(h))) for p, h in (("day", 17), ("week", 41), ("month", 281))] == ["HE 18", "Tue HE 18", "day 12 HE 18"]
    assert say(browse.span_hour_label(F.lit(2030), F.lit(8784 + 50 * 24 + 17))) == "1217 of 2031 (Feb 20, hour ending 18)"


def test_workers_need_not_have_the_package(tmp_path):
    """From another folder, where workers cannot import it from where they stand."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from casehours import sinks
from casehours.sources.catalog import catalog
place = {str(tmp_path / "files")!r}
files = spark.createDataFrame([("a.csv", "Date,Hour,TOU,Name,Load (MWh)\\n1/1/2034,1,OffPeak,x,5\\n")], "name string, text string")
assert sinks.write_texts(files, "file://" + place).first()["bytes"] > 20
row = catalog(spark, place).first()
assert (row["kind"], row["shape"]) == ("area", "long"), row
print("done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "done" in run.stdout, run.stderr[-2000:]
