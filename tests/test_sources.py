"""Text exports, lists, limits and memberships, written here in awkward shapes."""

import pytest
from pyspark.sql import functions as F

from casehours import sinks
from casehours.functions import cells
from casehours.operators import merge
from casehours.sources import lists
from casehours.sources.catalog import catalog, classify, import_plan
from casehours.sources.exports import axis_scan, ranked_files, read_long, read_wide, table_hours
from casehours.streaming.append import append_files, watch

WIDE = "\n".join(
    [
        "Area Hourly 'Load (MWh)' Data for Year 2035",
        "",
        "(From the first hour of 1/1/2035 to the last hour of 12/31/2036. Column identifier -- AreaName)",
        "",
        "Date,Hour,TOU, NORTH ,SOUTH,NORTH,",
        "1/1/2035,1,OffPeak,1.5,-54321.098,9,",
        "1/1/2035,2.0,Off-Peak,,9.876543210e7,9,",
        "2/28/2035,24,ON PEAK,3",
        "3/1/2035 0:00,1,onpeak,4,5,9,",
        "2/29/2035,1,OnPeak,4,5,9",
        "12/31/2036,24,OnPeak,7,8,9",
        "1/1/2037,1,OnPeak,7,8,9",
        "1/2/2035,25,OnPeak,7,8,9",
        "1/2/2035,3,Peak,7,8,9",
        "1/2/2035,4,OnPeak,x,8,9",
        "1/2/2035,5,OnPeak,1,8,9,,77",
    ]
)
LONG = "\r\n".join(
    [
        "Date,Hour,TOU,UnitName,BusID,UnitID,Generation (MWh),Fuel Cost ($)",
        "1/1/2035,1,OnPeak,U1,101,01,5,1e3",
        "1/1/2035,2,OnPeak,U1,101,01,,2",
        "1/1/2035,1,OnPeak,U2,101.0,2,7,3",
        "1/1/2035,1,OnPeak,,101,2,7,3",
        "1/1/2035,3,OnPeak,U2,101,2,7",
        "1/1/2035,4,OnPeak,U2,101,2,a,3",
        "13/1/2035,4,OnPeak,U2,101,2,1,3",
    ]
)


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "base_area.csv").write_text("﻿" + WIDE, encoding="utf-8")
    (tmp_path / "in" / "base_gen.csv").write_text(LONG)
    (tmp_path / "in" / "odd.csv").write_text("hello,world\n1,2\n")
    (tmp_path / "in" / "bus.csv").write_text("Bus Hourly 'LMP ($/MWh)' Data for Year 2035\n\n\n\nDate,Hour,TOU,A,B\n1/1/2035,1,OnPeak,1,2\n")
    return str(tmp_path / "in")


def test_catalog(spark, files):
    got = {r["src_file"]: r for r in catalog(spark, files, "*_area.csv").collect()}
    area = got["base_area.csv"]
    assert (area["kind"], area["shape"], area["quantity"], area["first_year"], area["last_year"], area["case_id"], area["reason"]) == ("area", "wide", "Load (MWh)", 2035, 2036, "base", None)
    assert (got["base_gen.csv"]["kind"], got["base_gen.csv"]["shape"], got["base_gen.csv"]["case_id"]) == ("generator", "long", "base_gen")
    assert got["odd.csv"]["reason"] == "no known shape" and got["bus.csv"]["reason"] == "the bus id row is missing"
    plan = {r["kind"]: r for r in import_plan(catalog(spark, files)).collect()}
    assert plan["area"]["files"] == ["base_area.csv"] and plan["area"]["conflict"] is None


def test_bus_ids():
    head = "Bus Hourly 'LMP ($/MWh)' Data for Year 2035\n\n\n\n,,BusNumber,1,{}\nDate,Hour,TOU,A,B\n"
    assert classify(head.format("2"))["reason"] is None
    assert classify(head.format("1.0"))["reason"] == "a bus id repeats"
    assert classify(head.format("x"))["reason"] == "a bus id is no integer"


def test_read_wide(spark, files):
    facts, quality = read_wide(spark, ranked_files(catalog(spark, files, "*_area.csv")))
    rows = {(r["entity"], r["year"], r["slot_hour"]): r["value"] for r in facts.collect()}
    assert rows[("NORTH", 2035, 0)] == 1.5 and rows[("SOUTH", 2035, 0)] == -54321.098
    assert rows[("NORTH", 2035, 1)] is None and rows[("SOUTH", 2035, 1)] == 98765432.1
    assert rows[("NORTH", 2035, 58 * 24 + 23)] == 3 and rows[("SOUTH", 2035, 58 * 24 + 23)] is None  # a short row
    assert rows[("NORTH", 2035, 60 * 24)] == 4 and rows[("NORTH", 2036, 8783)] == 7
    assert len(rows) == 10
    causes = {r["cause"]: r["rows"] for r in quality.collect()}
    assert causes == {"bad date or hour": 2, "out of span": 1, "bad time of use": 1, "bad cell": 1, "field beyond the header": 1}
    tou = {(r["year"], r["slot_hour"]): r["tou"] for r in table_hours(facts).collect()}
    assert tou[(2035, 0)] == "OffPeak" and tou[(2035, 58 * 24 + 23)] == "OnPeak"


def test_read_long(spark, files):
    facts, quality = read_long(spark, ranked_files(catalog(spark, files)))
    rows = {(r["entity"], r["quantity"], r["slot_hour"]): r["value"] for r in facts.collect()}
    assert rows == {("U1", "Generation (MWh)", 0): 5, ("U1", "Fuel Cost ($)", 0): 1000, ("U1", "Generation (MWh)", 1): None, ("U1", "Fuel Cost ($)", 1): 2, ("U2", "Generation (MWh)", 0): 7, ("U2", "Fuel Cost ($)", 0): 3}
    assert {r["cause"]: r["rows"] for r in quality.collect()} == {"blank or quoted id": 1, "ragged row": 1, "bad cell": 1, "bad date or hour": 1}
    kept, _ = read_long(spark, ranked_files(catalog(spark, files)), ["Fuel Cost ($)"])
    assert {r["quantity"] for r in kept.collect()} == {"Fuel Cost ($)"}
    assert axis_scan(facts).first()["entities"] == 2


def test_lists(spark, tmp_path):
    path = str(tmp_path / "g.csv")
    with open(path, "w") as f:
        f.write('GENERATORLIST\n\nName,Bus ID,Unit ID,Commission Date,ServiceStatus,"PSSEMaxCap(MW)",FuelType\n"A, B",101,01,#2020-01-15#,#TRUE#,"1,234",\'PV\n"A, B",102,1,,NO,5,NG\n,1,1,,,,\nC,102,2,2021/02/30,maybe,NA,n/a\n')
    got = {r["Name"]: r.asDict() for r in lists.read_list(spark, path, "generator_list").collect()}
    assert set(got) == {"A, B", "C"}
    assert got["A, B"]["Bus ID"] == 101 and str(got["A, B"]["Commission Date"]) == "2020-01-15" and got["A, B"]["ServiceStatus"] is True and got["A, B"]["PSSEMaxCap(MW)"] == 1234 and got["A, B"]["FuelType"] == "PV"
    assert got["C"]["Commission Date"] is None and got["C"]["ServiceStatus"] is None and got["C"]["PSSEMaxCap(MW)"] is None and got["C"]["FuelType"] is None
    q = lists.list_quality(spark, path, "generator_list").first()
    assert (q["rows"], q["blank_keys"], q["repeated_keys"]) == (4, 1, 1)


def test_limits(spark, tmp_path):
    path = str(tmp_path / "l.csv")
    months = "Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec"
    with open(path, "w") as f:
        f.write(f"INTERFACELIMITSCHEDULE_MONTHLY\nInterface Name,Year,Type,{months}\nP,2035,max,{','.join(['1000'] * 11)},99999\nP,min,2035,{','.join(['-900'] * 11)},\nP,2036,MAX,{','.join(['5'] * 12)}\n")
    got = {(r["side"], r["month"]): r["value"] for r in lists.read_limits(spark, path).collect()}
    assert got[("MAX", 1)] == 1000 and got[("MAX", 12)] is None and got[("MIN", 2)] == -900 and got[("MIN", 12)] is None and len(got) == 24


def test_memberships(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    with open(path, "w") as f:
        f.write("Name,Bus ID,Unit ID,Grouping\nU1,,,G\n,101,1,G\n,101,7,G\n,x,1,G\n,102,3,H\n")
    units = spark.createDataFrame([("U1", 100, "9"), ("U2", 101, "01"), ("U3", 102, "3"), ("U4", 102, "03")], "entity string, bus_id int, unit_id string")
    rows = lists.read_membership(spark, path, {"name": "Name", "bus_id": "Bus ID", "unit_id": "Unit ID", "grp": "Grouping"})
    got = {r["src_order"]: (r["entity"], r["status"]) for r in lists.generator_members(rows, units).collect()}
    assert got == {1: ("U1", "resolved"), 2: ("U2", "resolved"), 3: (None, "unresolved"), 4: (None, "bad bus number"), 5: (None, "ambiguous")}
    with open(path, "w") as f:
        f.write("Name,Grouping,Direction\nP,B,\nQ,B,Reversed\nR,B,fwd\nR,B,-1\nS,B,sideways\n")
    rows = lists.read_membership(spark, path, {"name": "Name", "grp": "Grouping", "direction": "Direction"})
    got = {r["entity"]: (r["coef"], r["refusal"]) for r in lists.interface_members(rows).collect()}
    assert got == {"P": (1, None), "Q": (-1, None), "R": (None, "both directions"), "S": (None, "unreadable direction")}


def test_cells(spark):
    row = spark.range(1).select(*[cells.number(F.lit(x)).alias(f"n{k}") for k, x in enumerate(("1,234.5", "1d", "NaN", "1e400", "", "-.5"))], *[cells.export_date(F.lit(x)).cast("string").alias(f"d{k}") for k, x in enumerate(("2/29/2024", "2/29/2023", "4/31/2024", "1/2/2024 0:00", "1/2/2024 5:00"))], cells.hour_ending(F.lit("7:00")).alias("h")).first()
    assert list(row) == [1234.5, None, None, None, None, -0.5, "2024-02-29", None, None, "2024-01-02", None, None]


def test_append_and_study(spark, files, tmp_path):
    study = str(tmp_path / "study")
    quality = append_files(spark, [files], study, "*_area.csv")
    assert quality.filter("src_file = 'odd.csv'").count() == 1
    first = spark.read.parquet(f"{study}/cells")
    n = first.count()
    assert n == 16
    append_files(spark, [files], study, "*_area.csv")
    assert spark.read.parquet(f"{study}/cells").count() == n
    first = spark.read.parquet(f"{study}/cells")
    sinks.save_study(str(tmp_path / "saved"), facts=first)
    assert sinks.load_study(spark, str(tmp_path / "saved"), "facts").count() == n
    assert merge.duplicate_cells(first).count() == 0


def test_watch(spark, files, tmp_path):
    study = str(tmp_path / "study")
    watch(spark, files, study, str(tmp_path / "cp"), "*_area.csv").awaitTermination(120)
    assert spark.read.parquet(f"{study}/cells").count() == 16
    assert spark.read.parquet(f"{study}/quality").filter("cause = 'bad cell'").count() == 2


def test_headers_of_any_width(spark, tmp_path):
    n = 5900
    ids, names = [str(100_000 + k) for k in range(n)], [f"A_BUS_OF_THE_NORTH_{k}" for k in range(n)]
    wide = ["Bus Hourly 'LMP ($/MWh)' Data for Year 2035", "", "", ",,BusNumber," + ",".join(ids), "Date,Hour,TOU," + ",".join(names)]
    wide += [f"1/1/2035,{h},OnPeak," + ",".join(str(k) for k in range(n)) for h in (1, 2)]
    long = ["Date,Hour,TOU,Name," + ",".join(names), "1/1/2035,1,OnPeak,N," + ",".join("1" for _ in names)]
    (tmp_path / "bus.csv").write_text("\n".join(wide))
    (tmp_path / "area.csv").write_text("\n".join(long))
    found = ranked_files(catalog(spark, str(tmp_path))).cache()
    got = {r["src_file"]: r for r in found.collect()}
    assert got["bus.csv"]["reason"] is None and got["bus.csv"]["columns"][3:] == names and got["bus.csv"]["key_ids"][3:] == ids
    assert got["area.csv"]["columns"][4:] == names
    facts, quality = read_wide(spark, found)
    assert quality.count() == 0 and facts.count() == 2 * n
    assert facts.filter("entity = '105899'").agg(F.min("value"), F.max("value")).first() == (5899.0, 5899.0)
    facts, quality = read_long(spark, found)
    assert quality.count() == 0 and facts.count() == n
