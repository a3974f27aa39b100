"""Rule tables as data (S-12): unit rules by kind, area metric rules, and the fuel vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Unit, class, temporal rule, for each kind of export.
UNIT_RULES = {
    "bus": (("$/MWh", "INTENSIVE", "MEAN"), ("MW", "RATE", "MEAN"), ("MWh", "EXTENSIVE", "SUM"), ("$", "EXTENSIVE", "SUM"), ("k$", "EXTENSIVE", "SUM"), ("kV", "INTENSIVE", "MEAN"), ("%", "INTENSIVE", "MEAN")),
    "interface": (("MW", "RATE", "MEAN"), ("MWh", "EXTENSIVE", "SUM"), ("$", "EXTENSIVE", "SUM"), ("k$", "EXTENSIVE", "SUM"), ("$/MWh", "INTENSIVE", "MEAN"), ("$/MW", "INTENSIVE", "MEAN"), ("%", "INTENSIVE", "MEAN"), ("h", "EXTENSIVE", "SUM")),
    "generator": (("MWh", "EXTENSIVE", "SUM"), ("MW", "RATE", "MEAN"), ("$", "EXTENSIVE", "SUM"), ("k$", "EXTENSIVE", "SUM"), ("$/MWh", "INTENSIVE", "MEAN"), ("MMBtu", "EXTENSIVE", "SUM"), ("h", "EXTENSIVE", "SUM"), ("%", "INTENSIVE", "MEAN")),
}

#: Generator quantities whose meaning depends on the unit's technology (Q-19).
POLYSEMOUS = ("Fuel Cost ($) /ES Storage", "Startup Fuel Consumpt./ Spillage/ PumpLine", "Sec. Fuel Consmpt. / Pumping Cost")

#: Weights of area metrics that are weighted means; metric, weight, fallback weight.
AREA_WEIGHTS = (
    ("Avg LMP Weighted by Gen ($/MWh)", "Generation (MWh)", None),
    ("Avg LMP Weighted by Load ($/MWh)", "Load (MWh)", None),
    ("LMP - Energy ($/MWh)", "Load (MWh)", None),
    ("LMP Loss Component ($/MWh)", "Load (MWh)", None),
    ("LMP Congestion Component ($/MWh)", "Load (MWh)", None),
    ("Generation / Installed Capacity", "Installed Capacity (MW)", None),
)
#: Reserve products; each has a price weighted by the served amount, or else by the requirement.
RESERVES = ("RD", "LFD", "RU", "SR", "LFU", "FR")
#: Area metrics that are plain means, that sum over hours, and that sum but whose hours average.
AREA_MEANS = ("Simple Average LMP($/MWh)",)
AREA_SUMS = ("Generation (MWh)", "Load (MWh)", "Gen - Load", "Served Load Including Losses (MWh)", "Unserved Load (MWh)", "Spillage (MWh)", "Estimated Losses (MWh)", "Import Flow(MWh)", "Export Flow (MWh)", "Export - Import", "Generation Revenue (k$)", "Load Payment (k$)", "Generation Cost (k$)", "Unserved Load Cost (k$)", "Import Cost (k$)", "Export Revenue (k$)", "Total Generation Revenue (k$)", "Total Load Payment (k$)", "SO2 Amt", "NOx Amt", "CO2 Amt", "SO2 Cost", "NOx Cost", "CO2 Cost")
AREA_CAPACITIES = ("Installed Capacity (MW)", "Available Capacity (MW)", "Committed Capacity (MW)", "Net Load (MW)")
#: Area metrics that count twice when areas of a group trade with each other (Q-13).
INTRA_GROUP_HAZARDS = ("Import Flow(MWh)", "Export Flow (MWh)", "Import Cost (k$)", "Export Revenue (k$)")
#: Calculated area metrics: name, first operand, second operand, operation.
AREA_DERIVED = (
    ("Gen - Load", "Generation (MWh)", "Load (MWh)", "sub"),
    ("Generation / Installed Capacity", "Generation (MWh)", "Installed Capacity (MW)", "div"),
    ("Export - Import", "Export Flow (MWh)", "Import Flow(MWh)", "sub"),
)

#: Cleaned fuel, fuel group, spellings.
FUELS = (
    ("Solar", "Solar", ("pv", "pv-nt", "pv-t", "pv-tracking", "solar", "sun")),
    ("Wind", "Wind", ("wt", "wind", "wnd", "wtg")),
    ("Hydro", "Hydro", ("hy", "water", "hydro", "wat", "ror", "run-of-river")),
    ("Pumped Storage", "Storage", ("psh", "ps-hydro", "pumped storage", "pumpedstorage", "pumped hydro")),
    ("Battery Storage", "Storage", ("ba", "mwh", "electricity", "battery", "bess", "es")),
    ("Nuclear", "Thermal", ("nuc", "nuclear", "uranium")),
    ("Natural Gas", "Thermal", ("ng", "natgas", "natural gas", "methane", "lng")),
    ("Combined Cycle", "Thermal", ("cc", "combined cycle")),
    ("Coal", "Thermal", ("sub", "subbituminous coal", "rc", "coal", "lig", "lignite")),
    ("Bituminous Coal", "Thermal", ("bit", "bituminous coal")),
    ("Petroleum Coke", "Thermal", ("pc", "pet coke", "petroleum coke")),
    ("Distillate Fuel Oil", "Thermal", ("dfo", "df", "oil", "diesel", "distillate", "distillate fuel oil")),
    ("Residual Fuel Oil", "Thermal", ("rfo", "residual fuel oil")),
    ("Biomass", "Thermal", ("bio", "biomass", "biomass waste", "obg", "obs", "wds", "wood", "wood waste", "msw")),
    ("Black Liquor", "Thermal", ("blq", "black liquor")),
    ("Landfill Gas", "Thermal", ("lfg", "landfill gas")),
    ("Geothermal", "Thermal", ("geo", "geothermal")),
    ("Waste Heat", "Thermal", ("wh", "waste heat", "heat recovery")),
    ("Hydrogen", "Thermal", ("h2", "hydrogen", "hydrogen fuel cell")),
)


def unit_rules(spark: SparkSession) -> DataFrame:
    """kind, unit, class, temporal."""
    return spark.createDataFrame([(k, *r) for k, rules in UNIT_RULES.items() for r in rules], "kind string, unit string, class string, temporal string")


def area_rules(spark: SparkSession) -> DataFrame:
    """metric, series (SUM, MEAN, WEIGHTED_MEAN), temporal, weight, fallback_weight, hazard."""
    weighted = [*AREA_WEIGHTS, *((f"{r} A. S. Price", f"{r} A. S. Served Amount", f"{r} A. S. Requirement") for r in RESERVES)]
    rows = [(m, "WEIGHTED_MEAN", "WEIGHTED_MEAN", w, f, False) for m, w, f in weighted]
    rows += [(m, "MEAN", "MEAN", None, None, False) for m in AREA_MEANS]
    rows += [(m, "SUM", "SUM", None, None, m in INTRA_GROUP_HAZARDS) for m in AREA_SUMS]
    rows += [(m, "SUM", "MEAN", None, None, False) for m in (*AREA_CAPACITIES, *(f"{r} A. S. {x}" for r in RESERVES for x in ("Requirement", "Served Amount")))]
    return spark.createDataFrame(rows, "metric string, series string, temporal string, weight string, fallback_weight string, hazard boolean")


def derived_metrics(spark: SparkSession) -> DataFrame:
    """metric, a, b, op of calculated area metrics."""
    return spark.createDataFrame(list(AREA_DERIVED), "metric string, a string, b string, op string")


def fuel_spellings(spark: SparkSession) -> DataFrame:
    """spelling, clean, fuel_group; a spelling that repeats is refused."""
    rows = [(s, clean, group) for clean, group, spellings in FUELS for s in spellings]
    if len({r[0] for r in rows}) != len(rows):
        raise ValueError("a fuel spelling repeats")
    return spark.createDataFrame(rows, "spelling string, clean string, fuel_group string")


def required_inputs(spark: SparkSession, retained: list[str]) -> DataFrame:
    """metric, input, missing: weights and operands that the retained metrics need (F-15)."""
    from pyspark.sql import functions as F

    weights = area_rules(spark).filter("weight is not null").select("metric", F.explode(F.array_compact(F.array("weight", "fallback_weight"))).alias("input"))
    operands = spark.createDataFrame([(m, x) for m, a, b, _ in AREA_DERIVED for x in (a, b)], "metric string, input string")
    needed = weights.unionByName(operands).distinct()
    return needed.filter(F.col("metric").isin(*retained)).withColumn("missing", ~F.col("input").isin(*retained))
