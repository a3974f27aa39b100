"""Cleaned fuels and fuel groups of generators (T-11 to T-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casehours.functions.rules import FUELS, fuel_spellings

COLUMNS = ("fuel_type", "technology", "sub_type")
UNLISTED = "(unlisted)"

#: Cells that say nothing.
SAYS_NOTHING = ("", "na", "n/a", "none", "null", "unknown", "(blank)", "-", "--")

#: What tells a fuel where no spelling does, in order of precedence: whole cells, words, and parts of words.
HINTS = (
    ("Pumped Storage", (), ("psh", "ps", "ph"), ("pumped", "pump storage", "pumpstorage", "hydro pump", "hydropump", "reversible")),
    ("Battery Storage", ("mwh",), ("bess", "es"), ("batter", "li-ion", "lithium", "flywheel", "electrochemical", "storage")),
    ("Solar", (), ("pv",), ("solar", "sun", "photovoltaic")),
    ("Wind", (), ("wnd", "wtg"), ("wind",)),
    ("Geothermal", (), ("geo",), ("geothermal",)),
    ("Biomass", (), (), ("bio", "wood", "landfill", "refuse")),
    ("Hydrogen", (), ("h2",), ("hydrogen",)),
    ("Hydro", (), ("wat", "ror"), ("hydro", "water", "run-of-river", "pondage")),
    ("Nuclear", (), ("nuc",), ("nuclear", "uranium")),
    ("Coal", (), (), ("coal", "lignite", "sub-bit", "anthracite", "bituminous")),
    ("Distillate Fuel Oil", (), ("fo", "df"), ("oil", "diesel", "distillate", "jet fuel", "jetfuel", "kerosene")),
    ("Natural Gas", (), ("ng", "natgas", "cc", "ct", "gt", "ic"), ("gas", "methane", "combined cycle", "combinedcycle", "combustion turbine", "combustionturbine")),
)
#: The same for pumped storage in a unit's name, where ps or ph may be a site's initials.
PUMPED_NAME = ((), ("psh",), ("pumped", "pump storage", "pumpstorage", "hydro pump", "hydropump"))


def normal_fuel(raw: Column) -> Column:
    """Trimmed, lower case, runs of white space as one; null if it says nothing."""
    text = F.regexp_replace(F.lower(F.trim(raw)), r"\s+", " ")
    return F.when(~text.isin(*SAYS_NOTHING), text)


def hinted(text: Column, cells: tuple, words: tuple, parts: tuple) -> Column:
    """Is the text one of the cells, or has it one of the words or parts? Null is none."""
    hit = text.isin(*cells) if cells else F.lit(False)
    if words:
        hit = hit | F.arrays_overlap(F.split(text, "[^a-z0-9]+"), F.array(*map(F.lit, words)))
    for part in parts:
        hit = hit | text.contains(part)
    return F.coalesce(hit, F.lit(False))


def classified(cells: DataFrame) -> DataFrame:
    """cell, clean, pumped of distinct normalised cells: by spelling, else by the first hint."""
    guess = F.lit(None).cast("string")
    for clean, *hint in reversed(HINTS):
        guess = F.when(hinted(F.col("cell"), *hint), clean).otherwise(guess)
    spelled = cells.join(fuel_spellings(cells.sparkSession).select(F.col("spelling").alias("cell"), F.col("clean").alias("_spelled")), "cell", "left")
    return spelled.select("cell", F.coalesce("_spelled", guess).alias("clean"), hinted(F.col("cell"), *HINTS[0][1:]).alias("pumped"))


def with_clean_fuel(units: DataFrame, name: str = "entity") -> DataFrame:
    """``units`` with clean_fuel and fuel_group. Pumped markers decide first, then spellings and hints column by column.

    A unit without any list row (all columns ``(unlisted)``) is Unlisted, one whose cells say nothing Unknown, one whose
    fuel nothing claims Unrecognised. Every distinct cell is classified once.
    """
    text = lambda c: F.when(normal_fuel(F.col(c)) != UNLISTED, normal_fuel(F.col(c)))
    cells = units.select(F.explode(F.array_compact(F.array(*map(text, COLUMNS)))).alias("cell")).distinct()
    known, out = classified(cells), units
    pumped = hinted(F.regexp_replace(F.lower(F.col(name)), r"\s+", " "), *PUMPED_NAME)
    found, named, unlisted = [], F.lit(False), F.lit(True)
    for k, c in enumerate(COLUMNS):
        side = known.select(F.col("cell").alias(f"_s{k}"), F.col("clean").alias(f"_c{k}"), F.col("pumped").alias(f"_p{k}"))
        out = out.join(side, text(c) == F.col(f"_s{k}"), "left")
        found.append(F.col(f"_c{k}"))
        pumped = pumped | F.coalesce(F.col(f"_p{k}"), F.lit(False))
        named = named | F.col(f"_s{k}").isNotNull()
        unlisted = unlisted & F.coalesce(normal_fuel(F.col(c)) == UNLISTED, F.lit(False))
    clean = F.when(pumped, "Pumped Storage").otherwise(F.coalesce(*found, F.when(unlisted, "Unlisted"), F.when(named, "Unrecognised"), F.lit("Unknown")))
    out = out.withColumn("clean_fuel", clean)
    groups = F.create_map(*[F.lit(x) for c, g, _ in FUELS for x in (c, g)])
    return out.withColumn("fuel_group", F.coalesce(groups[F.col("clean_fuel")], F.col("clean_fuel"))).select(*units.columns, "clean_fuel", "fuel_group")


#: Derived attributes: name to builder of a column over a frame that has clean_fuel (T-13); retired names follow.
DERIVED = {"Fuel Type (Cleaned)": lambda: F.col("clean_fuel"), "Fuel Group": lambda: F.col("fuel_group")}
