"""Series specs resolved many at a time, scope of quantities, and metric groups (O-03, F-10, F-09, A-08, Q-15, Q-18, Q-19).

A spec is a row: series_id, case_id, kind, quantity, and either entity or grp (with members, if the stored group is frozen);
neither means the whole case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casehours.functions.rules import AREA_CAPACITIES, AREA_DERIVED, AREA_MEANS, AREA_SUMS, AREA_WEIGHTS, POLYSEMOUS, RESERVES

TABLE = ["case_id", "kind", "quantity"]

#: Metric groups in display order: title, words that match, words that do not, a unit that matches, headline metrics.
METRIC_GROUPS = (
    ("Load", ("load",), ("payment", "cost", "lmp weighted"), None, ("Load (MWh)", "Served Load Including Losses (MWh)", "Net Load (MW)")),
    ("Generation", ("generation", "capacity", "spillage"), ("revenue", "cost"), None, ("Generation (MWh)", "Available Capacity (MW)", "Installed Capacity (MW)")),
    ("Prices", ("lmp", "price"), (), "$/MWh", ("Avg LMP Weighted by Load ($/MWh)", "Avg LMP Weighted by Gen ($/MWh)")),
    ("Interchange & losses", ("flow", "losses", "import", "export", "interface", "wheel"), (), None, ("Import Flow(MWh)", "Export Flow (MWh)")),
    ("Costs & revenue", ("cost", "revenue", "payment"), (), "k$", ()),
    ("Ancillary services", ("a. s.", "a.s.", "reserve", "regulation"), (), None, ()),
    ("Emissions", ("so2", "nox", "co2", "emission"), (), None, ()),
    ("Calculations", (), (), None, ()),
)
#: Fixed value: groups asked first, because their words also occur in others.
ASKED_FIRST = ("Calculations", "Ancillary services", "Emissions")


def resolve(specs: DataFrame, facts: DataFrame, memberships: DataFrame) -> DataFrame:
    """series_id, year, slot_hour, value, contributors of all specs in one job; hours without a value are null."""
    alone = specs.filter("entity is not null").select("series_id", *TABLE, "entity").withColumn("coef", F.lit(1))
    grouped = specs.filter("entity is null and grp is not null").join(memberships.select("kind", "grp", F.col("entity").alias("_member"), "coef"), ["kind", "grp"])
    grouped = grouped.filter(F.col("members").isNull() | F.array_contains("members", F.col("_member"))).select("series_id", *TABLE, F.col("_member").alias("entity"), "coef")
    every = specs.filter("entity is null and grp is null").select("series_id", *TABLE)
    named = facts.join(alone.unionByName(grouped), [*TABLE, "entity"])
    whole = facts.join(every, TABLE).withColumn("coef", F.lit(1))
    columns = ["series_id", "year", "slot_hour", "value", "coef"]
    return named.select(*columns).unionByName(whole.select(*columns)).groupBy("series_id", "year", "slot_hour").agg(F.sum(F.col("value") * F.col("coef")).alias("value"), F.count("value").alias("contributors"))


def offered(facts: DataFrame, cases: list[str], kind: str) -> DataFrame:
    """quantity, cases: quantities of a kind that the cases have, and in how many of them (F-10)."""
    return facts.filter(F.col("case_id").isin(*cases) & (F.col("kind") == kind)).groupBy("quantity").agg(F.count_distinct("case_id").alias("cases"))


def quantity_scope(facts: DataFrame, cases: list[str], kind: str, rules: DataFrame | None = None) -> DataFrame:
    """quantity, cases, offered, reason: what the cases carry of a kind, and why a quantity is withheld (F-10).

    ``rules`` (kind, quantity, can_group, reason, as from ``groups.combinable``): only what they let combine is offered.
    """
    carried = offered(facts, cases, kind)
    if rules is None:
        return carried.withColumn("offered", F.lit(True)).withColumn("reason", F.lit(None).cast("string"))
    own = rules.filter(F.col("kind") == kind).select("quantity", "can_group", F.col("reason").alias("_why"))
    joined = carried.join(own, "quantity", "left")
    can = F.coalesce("can_group", F.lit(False))
    return joined.select("quantity", "cases", can.alias("offered"), F.when(~can, F.coalesce("_why", F.lit("no rule for the unit"))).alias("reason"))


def _known_metrics() -> dict[str, str]:
    """Metrics that have a rule, and their units: the last parentheses."""
    names = {*(m for m, *_ in AREA_WEIGHTS), *AREA_MEANS, *AREA_SUMS, *AREA_CAPACITIES, *(m for m, *_ in AREA_DERIVED)}
    names |= {f"{r} A. S. {x}" for r in RESERVES for x in ("Price", "Requirement", "Served Amount")}
    return {m: m[m.rindex("(") + 1 : -1] if m.endswith(")") else "" for m in names}


def metric_group(name: Column) -> Column:
    """The display group of an area metric (O-03)."""
    low, known = F.lower(name), _known_metrics()

    def matches(title: str, words: tuple, but: tuple, unit: str | None) -> Column:
        if title == "Calculations":
            return name.isin(*[m for m, *_ in AREA_DERIVED])
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        for w in but:
            hit = hit & ~low.contains(w)
        return hit | name.isin(*[m for m, u in known.items() if u == unit]) if unit else hit

    order = [g for g in METRIC_GROUPS if g[0] in ASKED_FIRST] + [g for g in METRIC_GROUPS if g[0] not in ASKED_FIRST]
    out = F.lit("Other")
    for title, words, but, unit, _ in reversed(order):
        out = F.when(matches(title, words, but, unit), title).otherwise(out)
    return out


def metric_groups(metrics: DataFrame) -> DataFrame:
    """``metrics`` (metric, perhaps sparse and degenerate) with title, group_rank and rank: headline first, then varying ones,
    sparse ones, constants, and metrics without a rule last (O-03)."""
    title = metric_group(F.col("metric"))
    titles = [g[0] for g in METRIC_GROUPS]
    group_rank, headline = F.lit(len(titles)), F.lit(None).cast("int")
    for k, (t, *_, first) in enumerate(METRIC_GROUPS):
        group_rank = F.when(F.col("title") == t, k).otherwise(group_rank)
        for j, m in enumerate(first):
            headline = F.when((F.col("title") == t) & (F.col("metric") == m), j).otherwise(headline)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in metrics.columns else F.lit(False)
    known = F.col("metric").isin(*_known_metrics())
    rank = F.coalesce(headline, F.when(~known, 500).when(flag("degenerate"), 300).when(flag("sparse"), 200).otherwise(100))
    return metrics.withColumn("title", title).withColumn("group_rank", group_rank).withColumn("rank", rank)


def directional_refusals(members: DataFrame, directional_units: list[str], unit: str = "unit") -> DataFrame:
    """Reversed members of series whose unit has no direction (Q-15)."""
    return members.filter((F.col("coef") < 0) & ~F.col(unit).isin(*directional_units))


def append_outside(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entities of an append that the loaded axis lacks (Q-18)."""
    return fresh.select(*TABLE, "entity").distinct().join(held.select(*TABLE, "entity").distinct(), [*TABLE, "entity"], "left_anti")


def operands_apart(held: DataFrame, fresh: DataFrame, derived: DataFrame) -> DataFrame:
    """case_id, metric: calculated metrics that the joined metrics offer and neither load did alone, which stay unfilled (Q-18).

    ``held`` and ``fresh``: case_id, quantity of an area table and of what is appended. ``derived``: metric and its operands a, b.
    """
    both = held.select("case_id", "quantity", F.lit(1).alias("load")).unionByName(fresh.select("case_id", "quantity", F.lit(2).alias("load")))
    carried = both.groupBy("case_id", "quantity").agg(F.array_sort(F.collect_set("load")).alias("loads"))
    side = lambda x: derived.select("metric", F.col(x).alias("quantity")).join(carried, "quantity").select("case_id", "metric", F.col("loads").alias(f"loads_{x}"))
    offered = side("a").join(side("b"), ["case_id", "metric"]).filter(~F.arrays_overlap("loads_a", "loads_b"))
    return offered.select("case_id", "metric").join(carried.select("case_id", F.col("quantity").alias("metric")), ["case_id", "metric"], "left_anti")


def polysemous(quantities: DataFrame) -> DataFrame:
    """Generator quantities whose meaning depends on the unit's technology (Q-19)."""
    return quantities.filter((F.col("kind") == "generator") & F.col("quantity").isin(*POLYSEMOUS))
