"""Merging files and tables, and what goes wrong there (W-08, J-16, Q-03 to Q-10, U-02)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ["case_id", "kind", "quantity", "entity", "year", "slot_hour"]


def first_wins(cells: DataFrame, key: list[str] | None = None, rank: str = "src_rank") -> DataFrame:
    """Of the files that offer a cell the first owns it, an explicit blank (null) included (W-08).

    Of equal ranks the smallest remaining row wins (file name first), so that the result never depends on chance.
    """
    on = key or CELL
    rest = sorted((c for c in cells.columns if c not in on and c != rank), key=lambda c: c != "src_file")
    owner = cells.groupBy(*on).agg(F.min(F.struct(rank, *rest)).alias("_first"))
    return owner.select(*on, "_first.*").select(*cells.columns)


def append_cells(held: DataFrame, fresh: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Held cells stay, blanks included; cells that none held come in (J-16)."""
    on = key or CELL
    return held.unionByName(fresh.select(*held.columns).join(held.select(*on), on, "left_anti"))


def append_report(held: DataFrame, fresh: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row: offered, overlapping, written cells of an append (J-16)."""
    on = key or CELL
    marked = fresh.select(*on).join(held.select(*on, F.lit(True).alias("_held")), on, "left")
    return marked.agg(F.count(F.lit(1)).alias("offered"), F.count_if(F.col("_held").isNotNull()).alias("overlapping"), F.count_if(F.col("_held").isNull()).alias("written"))


def duplicate_cells(cells: DataFrame) -> DataFrame:
    """Cells that one file has more than once (Q-03)."""
    return cells.groupBy("src_file", *CELL).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def tou_conflicts(hours: DataFrame, by: list[str]) -> DataFrame:
    """Hours with more than one time-of-use label in one file (Q-04)."""
    return hours.groupBy(*by, "year", "slot_hour").agg(F.count_distinct("tou").alias("labels")).filter("labels > 1")


def year_gaps(facts: DataFrame, by: list[str], most: int = 256) -> DataFrame:
    """first_year, last_year, missing_years, refusal of each table; a table may have no year that can be read (Q-05, U-02)."""
    span = facts.groupBy(*by).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sort_array(F.collect_set("year")).alias("_have"))
    missing = F.when(F.col("first_year").isNotNull(), F.array_except(F.sequence("first_year", "last_year"), "_have")).otherwise(F.array().cast("array<int>"))
    out = span.withColumn("missing_years", missing).drop("_have")
    refusal = F.when(F.col("first_year").isNull(), "no readable date").when(F.size("missing_years") > 0, "years are missing").when(F.col("last_year") - F.col("first_year") + 1 > most, "too many years")
    return out.withColumn("refusal", refusal)


def spelling_clashes(names: DataFrame, column: str = "quantity") -> DataFrame:
    """Names that differ only in white space (Q-06)."""
    return names.select(column).distinct().groupBy(F.regexp_replace(column, r"\s+", "").alias("squeezed")).agg(F.array_sort(F.collect_set(column)).alias("spellings")).filter(F.size("spellings") > 1)


def mixed_quantities(files: DataFrame) -> DataFrame:
    """Merge groups whose wide files have different quantities (Q-07)."""
    return files.groupBy("case_id", "kind").agg(F.array_sort(F.collect_set("quantity")).alias("quantities")).filter(F.size("quantities") > 1)


def overlap_notes(cells: DataFrame) -> DataFrame:
    """Cells offered by several files of a table (Q-09)."""
    per = cells.groupBy(*CELL).agg(F.count_distinct("src_file").alias("files")).filter("files > 1")
    return per.groupBy("case_id", "kind", "quantity").agg(F.count(F.lit(1)).alias("overlapping"))


def short_columns(cells: DataFrame, hours: DataFrame) -> DataFrame:
    """Entities whose cells do not cover all hours of their table (Q-09)."""
    table = ["case_id", "kind", "quantity"]
    total = hours.groupBy(*table).agg(F.count_distinct("year", "slot_hour").alias("table_hours"))
    per = cells.groupBy(*table, "entity").agg(F.count_distinct("year", "slot_hour").alias("hours"))
    return per.join(total, table).filter("hours < table_hours")


def span_mismatches(spans: DataFrame) -> DataFrame:
    """Tables whose span differs from the longest of their case (Q-10). ``spans``: case_id, kind, quantity, first_year, last_year."""
    w = Window.partitionBy("case_id")
    out = spans.withColumn("case_first", F.min("first_year").over(w)).withColumn("case_last", F.max("last_year").over(w))
    return out.filter((F.col("first_year") != F.col("case_first")) | (F.col("last_year") != F.col("case_last")))


MOST_CASE_YEARS = 256


def judged_spans(landing: DataFrame) -> DataFrame:
    """``landing`` with result_first, result_last, verdict (accepted, extends, refused) and reason of files landing on a table (Q-10).

    ``landing``: mode (add, replace); first_year, last_year of the files; slot_first, slot_last of the table they land on, case_first,
    case_last of the case, both null where there is none. An add joins the table's years, a replace is the files alone. The
    result must contain the case's years; one that has more extends the case.
    """
    joins = (F.col("mode") == "add") & F.col("slot_first").isNotNull()
    first = F.when(joins, F.least("first_year", "slot_first")).otherwise(F.col("first_year"))
    last = F.when(joins, F.greatest("last_year", "slot_last")).otherwise(F.col("last_year"))
    out = landing.withColumn("result_first", first).withColumn("result_last", last)
    gap = joins & ((F.col("first_year") > F.col("slot_last") + 1) | (F.col("slot_first") > F.col("last_year") + 1))
    same = (F.col("result_first") == F.col("case_first")) & (F.col("result_last") == F.col("case_last"))
    contains = (F.col("result_first") <= F.col("case_first")) & (F.col("result_last") >= F.col("case_last"))
    reason = (
        F.when(gap, "the files and the table leave years out")
        .when(joins & (F.col("result_last") - F.col("result_first") + 1 > MOST_CASE_YEARS), f"a case has at most {MOST_CASE_YEARS} years")
        .when(F.col("case_first").isNotNull() & ~contains, "the years do not contain the case's")
    )
    fits = F.col("case_first").isNull() | same
    return out.withColumn("reason", reason).withColumn("verdict", F.when(F.col("reason").isNotNull(), "refused").when(fits, "accepted").otherwise("extends"))


def settled_spans(committed: DataFrame, held: DataFrame) -> DataFrame:
    """case_id, first_year, last_year, verdict (extended, refused), differ of every case with held extensions (Q-10).

    The target is the union of what is held; every held table, and every committed one that no held one takes the place of, must have
    exactly its years; ``differ`` names the slots that have not. Both: case_id, slot, first_year, last_year. One pass over all cases.
    """
    both = committed.select("case_id", "slot", "first_year", "last_year", F.lit(False).alias("is_held")).unionByName(held.select("case_id", "slot", "first_year", "last_year", F.lit(True).alias("is_held")))
    standing = both.withColumn("_taken", F.bool_or("is_held").over(Window.partitionBy("case_id", "slot"))).filter("is_held or not _taken")
    span = lambda f, c: f(F.when(F.col("is_held"), F.col(c))).over(Window.partitionBy("case_id"))
    aimed = standing.withColumn("_first", span(F.min, "first_year")).withColumn("_last", span(F.max, "last_year")).filter("_first is not null")
    other = (F.col("first_year") != F.col("_first")) | (F.col("last_year") != F.col("_last"))
    found = aimed.groupBy("case_id").agg(F.first("_first").alias("first_year"), F.first("_last").alias("last_year"), F.array_sort(F.collect_set(F.when(other, F.col("slot")))).alias("differ"))
    return found.withColumn("verdict", F.when(F.size("differ") == 0, "extended").otherwise("refused"))


def derived_checks(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Calculated metrics: share of negative operands over 10 %, zero denominators (Q-12). ``pairs``: a, b."""
    agg = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") < 0).alias("neg_a"), F.count_if(F.col("b") < 0).alias("neg_b"), F.count_if(F.col("b") == 0).alias("zero_b"))
    return agg.withColumn("sign_doubt", (F.col("neg_a") * 10 > F.col("n")) | (F.col("neg_b") * 10 > F.col("n")))


def stack_checks(series: DataFrame, by: list[str], line: str, unit: str) -> DataFrame:
    """mixed_units and negative values of a stack (Q-16)."""
    return series.groupBy(*by).agg((F.count_distinct(unit) > 1).alias("mixed_units"), F.count_if(F.col("value") < 0).alias("negatives"), F.count_distinct(line).alias("lines"))


def weight_caveats(hourly: DataFrame, by: list[str]) -> DataFrame:
    """Hours of zero total weight inside a weighted series (Q-13). ``hourly`` comes from weighted_series."""
    return hourly.filter("weight_used is not null").groupBy(*by, "weight_used").agg(F.count_if((F.col("weight") == 0) & F.col("value").isNotNull()).alias("zero_weight_hours"))


def missing_weights(metrics: DataFrame, rules: DataFrame, carried: list[str]) -> DataFrame:
    """metric, weight_used, caveat: which weight a weighted mean takes of what is carried, and what that costs (Q-13).

    ``rules`` is ``rules.area_rules``; ``carried``: metrics that the case retained.
    """
    joined = metrics.join(rules.filter("weight is not null"), "metric")
    has = lambda c: F.col(c).isNotNull() & F.col(c).isin(*carried)
    used = F.when(has("weight"), F.col("weight")).when(has("fallback_weight"), F.col("fallback_weight"))
    wanted = F.concat_ws(" or ", "weight", "fallback_weight")
    caveat = F.when(used.isNull(), F.concat(F.lit("no weight is carried, every area counts equally: "), wanted)).when(~has("weight"), F.concat(F.lit("weighted by the fallback: "), F.col("fallback_weight")))
    return joined.select("metric", used.alias("weight_used"), caveat.alias("caveat"))


def group_hazards(facts: DataFrame, memberships: DataFrame, rules: DataFrame) -> DataFrame:
    """case_id, grp, metrics, traders, caveat: groups whose sums count trade between their members twice, one row a group (Q-13).

    A group has the hazard in metrics of trade (``rules.hazard``) of which two of its members or more have values that are not zero.
    ``facts``: case_id, entity, quantity, value. ``memberships``: entity, grp.
    """
    hazards = rules.filter("hazard").select(F.col("metric").alias("quantity"))
    trading = facts.filter(F.col("value") != 0).select("case_id", "entity", "quantity").join(hazards, "quantity", "left_semi").distinct()
    per = trading.join(memberships.select("entity", "grp").distinct(), "entity").groupBy("case_id", "grp", "quantity").agg(F.count(F.lit(1)).alias("traders")).filter("traders > 1")
    found = per.groupBy("case_id", "grp").agg(F.array_sort(F.collect_list("quantity")).alias("metrics"), F.max("traders").alias("traders"))
    caveat = F.concat(F.array_join("metrics", ", "), F.lit(": members that trade with each other are counted twice"))
    return found.withColumn("caveat", caveat)


def coverage_notes(facts: DataFrame, retained: DataFrame, carried: DataFrame) -> DataFrame:
    """src_file, absent: retained columns that a file does not carry (Q-08). ``retained``: name. ``carried``: src_file, name."""
    wanted = F.array_sort(F.collect_set("name")).alias("wanted")
    own = carried.groupBy("src_file").agg(F.collect_set("name").alias("has"))
    files = facts.select("src_file").distinct().join(own, "src_file", "left")
    joined = files.join(F.broadcast(retained.agg(wanted)))  # one row: the names that an import retains
    absent = F.array_except("wanted", F.coalesce("has", F.array().cast("array<string>")))
    return joined.select("src_file", absent.alias("absent")).filter(F.size("absent") > 0)


def entities_without_rows(listed: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """Listed entities of a table that have no row in it (Q-08)."""
    return listed.select(*by, "entity").distinct().join(facts.select(*by, "entity").distinct(), [*by, "entity"], "left_anti")


def resolutions(specs: DataFrame, carried: DataFrame, rules: DataFrame, exported: DataFrame | None = None) -> DataFrame:
    """status and reason of each series asked for (Q-20): resolved, or refused because the case does not carry the quantity,
    it was exported but not retained, a list is needed for its grouping, it has no rule, or it does not combine.

    ``specs``: series_id, case_id, kind, quantity, grouped, and perhaps needs_list and has_list. ``carried`` and ``exported``:
    case_id, kind, quantity. ``rules``: kind, quantity, can_group, reason.
    """
    on = ["case_id", "kind", "quantity"]
    joined = specs.join(carried.select(*on, F.lit(True).alias("_has")).distinct(), on, "left").join(rules.select("kind", "quantity", "can_group", F.col("reason").alias("_why")), ["kind", "quantity"], "left")
    if exported is not None:
        joined = joined.join(exported.select(*on, F.lit(True).alias("_exported")).distinct(), on, "left")
    else:
        joined = joined.withColumn("_exported", F.lit(None).cast("boolean"))
    listless = F.col("needs_list") & ~F.col("has_list") if {"needs_list", "has_list"} <= set(specs.columns) else F.lit(False)
    why = (
        F.when(F.col("_has").isNull() & F.col("_exported"), "exported but not retained")
        .when(F.col("_has").isNull(), "the case does not carry the quantity")
        .when(listless, "the grouping needs a list that is not loaded")
        .when(F.col("grouped") & F.col("can_group").isNull(), "no rule for the unit")
        .when(F.col("grouped") & ~F.col("can_group"), F.col("_why"))
    )
    return joined.select(*specs.columns, F.when(why.isNull(), "resolved").otherwise("refused").alias("status"), why.alias("reason"))
