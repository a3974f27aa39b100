"""Lists, memberships and keys (J-02 to J-04, J-12, J-13, J-15, A-03, A-04, A-24, A-29, A-30, F-15, F-16, U-01, U-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNLISTED, BLANK = "(unlisted)", "(blank)"
MOST_ENUM = 256


def bucket_label(value: Column, listed: Column) -> Column:
    """(unlisted), (blank) or the value (T-15)."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(~F.coalesce(listed, F.lit(False)), UNLISTED).when(text == "", BLANK).otherwise(text)


def with_attributes(entities: DataFrame, listed: DataFrame, columns: list[str], key: str = "entity") -> DataFrame:
    """Entities with bucket labels of list columns; entities without a row stay (J-02)."""
    side = listed.select(key, *columns, F.lit(True).alias("_listed"))
    joined = entities.join(side, key, "left")
    return joined.select(*entities.columns, *[bucket_label(F.col(c), F.col("_listed")).alias(c) for c in columns])


def unit_id_norm(raw: Column) -> Column:
    """Unit ids compare trimmed, in capitals, without leading zeros; a lone 0 stays (T-10)."""
    return F.regexp_replace(F.upper(F.trim(raw)), r"^0+(?=.)", "")


def bus_id_of(raw: Column) -> Column:
    """An integer bus id, perhaps written 101.0; else null (T-10)."""
    return F.regexp_extract(F.trim(raw), r"^(\d+)(?:\.0*)?$", 1).try_cast("int")


def resolve_keys(wanted: DataFrame, index: DataFrame, on: list[str], name: str = "entity") -> DataFrame:
    """``wanted`` with matches, status (resolved, unresolved, ambiguous) and, if one matches, its name (J-03, J-04)."""
    found = index.groupBy(*on).agg(F.array_sort(F.collect_set(name)).alias("matches"))
    joined = wanted.join(found, on, "left").withColumn("matches", F.coalesce("matches", F.array().cast("array<string>")))
    blank = F.coalesce(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), True) for c in on], F.lit(False))
    status = F.when(blank, "blank").when(F.size("matches") == 0, "unresolved").when(F.size("matches") == 1, "resolved").otherwise("ambiguous")
    return joined.withColumn("status", status).withColumn(name, F.when(F.col("status") == "resolved", F.element_at("matches", 1)))


def reverse_memberships(memberships: DataFrame) -> DataFrame:
    """entity, groups (sorted, distinct) (J-13)."""
    return memberships.groupBy("entity").agg(F.array_sort(F.collect_set("grp")).alias("groups"))


def memberships_of(entities: DataFrame, own: DataFrame, area_of: DataFrame, of_areas: DataFrame) -> DataFrame:
    """entity, area, own_groups, area_groups, groups: groups that hold an entity, and groups that hold its area (J-13).

    A group reached both ways is in both lists and once in ``groups``; an entity without area has no groups through it. ``own``: entity,
    grp. ``area_of``: entity, area. ``of_areas``: entity (an area), grp.
    """
    none = F.array().cast("array<string>")
    listed = lambda m, key, name: m.select(F.trim("entity").alias(key), "grp").groupBy(key).agg(F.array_sort(F.collect_set("grp")).alias(name))
    named = area_of.select("entity", F.nullif(F.trim("area"), F.lit("")).alias("area")).groupBy("entity").agg(F.min("area").alias("area"))
    joined = entities.select(F.trim("entity").alias("entity")).distinct().join(listed(own, "entity", "own_groups"), "entity", "left").join(named, "entity", "left").join(listed(of_areas, "area", "area_groups"), "area", "left")
    both = joined.withColumn("own_groups", F.coalesce("own_groups", none)).withColumn("area_groups", F.coalesce("area_groups", none))
    return both.select("entity", "area", "own_groups", "area_groups", F.array_sort(F.array_union("own_groups", "area_groups")).alias("groups"))


def group_coverage(memberships: DataFrame, axis: DataFrame) -> DataFrame:
    """One row: groups, mapped, off_list, unmapped, reversed (A-30, U-04)."""
    m = memberships.select("entity", "grp", "coef")
    names = axis.select("entity").distinct()
    mapped = names.join(m, "entity", "left_semi").agg(F.count(F.lit(1)).alias("mapped"))
    off = m.select("entity").distinct().join(names, "entity", "left_anti").agg(F.count(F.lit(1)).alias("off_list"))
    none = names.join(m, "entity", "left_anti").agg(F.count(F.lit(1)).alias("unmapped"))
    head = m.agg(F.count_distinct("grp").alias("groups"), F.count_if(F.col("coef") < 0).alias("reversed"))
    return head.crossJoin(mapped).crossJoin(off).crossJoin(none)


def overlap_offenders(series_members: DataFrame, area_of: DataFrame) -> DataFrame:
    """Stack members that an area of the same stack contains: case_id, entity, area (J-12).

    ``series_members``: case_id, kind, entity. ``area_of``: entity, area of units and buses.
    """
    norm = lambda c: F.lower(F.trim(c))
    areas = series_members.filter("kind = 'area'").select("case_id", norm(F.col("entity")).alias("_area")).distinct()
    units = series_members.filter("kind <> 'area'").join(area_of, "entity").withColumn("_area", norm(F.col("area")))
    return units.join(areas, ["case_id", "_area"], "left_semi").select("case_id", "entity", "area")


def repeated_series(series_members: DataFrame) -> DataFrame:
    """Series that a stack holds twice (J-12)."""
    return series_members.groupBy("case_id", "kind", "entity").count().filter("count > 1")


def merge_lists(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows stay, new keys are appended, columns new to the list fill known keys (J-15)."""
    first = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in incoming.columns])
    fresh = incoming.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn").select(key, *[F.col(c).alias(f"_new_{c}") for c in incoming.columns if c != key], F.lit(True).alias("_in"))
    old = existing.withColumn("_held", F.lit(True))
    joined = old.join(fresh, key, "full_outer")
    columns = [*existing.columns, *[c for c in incoming.columns if c not in existing.columns]]
    out = []
    for c in columns:
        if c == key:
            out.append(F.col(key))
        elif c in existing.columns and c in incoming.columns:
            out.append(F.when(F.col("_held"), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c))
        elif c in existing.columns:
            out.append(F.col(c))
        else:
            out.append(F.col(f"_new_{c}").alias(c))
    return joined.select(*out)


def merge_report(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """One row: keys added, already known, differing on shared columns (J-15)."""
    shared = [c for c in incoming.columns if c in existing.columns and c != key]
    side = incoming.dropDuplicates([key]).select(key, *[F.col(c).alias(f"_n_{c}") for c in shared], F.lit(True).alias("_in"))
    joined = side.join(existing.select(key, *shared, F.lit(True).alias("_held")), key, "left")
    same = F.lit(True)
    for c in shared:
        same = same & F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    held = F.coalesce("_held", F.lit(False))
    return joined.agg(F.count_if(~held).alias("added"), F.count_if(held).alias("known"), F.count_if(held & ~same).alias("differing"))


def column_kinds(df: DataFrame) -> DataFrame:
    """column, kind of undeclared columns: enum if at most 256 values and 8 rows a value, else text (A-24)."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_distinct(c).alias(c) for c in df.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct")) for c in df.columns]))
    kind = F.when((F.col("distinct") <= MOST_ENUM) & (F.col("distinct") * 8 <= F.col("_rows")), "enum").otherwise("text")
    return counts.select("_rows", pairs.alias("x")).select("x.column", "x.distinct", "_rows").select("column", "distinct", kind.alias("kind"))


def combinable(quantities: DataFrame, rules: DataFrame) -> DataFrame:
    """kind, quantity, unit, class, temporal, can_group, reason: what may be summed over entities (F-16, A-26, T-09).

    ``quantities``: kind, quantity. ``rules``: kind, unit, class, temporal.
    """
    unit = F.regexp_extract("quantity", r"\(([^()]*)\)[^()]*$", 1)
    joined = quantities.withColumn("unit", unit).join(rules, ["kind", "unit"], "left")
    can = F.coalesce(F.col("class").isin("EXTENSIVE", "RATE"), F.lit(False))
    reason = F.when(F.col("class").isNull(), "no rule for the unit").when(~can, "an intensive quantity does not add up over entities")
    return joined.select("kind", "quantity", "unit", "class", F.coalesce("temporal", F.lit("MEAN")).alias("temporal"), can.alias("can_group"), reason.alias("reason"))


def union_of_names(carried: DataFrame) -> DataFrame:
    """name, src_order: union over files in first-seen order (U-01). ``carried``: name, src_order."""
    return carried.groupBy("name").agg(F.min("src_order").alias("src_order"))


def entity_files(carried: DataFrame) -> DataFrame:
    """entity, files, in_every: which files carry each entity (A-25)."""
    total = carried.agg(F.count_distinct("src_file").alias("_total"))
    return carried.groupBy("entity").agg(F.array_sort(F.collect_set("src_file")).alias("files")).crossJoin(F.broadcast(total)).select("entity", "files", (F.size("files") == F.col("_total")).alias("in_every"))


def inventory(facts: DataFrame, kinds: list[str]) -> DataFrame:
    """A row a case with the files behind each kind's tables (A-29)."""
    return facts.groupBy("case_id").pivot("kind", kinds).agg(F.array_sort(F.collect_set("src_file")))


def source_counts(kept: DataFrame, in_source: DataFrame) -> DataFrame:
    """case_id, kind, src_file, kept, in_source: entities that a file's table keeps against those its header names (A-29).

    ``kept``: case_id, kind, src_file, entity. ``in_source``: src_file, name.
    """
    own = kept.groupBy("case_id", "kind", "src_file").agg(F.count_distinct("entity").alias("kept"))
    return own.join(in_source.groupBy("src_file").agg(F.count_distinct("name").alias("in_source")), "src_file", "left")
