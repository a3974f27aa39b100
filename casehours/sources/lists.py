"""Reference lists, monthly limits and memberships (S-06 to S-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casehours.functions.cells import boolean, direction, iso_date, normalized, number, zero_is_null
from casehours.operators.groups import bus_id_of, unit_id_norm
from casehours.operators.ranges import NO_LIMIT

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

#: Typed columns of the two lists; every other column stays text.
BUS_LIST = {"BusID": "int", "BaseKV": "float", "Type": "int", "VM": "float", "VA": "float", "Latitude": "zero", "Longitude": "zero", "Monitored": "bool"}
GENERATOR_LIST = {"GeneratorKey": "int", "Bus ID": "int", "Bus KV": "float", "ServiceStatus": "bool", "Commission Date": "date", "Retirement Date": "date", "PSSEMinCap(MW)": "float", "PSSEMaxCap(MW)": "float", "InitialDispatch(MW)": "float", "Save To Binary": "bool", "BTM": "bool", "InternalID": "int", "EconomicPMin": "float", "EconomicPMax": "float"}
KEYS = {"bus_list": "BusID", "generator_list": "Name"}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line of a small text file read whole."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    return whole.select(F.posexplode(F.split("value", r"\r?\n", -1)).alias("line_no", "line"))


def quoted_cells(line):
    """Cells of a line in CSV quoting, as an array."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), 1)
    return F.transform(cells, lambda c: F.regexp_replace(F.regexp_replace(c, r'^\s*"(.*)"\s*$', "$1"), '""', '"'))


def read_list(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A bus or generator list, typed; the first row of a key stays, blank keys go (S-06). Header names are data."""
    kinds, key = (BUS_LIST if name == "bus_list" else GENERATOR_LIST), KEYS[name]
    rows = numbered_lines(spark, path).filter(F.trim("line") != "").select("line_no", quoted_cells(F.col("line")).alias("cells"))
    head = rows.filter(F.exists("cells", lambda c: F.trim(c) == key)).orderBy("line_no").limit(1).first()
    if head is None:
        raise ValueError(f"the list has no column {key}")
    columns, seen = [], set()
    for k, raw in enumerate(head["cells"]):
        if (title := raw.strip()) and title not in seen:
            seen.add(title)
            cell = normalized(F.get("cells", F.lit(k)))
            kind = kinds.get(title)
            value = {"int": lambda c: number(c).cast("int"), "float": number, "zero": lambda c: zero_is_null(number(c)), "bool": boolean, "date": iso_date}.get(kind, lambda c: c)(cell)
            columns.append(value.alias(title))
    body = rows.filter(F.col("line_no") > head["line_no"]).select("line_no", *columns).filter(F.col(f"`{key}`").isNotNull())
    first = Window.partitionBy(f"`{key}`").orderBy("line_no")
    return body.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn", "line_no")


#: Text columns that a list declares besides the typed ones.
DECLARED_TEXT = {"bus_list": ("Name", "LoadArea", "PSSEArea", "PSSEZone"), "generator_list": ("Name", "Bus Name", "Unit ID", "Generator TypeID", "SubType", "Long ID", "Long Name", "DevStatus", "Area Name", "Region Name", "State", "County", "City", "Zipcode", "FuelType", "Technology")}


def list_quality(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One row: rows, blank_keys, repeated_keys, undeclared and missing columns of a list (Q-11)."""
    key, declared = KEYS[name], {*(BUS_LIST if name == "bus_list" else GENERATOR_LIST), *DECLARED_TEXT[name]}
    rows = numbered_lines(spark, path).filter(F.trim("line") != "").select("line_no", quoted_cells(F.col("line")).alias("cells"))
    head = rows.filter(F.exists("cells", lambda c: F.trim(c) == key)).orderBy("line_no").limit(1).first()
    if head is None:
        raise ValueError(f"the list has no column {key}")
    titles = [c.strip() for c in head["cells"]]
    texts = lambda names: F.array(*map(F.lit, sorted(names))).cast("array<string>")
    keys = rows.filter(F.col("line_no") > head["line_no"]).select(normalized(F.get("cells", F.lit(titles.index(key)))).alias("k"))
    counts = keys.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("k").isNull()).alias("blank_keys"), (F.count("k") - F.count_distinct("k")).alias("repeated_keys"))
    return counts.withColumn("undeclared", texts({t for t in titles if t} - declared)).withColumn("missing", texts(declared - set(titles)))


def limit_rows(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Rows of a limits file below its header (line_no, cells, markers, side, interface, place among rows of its interface and side), and the titles."""
    rows = numbered_lines(spark, path).filter(F.trim("line") != "").select("line_no", quoted_cells(F.col("line")).alias("cells"))
    head = rows.filter((F.col("line_no") < 20) & F.forall(F.array(*map(F.lit, MONTHS)), lambda m: F.exists("cells", lambda c: F.trim(c) == m))).orderBy("line_no").limit(1).first()
    if head is None:
        raise ValueError("no header with twelve months in the first 20 lines")
    titles = [c.strip() for c in head["cells"]]
    name_at = titles.index("Interface Name") if "Interface Name" in titles else 0
    upper = F.transform("cells", lambda c: F.upper(F.trim(c)))
    markers = F.filter(F.transform(upper, lambda c, k: F.when(c.isin("MIN", "MAX"), k)), lambda k: k.isNotNull())
    body = rows.filter(F.col("line_no") > head["line_no"]).withColumn("markers", markers).withColumn("side", F.get(upper, F.get(markers, F.lit(0)))).withColumn("interface", F.trim(F.get("cells", F.lit(name_at))))
    return body.withColumn("place", F.row_number().over(Window.partitionBy("interface", "side").orderBy("line_no"))), titles


def _month_cells(titles: list[str]):
    """month and value of the twelve cells of a limits row."""
    return F.array(*[F.struct(F.lit(k + 1).alias("month"), number(F.trim(F.get("cells", F.lit(titles.index(m))))).alias("value")) for k, m in enumerate(MONTHS)])


def read_limits(spark: SparkSession, path: str, scope_case: str | None = None) -> DataFrame:
    """scope_case, interface, side, month, value of monthly limits (S-07): the side is found by value, the year is ignored."""
    rows, titles = limit_rows(spark, path)
    body = rows.filter("side is not null and interface <> '' and place = 1")
    out = body.select(F.lit(scope_case).cast("string").alias("scope_case"), "interface", "side", F.explode(_month_cells(titles)).alias("x"))
    return out.select("scope_case", "interface", "side", "x.month", F.when(F.abs("x.value") <= NO_LIMIT, F.col("x.value")).alias("value"))


#: Fixed value: beginnings of titles of columns that are finer than a month.
FINER_THAN_MONTH = r"(?i)^(week|day|date|hour|he|period|season|start|end)\b"


def limits_layout(spark: SparkSession, path: str) -> DataFrame:
    """One row about a limits file, from its cells: what its layout is and what its rows have (A-28).

    interfaces, rows, duplicate_rows, rows_without_side, rows_without_name, marker_columns (where MIN and MAX stand), marker_title_blank (of
    the only such column), second_markers, distinct_years, finer_columns, blank_cells, no_limit_cells, odd_no_limits (not 99999),
    near_threshold, varying (sides whose limit varies within the year). Cells are those of the rows that are read.
    """
    rows, titles = limit_rows(spark, path)
    read = F.col("side").isNotNull() & (F.col("interface") != "") & (F.col("place") == 1)
    values = F.transform(_month_cells(titles), lambda x: F.abs(x["value"]))
    limits = F.filter(F.transform(_month_cells(titles), lambda x: x["value"]), lambda v: F.abs(v) <= NO_LIMIT)
    year = F.trim(F.get("cells", F.lit(titles.index("Year")))) if "Year" in titles else F.lit(None).cast("string")
    counted = lambda test: F.sum(F.when(read, F.size(F.filter(values, test))).otherwise(0))
    first = F.get("markers", F.lit(0))
    found = rows.agg(
        F.count_distinct(F.when(read, F.col("interface"))).alias("interfaces"),
        F.count_if(read).alias("rows"),
        F.count_if(F.col("side").isNotNull() & (F.col("interface") != "") & (F.col("place") > 1)).alias("duplicate_rows"),
        F.count_if(F.col("side").isNull()).alias("rows_without_side"),
        F.count_if(F.col("side").isNotNull() & (F.col("interface") == "")).alias("rows_without_name"),
        F.count_distinct(F.when(read, first)).alias("marker_columns"),
        F.min(F.when(read, first)).alias("_marker"),
        F.count_if(read & (F.size("markers") > 1)).alias("second_markers"),
        F.count_distinct(F.when(read, year)).alias("distinct_years"),
        counted(lambda v: v.isNull()).alias("blank_cells"),
        counted(lambda v: v > NO_LIMIT).alias("no_limit_cells"),
        counted(lambda v: (v > NO_LIMIT) & (v != 99999)).alias("odd_no_limits"),
        counted(lambda v: v.between(0.9 * NO_LIMIT, NO_LIMIT)).alias("near_threshold"),
        F.count_if(read & (F.size(F.array_distinct(limits)) > 1)).alias("varying"),
    )
    blank = F.when(F.col("marker_columns") == 1, F.get(F.array(*map(F.lit, titles)), "_marker") == "")
    return found.withColumn("marker_title_blank", blank).withColumn("finer_columns", F.size(F.filter(F.array(*map(F.lit, titles)), lambda t: t.rlike(FINER_THAN_MONTH)))).drop("_marker")


def read_membership(spark: SparkSession, path: str, mapping: dict[str, str]) -> DataFrame:
    """src_order and the mapped columns of a membership file (S-08 to S-11): name, bus_id, unit_id, grp, direction."""
    rows = numbered_lines(spark, path).filter(F.trim("line") != "").select("line_no", quoted_cells(F.col("line")).alias("cells"))
    head = [c.strip() for c in rows.orderBy("line_no").first()["cells"]]
    columns = [normalized(F.get("cells", F.lit(head.index(title)))).alias(c) for c, title in mapping.items() if title in head]
    return rows.filter("line_no > 0").select(F.col("line_no").alias("src_order"), *columns)


def area_members(rows: DataFrame) -> DataFrame:
    """entity, grp, coef of Name,Grouping rows (S-08)."""
    return rows.filter("name is not null and grp is not null").groupBy(F.col("name").alias("entity"), "grp").agg(F.min("src_order").alias("src_order")).withColumn("coef", F.lit(1))


def generator_members(rows: DataFrame, units: DataFrame) -> DataFrame:
    """``rows`` with entity and status: by name, or by bus and unit id (S-09, J-03). ``units``: entity, bus_id, unit_id."""
    named = units.select(F.col("entity").alias("_by_name"), F.lit(True).alias("_hit")).distinct()
    index = units.groupBy("bus_id", unit_id_norm(F.col("unit_id")).alias("_unit")).agg(F.array_sort(F.collect_set("entity")).alias("_matches"))
    keyed = rows.withColumn("_bus", bus_id_of(F.col("bus_id"))).withColumn("_unit", unit_id_norm(F.col("unit_id")))
    joined = keyed.drop("bus_id").join(named, F.col("name") == F.col("_by_name"), "left").join(index.withColumnRenamed("bus_id", "_bus"), ["_bus", "_unit"], "left")
    n = F.size(F.coalesce("_matches", F.array().cast("array<string>")))
    status = F.when(F.col("_hit"), "resolved").when(F.col("name").isNotNull() & F.col("_bus").isNull(), "unresolved").when(F.col("_bus").isNull(), "bad bus number").when(F.col("_unit").isNull(), "blank").when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous")
    entity = F.when(F.col("_hit"), F.col("name")).when(n == 1, F.element_at("_matches", 1))
    return joined.select("src_order", "grp", F.when(status == "resolved", entity).alias("entity"), status.alias("status"))


def interface_members(rows: DataFrame) -> DataFrame:
    """entity, grp, coef, refusal of Name,Grouping,Direction rows; a pair with both directions is refused (S-11, T-14)."""
    signed = rows.withColumn("coef", direction(F.col("direction")))
    per = signed.groupBy(F.col("name").alias("entity"), "grp").agg(F.min("src_order").alias("src_order"), F.count_distinct("coef").alias("_n"), F.first("coef", ignorenulls=True).alias("coef"), F.count_if(F.col("coef").isNull()).alias("_bad"))
    refusal = F.when(F.col("_bad") > 0, "unreadable direction").when(F.col("_n") > 1, "both directions")
    return per.select("entity", "grp", "src_order", F.when(refusal.isNull(), F.col("coef")).alias("coef"), refusal.alias("refusal"))
