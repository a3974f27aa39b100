"""Ranked tables: natural order, blanks last, distinct values, caps and labels (O-01 to O-05, T-17 to T-24, K-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casehours.functions import calendar as cal

WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
CHECKLIST, MOST_SERIES, MOST_OVERLAY, MOST_SCALES = 100, 10, 30, 2


def natural_key(text: Column) -> Column:
    """Sort key by which Case 2 comes before Case 10."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 12, "0")).otherwise(x)), "")


def sorted_table(rows: DataFrame, column: str, descending: bool = False, tie: str = "row_ix") -> DataFrame:
    """Rows by one column, blanks last in both directions, ties in original order (O-01)."""
    key = F.col(column)
    if dict(rows.dtypes)[column] == "string":
        key = F.when(F.trim(key) != "", natural_key(key))
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), tie)


def ranked_table(rows: DataFrame, by: list[str], column: str, tie: str, descending: bool = True) -> DataFrame:
    """``rows`` with rank by a column within ``by``: blanks last, ties by natural order of ``tie``."""
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(key, natural_key(F.col(tie)), tie)))


def distinct_values(rows: DataFrame, column: str, most: int = CHECKLIST) -> DataFrame:
    """The first distinct cells of a column in natural order, blank last (O-02: the list is capped by design)."""
    cells = rows.select(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))).alias("value")).distinct()
    return cells.orderBy(F.when(F.col("value") != "", natural_key(F.col("value"))).asc_nulls_last(), "value").limit(most)


def cap_refusals(series: int = 0, overlay_lines: int = 0, scales: int = 0) -> list[str]:
    """Why so many series, overlaid lines or scales are refused (O-04)."""
    out = []
    if series > MOST_SERIES:
        out.append(f"{series} series; at most {MOST_SERIES} are drawn")
    if overlay_lines > MOST_OVERLAY:
        out.append(f"{overlay_lines} lines; at most {MOST_OVERLAY} are overlaid")
    if scales > MOST_SCALES:
        out.append(f"{scales} scales; at most {MOST_SCALES} are drawn")
    return out


def cap_refusal(n: Column, what: str, done: str, most: int) -> Column:
    """Why so many are refused; null within the cap (O-04)."""
    return F.when(n > most, F.concat(n.cast("string"), F.lit(f" {what}; at most {most} are {done}")))


def displayed(value: Column, cell_class: str = "quantity") -> Column:
    """The displayed cell of a quantity, a ratio or a count: whole numbers, halves up; what is not zero never shows as 0 (T-17)."""
    v = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    whole = F.floor((v * 100 if cell_class == "ratio" else v) + 0.5)
    if cell_class == "count":
        return F.when(v.isNull(), "").otherwise(whole.cast("string"))
    sign = "%" if cell_class == "ratio" else ""
    text = F.concat(whole.cast("string"), F.lit("%")) if cell_class == "ratio" else F.format_number(whole, 0)
    hidden = (v != 0) & (whole == 0)
    return F.when(v.isNull(), "").when(hidden & (v > 0), f"<1{sign}").when(hidden, f">-1{sign}").otherwise(text)


#: Digits of a single-precision number: tried in turn until the text reads back as the same number.
CELL_DIGITS = (7, 8, 9)
#: Numbers from here on have an exponent, and so have those below the other.
BARE_BELOW, POINT_FROM = 1e9, 1e-6


def cell_text(value: Column) -> Column:
    """The text of a single-precision number: whole ones bare, else the first of 7, 8 or 9 digits that reads back; blank if null, NaN or infinite (T-18).

    No lambdas in here nor in :func:`percent_text_as_ratio`: Spark compiles what it would otherwise interpret, and each text is
    read once. A ``value`` that is dear should be a column of its own.
    """
    v = value.cast("float")
    wide = v.cast("double")
    tried = {n: F.format_string(f"%.{n - 1}e", wide) for n in CELL_DIGITS}
    digits = F.coalesce(*(F.when(tried[n].cast("double").cast("float") == v, tried[n]) for n in CELL_DIGITS[:-1]), tried[CELL_DIGITS[-1]])
    whole = (F.abs(wide) < BARE_BELOW) & (F.floor(wide) == wide)
    blank = v.isNull() | F.isnan(v) | (F.abs(wide) == float("inf"))
    # a single with a fraction is below 2^23, so seven places before the point and fourteen after it hold all digits
    plain = F.rtrim(digits.cast("decimal(21,14)").cast("string"), F.lit("0"))
    raised = F.regexp_replace(digits, r"\.?0*e([+-])0*", "e$1")
    pointed = (F.abs(wide) < BARE_BELOW) & (F.abs(v) >= F.lit(POINT_FROM).cast("float"))
    return F.when(blank, "").when(whole, wide.cast("long").cast("string")).when(pointed, plain).otherwise(raised)


def percent_text_as_ratio(text: Column) -> Column:
    """The text of a percent as its ratio: the point moves two places to the left, or the exponent falls by two (T-18)."""
    power = F.when(F.contains(text, F.lit("e")), F.regexp_extract(text, "e(.*)$", 1).try_cast("int") - 2)
    raised = F.concat(F.regexp_extract(text, "^[^e]*", 0), F.lit("e"), F.when(power < 0, "").otherwise("+"), power.cast("string"))
    # zeros in front, so that two digits and one more are there; the point two places to the left; then zeros at both ends go, and the sign of zero
    padded = F.regexp_replace(text, r"(?s)^(-?)([0-9]*)[^.]*(?:\.([^e]*).*)?$", "$1000$2.$3")
    moved = F.regexp_replace(padded, r"^(-?[0-9]*)([0-9]{2})\.", "$1.$2")
    out = F.regexp_replace(moved, r"^-(?=[0.]*$)|(?<=^-?)0+(?=[0-9])|\.?0+$", "")
    return F.when(text == "", "").when(power.isNotNull(), raised).otherwise(out)


def ratio_text(percent: Column) -> Column:
    """A single-precision percent as the text of its ratio (T-18)."""
    return percent_text_as_ratio(cell_text(percent))


def bus_label(name: Column, bus_id: Column) -> Column:
    """NAME (id), or bus id when it has no name (T-19)."""
    return F.when(F.trim(F.coalesce(name, F.lit(""))) != "", F.concat(name, F.lit(" ("), bus_id.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("bus "), bus_id.cast("string")))


def scale_of(unit: Column) -> Column:
    """MW is drawn on the scale of MWh (T-20)."""
    return F.when(unit == "MW", "MWh").otherwise(unit)


def scale_labels(units: DataFrame) -> DataFrame:
    """scale, label: the units that share a scale, joined in the order of their names (T-20). ``units``: unit."""
    return units.select("unit", scale_of(F.col("unit")).alias("scale")).distinct().groupBy("scale").agg(F.array_join(F.array_sort(F.collect_list("unit")), " / ").alias("label"))


def unit_of(quantity: Column) -> Column:
    """The unit in the last parentheses of a quantity (T-09)."""
    return F.regexp_extract(quantity, r"\(([^()]*)\)[^()]*$", 1)


def prefix_of(name: Column) -> Column:
    """The leading token of an interface name: letters, perhaps a space, digits, before a space or underscore; else four characters (T-16)."""
    token = F.regexp_extract(F.trim(name), r"^([A-Za-z]+ ?\d*)[\s_]", 1)
    return F.when(token != "", token).otherwise(F.substring(F.trim(name), 1, 4))


def year_runs(years: DataFrame, by: list[str]) -> DataFrame:
    """Runs of years as text: 2030-2031, 2033 (T-21)."""
    w = Window.partitionBy(*by).orderBy("year")
    runs = years.select(*by, "year").distinct().withColumn("_run", F.col("year") - F.row_number().over(w)).groupBy(*by, "_run").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    return runs.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ", ").alias("years"))


def day_label(slot_day: Column) -> Column:
    """Feb 20 (T-21)."""
    return F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), slot_day.cast("int")), "MMM d")


def range_label(first_day: Column, last_day: Column) -> Column:
    """Feb 20 - Mar 10 with an en dash, days in either order and kept inside the year; one day alone (T-21)."""
    inside = lambda day: F.least(F.greatest(day, F.lit(0)), F.lit(cal.SLOT_DAYS - 1))
    a, b = inside(F.least(first_day, last_day)), inside(F.greatest(first_day, last_day))
    return F.when(a == b, day_label(a)).otherwise(F.concat(day_label(a), F.lit(" \u2013 "), day_label(b)))


def axis_label(period: str, axis_hour: Column) -> Column:
    """HE 18, Tue HE 18 or day 12 HE 18: an hour on the axis of a day, a week or a month (T-21)."""
    he = F.concat(F.lit("HE "), (axis_hour % 24 + 1).cast("int").cast("string"))
    day = F.floor(axis_hour / 24).cast("int")
    if period == "day":
        return he
    if period == "week":
        return F.concat(F.element_at(F.array(*map(F.lit, WEEKDAYS)), day + 1), F.lit(" "), he)
    if period == "month":
        return F.concat(F.lit("day "), (day + 1).cast("string"), F.lit(" "), he)
    raise ValueError("period is day, week or month")


def span_hour_label(first_year: Column, axis_hour: Column) -> Column:
    """4000 of 2031 (Jun 15, hour ending 17): an hour of a span of years (T-21)."""
    slot = (axis_hour % cal.SLOT_HOURS).cast("int")
    year = (first_year + F.floor(axis_hour / cal.SLOT_HOURS)).cast("int")
    return F.concat(slot.cast("string"), F.lit(" of "), year.cast("string"), F.lit(" ("), day_label(F.floor(slot / 24)), F.lit(", hour ending "), (slot % 24 + 1).cast("string"), F.lit(")"))


def member_signature(members: Column) -> Column:
    """A digest of a set of members, whatever their order (T-22)."""
    return F.sha2(F.concat_ws("\u001f", F.array_sort(members)), 256)


def row_id(*parts: Column) -> Column:
    return F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def series_names(entries: DataFrame, facets: list[str], order: str) -> DataFrame:
    """``entries`` with name: the facets that tell them apart, made unique by position (K-07, U-03)."""
    spread = entries.agg(*[(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))) > 1).alias(f"_d_{c}") for c in facets])
    joined = entries.crossJoin(F.broadcast(spread))
    name = F.concat_ws(" ", *[F.when(F.col(f"_d_{c}"), F.col(c).cast("string")) for c in facets])
    named = joined.withColumn("name", F.when(name == "", F.col(facets[-1]).cast("string")).otherwise(name)).drop(*[f"_d_{c}" for c in facets])
    place = F.row_number().over(Window.partitionBy("name").orderBy(order))
    return named.withColumn("_n", place).withColumn("name", F.when(F.col("_n") > 1, F.concat(F.col("name"), F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise(F.col("name"))).drop("_n")


def filter_label(years=None, date_runs=None, hours_ending=None, weekdays=None, seasons=None, tou=None) -> str:
    """The text of an hour filter for a descriptor (T-23)."""
    parts = []
    for name, value in (("years", years), ("days", date_runs), ("HE", hours_ending), ("weekdays", weekdays), ("seasons", seasons)):
        if value is not None:
            parts.append(f"{name} {', '.join('-'.join(map(str, v)) if isinstance(v, tuple) else str(v) for v in value)}")
    if tou:
        parts.append(tou)
    return "; ".join(parts) or "all hours"
