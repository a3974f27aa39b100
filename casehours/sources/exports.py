"""Hourly exports as rows of facts, unreadable rows counted by cause (S-02, S-03, S-05, Q-01, Q-02, J-01, F-14).

Lines are read as text and split; positions unpivot by posexplode and join the header by position, so thousands of columns
never become a schema. A blank cell, and the missing end of a short row, is a row whose value is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casehours.functions import calendar as cal
from casehours.functions.cells import export_date, hour_ending, time_of_use, value_cell, value_is_bad
from casehours.session import written

KEY_COLUMNS = {"area": 1, "bus": 3, "generator": 3}

#: Files that have a header in common have this in common.
HEADER_COLUMNS = ("kind", "columns", "key_ids")


def _lines(spark: SparkSession, files: DataFrame, shape: str) -> DataFrame:
    """path-less lines of the files of a shape, with what the catalog says of their file; no rows without such files."""
    chosen = files.filter((F.col("shape") == shape) & F.col("reason").isNull())
    paths = [r["path"] for r in chosen.select("path").collect()]  # names of files, not data
    if paths:
        text = spark.read.text(paths).select(F.regexp_replace("value", r"\r$", "").alias("line"), F.col("_metadata.file_path").alias("path"))
    else:
        text = spark.createDataFrame([], "line string, path string")
    meta = chosen.select(F.col("path"), "src_file", "case_id", "kind", "quantity", "first_year", "last_year", "src_rank", F.xxhash64(*HEADER_COLUMNS).alias("header"), F.size("columns").alias("width"))
    bare = F.regexp_replace("path", r"^file:/+", "/")
    return text.withColumn("_p", bare).drop("path").join(meta.withColumn("_p", bare).drop("path"), "_p").withColumn("cells", F.split("line", ",", -1))


def header_positions(files: DataFrame, shape: str, retained: list[str] | None = None) -> DataFrame:
    """src_file, pos, name: the columns by position, first of equal names, retained ones only (J-01, F-14)."""
    chosen = files.filter((F.col("shape") == shape) & F.col("reason").isNull())
    pos = chosen.select("src_file", "kind", "key_ids", F.posexplode("columns").alias("pos", "name"))
    keys = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in KEY_COLUMNS.items()], F.lit(0)) if shape == "long" else F.lit(0)
    own = pos.filter((F.col("pos") >= 3 + keys) & (F.col("name") != ""))
    if shape == "wide":
        own = own.withColumn("name", F.when(F.col("kind") == "bus", F.regexp_extract(F.get("key_ids", F.col("pos")), r"^(\d+)", 1)).otherwise(F.col("name")))
    own = own.groupBy("src_file", "name").agg(F.min("pos").alias("pos"))
    return own.filter(F.col("name").isin(*retained)) if retained is not None else own


def _parsed(lines: DataFrame) -> DataFrame:
    date, he = export_date(F.get("cells", F.lit(0))), hour_ending(F.get("cells", F.lit(1)))
    rows = lines.filter(F.trim("line") != "").withColumn("date", date).withColumn("he", he).withColumn("tou", time_of_use(F.get("cells", F.lit(2))))
    return rows.withColumn("year", F.year("date")).withColumn("slot_hour", cal.slot_hour("date", "he"))


def _cause(rows: DataFrame, extra: list[tuple[Column, str]]) -> DataFrame:
    out_of_span = F.col("first_year").isNotNull() & ~F.col("year").between(F.col("first_year"), F.col("last_year"))
    ladder = F.when(F.col("date").isNull() | F.col("he").isNull() | (F.size("cells") < 3), "bad date or hour").when(out_of_span, "out of span")
    for condition, name in extra[:1]:
        ladder = ladder.when(condition, name)
    ladder = ladder.when(F.col("tou").isNull(), "bad time of use")
    for condition, name in extra[1:]:
        ladder = ladder.when(condition, name)
    return rows.withColumn("cause", ladder)


FACTS = ["case_id", "kind", "quantity", "entity", "year", "slot_hour", "value", "tou", "src_file", "src_rank"]


def header_names(files: DataFrame, shape: str, retained: list[str] | None = None) -> DataFrame:
    """header, names: for each different header of the files the names by position, null where there is none or it is not retained."""
    one = files.withColumn("src_file", F.xxhash64(*HEADER_COLUMNS).cast("string")).dropDuplicates(["src_file", "shape"])
    at = F.map_from_entries(F.collect_list(F.struct("pos", "name")))
    named = header_positions(one, shape, retained).groupBy("src_file").agg(at.alias("at"), F.max("pos").alias("last"))
    return named.select(F.col("src_file").cast("long").alias("header"), F.transform(F.sequence(F.lit(0), "last"), lambda p: F.try_element_at("at", p)).alias("names"))


def _unpivoted(rows: DataFrame, names: DataFrame) -> DataFrame:
    """A row for each named cell of each row; a cell that the row lacks is null.

    A line meets the names of its header once, and what is exploded carries neither.
    """
    kept = [c for c in rows.columns if c not in ("cells", "line", "header")]
    cells = F.transform("names", lambda name, p: F.struct(name.alias("name"), F.get("cells", p).alias("raw")))
    return rows.join(names, "header").select(*kept, F.explode(F.filter(cells, lambda x: x["name"].isNotNull())).alias("x")).select(*kept, "x.name", "x.raw")


def read_wide(spark: SparkSession, files: DataFrame, retained: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Facts of wide exports, and quality rows (src_file, cause, rows)."""
    files = written(files, "catalog")  # each file is opened once
    rows = _parsed(_lines(spark, files, "wide")).filter(F.get("cells", F.lit(0)).rlike(r"^\s*\d"))
    beyond = F.exists(F.slice("cells", F.col("width") + 1, F.greatest(F.size("cells") - F.col("width"), F.lit(0))), lambda c: F.trim(c) != "")
    bad = F.exists(F.slice("cells", 4, F.greatest(F.size("cells") - 3, F.lit(0))), value_is_bad)
    rows = _cause(rows, [(F.lit(False), ""), (beyond, "field beyond the header"), (bad, "bad cell")])
    facts = _unpivoted(rows.filter("cause is null"), header_names(files, "wide", retained)).withColumn("value", value_cell(F.col("raw"))).withColumn("entity", F.col("name"))
    return facts.select(*FACTS), rows.filter("cause is not null").groupBy("src_file", "cause").agg(F.count(F.lit(1)).alias("rows"))


def read_long(spark: SparkSession, files: DataFrame, retained: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Facts of long exports, and quality rows. The entity is the area name, the bus id or the unit name."""
    files = written(files, "catalog")  # each file is opened once
    rows = _parsed(_lines(spark, files, "long")).filter(F.trim(F.get("cells", F.lit(0))) != "Date")
    raw = F.trim(F.get("cells", F.lit(3)))
    entity = F.when(F.col("kind") == "bus", F.regexp_extract(raw, r"^(\d+)(?:\.0*)?$", 1)).otherwise(raw)
    rows = rows.withColumn("entity", entity)
    first = F.coalesce(*[F.when(F.col("kind") == k, F.lit(3 + n)) for k, n in KEY_COLUMNS.items()])
    bad = F.exists(F.slice("cells", first + 1, F.greatest(F.size("cells") - first, F.lit(0))), value_is_bad)
    rows = _cause(rows, [(F.coalesce(F.col("entity"), F.lit("")).rlike(r'^$|"'), "blank or quoted id"), (F.size("cells") != F.col("width"), "ragged row"), (bad, "bad cell")])
    facts = _unpivoted(rows.filter("cause is null"), header_names(files, "long", retained)).withColumn("value", value_cell(F.col("raw"))).withColumn("quantity", F.col("name"))
    return facts.select(*FACTS), rows.filter("cause is not null").groupBy("src_file", "cause").agg(F.count(F.lit(1)).alias("rows"))


def ranked_files(files: DataFrame) -> DataFrame:
    """``files`` with src_rank, the order in which they own cells."""
    from pyspark.sql import Window

    return files.withColumn("src_rank", F.row_number().over(Window.partitionBy("case_id", "kind").orderBy("src_file")))


def axis_scan(facts: DataFrame) -> DataFrame:
    """src_file, year, rows, entities: what the rows carry (A-23)."""
    rows = F.expr("count(1) div count(distinct quantity)")  # a row has a fact for each quantity
    return facts.groupBy("src_file", "year").agg(rows.alias("rows"), F.count_distinct("entity").alias("entities"))


def table_hours(facts: DataFrame) -> DataFrame:
    """case_id, kind, quantity, year, slot_hour, tou: the first file's label of each hour."""
    return facts.groupBy("case_id", "kind", "quantity", "year", "slot_hour").agg(F.min(F.struct("src_rank", "tou")).alias("_t")).select("case_id", "kind", "quantity", "year", "slot_hour", F.col("_t.tou").alias("tou"))
