"""Tables, extracts and studies on disk (K-01 to K-07, S-15)."""

from __future__ import annotations

import re
import uuid

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casehours.functions import calendar as cal
from casehours.operators.browse import cell_text
from casehours.session import ship

MOST_COLUMNS = 16_380
STUDY_TABLES = ("facts", "table_hours", "bus_list", "generator_list", "memberships", "limits", "inventory")


def write_table(rows: DataFrame, path: str, order: list, descriptor: dict[str, str]) -> None:
    """A statistics table as CSV, its part files in sort order, and its descriptor lines beside it (K-01)."""
    rows.orderBy(*order).write.mode("overwrite").option("header", "true").csv(f"{path}/rows")
    lines = [(k, f"# {a}: {b}") for k, (a, b) in enumerate(descriptor.items())]
    rows.sparkSession.createDataFrame(lines, "k int, value string").orderBy("k").coalesce(1).select("value").write.mode("overwrite").text(f"{path}/descriptor")


def hourly_wide(series: DataFrame, names: list[tuple[str, int]], spark: SparkSession) -> DataFrame:
    """month, day, he and a column per series and year over 8,784 slot hours; a phantom is blank (K-02)."""
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"{len(names)} columns; a sheet holds {MOST_COLUMNS}")
    several = len({y for _, y in names}) > 1
    titles = [f"{s} {y}" if several else s for s, y in names]
    title = F.concat_ws(" ", "series", F.col("year").cast("string")) if several else F.col("series")
    shown = series.join(spark.createDataFrame(names, "series string, year int"), ["series", "year"], "left_semi").filter(~cal.is_phantom())
    wide = shown.withColumn("_title", title).groupBy("slot_hour").pivot("_title", titles).agg(F.max("value"))
    base = spark.range(cal.SLOT_HOURS).select(F.col("id").cast("int").alias("slot_hour"))
    return base.join(wide, "slot_hour", "left").select(cal.month_of().alias("month"), cal.monthday_of().alias("day"), cal.he_of().alias("he"), "slot_hour", *[F.col(f"`{t}`") for t in titles]).orderBy("slot_hour")


def hourly_long(series: DataFrame, spark: SparkSession, first_year: int, years: int, kept=None) -> DataFrame:
    """series, year, month, day, he, hour_of_year, value: a masked hour is a blank cell, never a missing row (K-03)."""
    names = series.select("series").distinct()
    real = cal.calendar(spark, first_year, years).filter("not phantom")
    dense = names.crossJoin(F.broadcast(real)).join(series.select("series", "year", "slot_hour", "value"), ["series", "year", "slot_hour"], "left")
    value = F.when(kept, F.col("value")) if kept is not None else F.col("value")
    hour_of_year = (F.dayofyear(cal.date_of()) - 1) * 24 + F.col("he")
    return dense.select("series", "year", "month", "day", "he", hour_of_year.alias("hour_of_year"), F.nullif(cell_text(value), F.lit("")).alias("value"))


def window_extract(wide: DataFrame, first: int, last: int, columns: list[str]) -> DataFrame:
    """Rows of a visible window; hours blank in every column are left out (K-06)."""
    return wide.filter(F.col("slot_hour").between(first, last) & F.coalesce(*[F.col(f"`{c}`") for c in columns]).isNotNull())


def write_memberships(memberships: DataFrame, path: str) -> None:
    """Name,Grouping,Direction in insertion order, unresolved rows included (K-04)."""
    rows = memberships.orderBy("src_order").select(F.col("entity").alias("Name"), F.col("grp").alias("Grouping"), F.when(F.col("coef") < 0, "reversed").otherwise("forward").alias("Direction"))
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_texts(files: DataFrame, directory: str) -> DataFrame:
    """Write a text file for every row of ``files`` (name, text) under ``directory``; gives name, bytes.

    A file gets its name when it is whole, so that a retried task leaves one.
    """
    def write(batches):
        for batch in batches:
            fs, where = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", directory))
            fs.create_dir(where, recursive=True)
            sizes = []
            for name, text in zip(batch["name"], batch["text"], strict=True):
                passing = f"{where}/.{name}.{uuid.uuid4().hex[:8]}"
                with fs.open_output_stream(passing, compression=None) as out:
                    out.write(text.encode())
                fs.move(passing, f"{where}/{name}")
                sizes.append(len(text.encode()))
            yield pd.DataFrame({"name": batch["name"], "bytes": sizes})

    ship(files.sparkSession)
    return files.select("name", "text").mapInPandas(write, "name string, bytes long")


def save_study(path: str, **tables: DataFrame) -> None:
    """Facts by case, kind and year, and the small tables, as Parquet; saving again replaces the partitions saved (K-05)."""
    for name, df in tables.items():
        if name not in STUDY_TABLES:
            raise ValueError(f"a study has no table {name}")
        if name == "facts":
            df.repartition("case_id", "kind", "year").sortWithinPartitions("quantity", "entity", "slot_hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id", "kind", "year").parquet(f"{path}/facts")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_study(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of a saved study (S-15)."""
    return spark.read.parquet(f"{path}/{name}")
