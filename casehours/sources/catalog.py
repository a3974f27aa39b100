"""What export files are, from their first lines, whole however wide (S-01, S-04, S-13, S-14)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casehours.session import ship

#: Lines of a file that are looked at: banners stand in the first 20, titles, ids and headers before.
PROBE_LINES = 20
#: Bytes that are read at a time.
PROBE_BYTES = 1 << 16

#: Key columns of long exports, longest first, and title words of wide ones.
LONG_KEYS = (("bus", ("Date", "Hour", "TOU", "BusID", "BusName", "Area")), ("generator", ("Date", "Hour", "TOU", "UnitName", "BusID", "UnitID")), ("area", ("Date", "Hour", "TOU", "Name")))
WIDE_KINDS = ("area", "interface", "bus", "generator")
LIMITS_BANNER, LIST_BANNERS = "INTERFACELIMITSCHEDULE_MONTHLY", {"BUS_GENERAL": "bus_list", "GENERATORLIST": "generator_list"}

#: Marks of a saved study's descriptor and of a file of edited groups.
STUDY_MAGIC, GROUPS_BANNER = "casehours study", "# groups"

_TITLE = re.compile(r"^\s*\"?(\w+) Hourly '(.+)' Data for Year (\d{4})", re.I)
_SPAN = re.compile(r"first hour of (\d{1,2}/\d{1,2}/(\d{4})) to the last hour of (\d{1,2}/\d{1,2}/(\d{4}))", re.I)

SCHEMA = "path string, src_file string, kind string, shape string, quantity string, first_year int, last_year int, columns array<string>, key_ids array<string>, reason string"


def cells_of(line: str) -> list[str]:
    return [c.strip() for c in line.rstrip("\r").split(",")]


def classify(head: str) -> dict:
    """kind, shape, quantity, years, columns (by position), key_ids (bus numbers by position), reason of a refusal."""
    lines = head.lstrip("﻿").split("\n")
    out = {"kind": None, "shape": None, "quantity": None, "first_year": None, "last_year": None, "columns": [], "key_ids": [], "reason": None}
    first = cells_of(lines[0])
    found = []
    if any(LIMITS_BANNER in x.upper() for x in lines[:PROBE_LINES]):
        found.append(("interface", "limits"))
    for banner, name in LIST_BANNERS.items():
        if any(banner in x.upper() for x in lines[:2]) and not any(cells_of(x)[0] == "Date" for x in lines[:3]):
            found.append((name, "list"))
    if first[:1] == ["Date"]:
        for kind, keys in LONG_KEYS:
            if tuple(first[: len(keys)]) == keys:
                found.append((kind, "long"))
                out["columns"] = first
                break
        else:
            out["reason"] = "no long export has these key columns"
    elif first and first[0].startswith(GROUPS_BANNER):
        found.append(("groups", "groups"))
    elif lines[0].startswith(STUDY_MAGIC):
        found.append(("study", "study"))
    elif "Grouping" in first:
        found.append(("membership", "membership"))
        out["columns"] = first
    if m := _TITLE.match(lines[0]):
        kind = m[1].lower()
        if kind in WIDE_KINDS:
            found.append((kind, "wide"))
            out |= {"quantity": m[2], "first_year": int(m[3]), "last_year": int(m[3])}
            for line in lines[1:8]:
                if s := _SPAN.search(line):
                    out |= {"first_year": int(s[2]), "last_year": int(s[4])}
                cells = cells_of(line)
                if len(cells) > 2 and cells[2] == "BusNumber":
                    out["key_ids"] = cells
                if cells[:3] == ["Date", "Hour", "TOU"]:
                    out["columns"] = cells
            if not out["columns"]:
                out["reason"] = "no header row"
            elif kind == "bus":
                out["reason"] = bus_ids_refusal(out["key_ids"])
        else:
            out["reason"] = f"an unknown kind: {m[1]}"
    if len(found) > 1:
        out["reason"] = "two shapes match"
    elif not found and not out["reason"]:
        out["reason"] = "no known shape"
    if found:
        out["kind"], out["shape"] = found[0]
    return out


def bus_ids_refusal(ids: list[str]) -> str | None:
    """Why a wide bus export's id row is refused (S-05, Q-11)."""
    own = [c for c in ids[3:] if c]
    if not own:
        return "the bus id row is missing"
    if any(not re.fullmatch(r"\d+(\.0*)?", c) for c in own):
        return "a bus id is no integer"
    if len({c.split(".")[0] for c in own}) != len(own):
        return "a bus id repeats"
    return None


def head_of(path: str) -> bytes:
    """The first lines of a file, each whole."""
    fs, where = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    parts, lines = [], 0
    with fs.open_input_stream(where, compression=None) as stream:
        while lines < PROBE_LINES and (piece := stream.read(PROBE_BYTES)):
            parts.append(piece)
            lines += piece.count(b"\n")
    return b"\n".join(b"".join(parts).split(b"\n", PROBE_LINES)[:PROBE_LINES])


def catalog(spark: SparkSession, paths: list[str] | str, case_pattern: str | None = None) -> DataFrame:
    """One row per file under ``paths``: its shape and what it carries, plus case_id from the file name (S-13).

    ``case_pattern`` is a name with one ``*``, which stands for the case, and ``?`` for other characters that differ; without a match the stem is the case.
    """
    ship(spark)
    # the content is not selected, so Spark lists the files alone; a task opens a file and reads its first lines
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path")

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": p, "src_file": unquote(p.rsplit("/", 1)[-1]), **classify(head_of(p).decode("utf-8", "replace"))} for p in batch["path"]]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    found = files.mapInPandas(probe, SCHEMA)
    stem = F.regexp_replace("src_file", r"\.[^.]*$", "")
    case = stem
    if case_pattern and case_pattern.count("*") == 1:
        a, b = (re.escape(x).replace(r"\?", ".") for x in case_pattern.split("*"))
        named = F.regexp_extract("src_file", f"^{a}(.*){b}$", 1)
        case = F.when(named != "", named).otherwise(stem)
    return found.withColumn("case_id", case)


SLOT = ["case_id", "kind", "quantity"]


def _slots(files: DataFrame) -> DataFrame:
    """Tables that the files build: case_id, kind, quantity, files, shapes."""
    tables = files.filter("reason is null and shape in ('long', 'wide')")
    return tables.groupBy("case_id", "kind", F.when(F.col("kind") != "area", F.col("quantity")).alias("quantity")).agg(
        F.array_sort(F.collect_set("src_file")).alias("files"), F.count_distinct("shape").alias("_shapes"), F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"),
    )


def import_plan(files: DataFrame) -> DataFrame:
    """Tables that the files build: case_id, kind, quantity, files, conflict (S-14)."""
    conflict = F.when(F.col("_shapes") > 1, "long and wide files in one table").when((F.col("kind") == "interface") & F.col("quantity").isNull(), "the quantity is not stated")
    return _slots(files).withColumn("conflict", conflict).select(*SLOT, "files", "conflict")


def import_actions(files: DataFrame, held: DataFrame, mode: str = "add") -> DataFrame:
    """What an import does to a study, a row a table (S-14).

    case_id, kind, quantity, case_is_new, action (create, add, replace), files, merges, conflict, note, years (partitions of the study that are
    written anew). Several files of one table merge, unless their shapes differ or the quantity of interface files was not
    read. Only a replaced table that covers a part of its hours has a note. ``files``: a catalog. ``held``: case_id, kind, quantity,
    first_year, last_year, hours_seen, real_hours of the study's tables.
    """
    if mode not in ("add", "replace"):
        raise ValueError("mode is add or replace")
    slots = _slots(files).withColumnsRenamed({"first_year": "file_first", "last_year": "file_last"})
    cases = held.select("case_id").distinct().withColumn("_known", F.lit(True))
    tables = held.select(*(F.col(c).alias(f"held_{c}") for c in SLOT), "first_year", "last_year", "hours_seen", "real_hours", F.lit(True).alias("_held"))
    on = [F.col(c).eqNullSafe(F.col(f"held_{c}")) for c in SLOT]
    joined = slots.join(tables, on[0] & on[1] & on[2], "left").join(cases, "case_id", "left")
    several = F.size("files") > 1
    conflict = F.when(several & (F.col("_shapes") > 1), "the files differ in shape").when(several & (F.col("kind") == "interface") & F.coalesce(F.col("quantity") == "", F.lit(True)), "the files' quantity was not read")
    action = F.when(F.col("_held").isNull(), "create").otherwise(mode)
    partial = (action == "replace") & (F.col("hours_seen") < F.col("real_hours"))
    note = F.when(partial, F.concat(F.lit("replaces "), F.col("hours_seen").cast("string"), F.lit(" of "), F.col("real_hours").cast("string"), F.lit(" hours; add keeps them")))
    # a replaced table loses the years that it had; an addition writes those of its files
    first = F.when(action == "replace", F.least("file_first", "first_year")).otherwise(F.col("file_first"))
    last = F.when(action == "replace", F.greatest("file_last", "last_year")).otherwise(F.col("file_last"))
    years = F.when(conflict.isNull() & first.isNotNull(), F.sequence(first, last))
    return joined.select(*SLOT, F.col("_known").isNull().alias("case_is_new"), action.alias("action"), "files", (several & conflict.isNull()).alias("merges"), conflict.alias("conflict"), note.alias("note"), years.alias("years"))
