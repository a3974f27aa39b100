"""Proportional stratified interleaving: shards that all have the mixture of the sources.

Rows are put in a seeded random order within their source (by the MD5 of seed, id and text); a row's fractional rank
is its place in that order over the rows of its source; rows of all sources sorted by fractional rank are cut
into shards of equal row counts. Both ranks come from two-level ranking (equal ranges of the key, a window
inside each range, running totals of the ranges, two-level as well), so no source and no shard meets in one task.

Defined results: a null source is a source of its own; a null id orders as the word null; repeated rows get
places of their own; a null text has size 8; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAW = "rows"


def _range_bits(rows: int, range_rows: int) -> int:
    """Bits for so many ranges that one has ``range_rows`` rows or so; at least 1,024 ranges."""
    return min(24, max(10, math.ceil(math.log2(max(1, rows / range_rows)))))


#: Neighbouring ranges whose totals are summed up in one task.
NEIGHBOURS_BITS = 12


def _with_totals_before(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Column ``before``: rows of all smaller ranges; totals run inside groups of ranges and over the groups."""
    grouped = counts.withColumn("group", F.shiftright(order, NEIGHBOURS_BITS))
    inside = Window.partitionBy(*by, "group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*by).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy(*by, "group").agg(F.sum("n").alias("group_rows")).withColumn("group_before", F.coalesce(F.sum("group_rows").over(across), F.lit(0)))
    joined = grouped.join(groups.drop("group_rows"), [*by, "group"])
    return joined.withColumn("before", F.col("group_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("group", "group_before")


def interleaved(docs: DataFrame, shards: int = 24, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", range_rows: int = 100_000) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard, fraction for every row of ``docs``."""
    total = docs.count()
    bits = _range_bits(total, range_rows)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(text)))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("stratum"),
        key.alias("shuffle_key"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("range", F.shiftright(F.conv(F.substring("shuffle_key", 1, 7), 16, 10).cast("long"), 28 - bits))

    dealt = rows.repartition("stratum", "range")
    offsets = _with_totals_before(dealt.groupBy("stratum", "range").agg(F.count(F.lit(1)).alias("n")), ["stratum"], "range")
    strata = dealt.groupBy("stratum").agg(F.count(F.lit(1)).alias("stratum_rows"))
    offsets = offsets.join(strata, "stratum").select("stratum", "range", "before", "stratum_rows")
    place = Window.partitionBy("stratum", "range").orderBy("shuffle_key", "text_crc32", "size")
    ranked = dealt.withColumn("inside", F.row_number().over(place)).join(offsets, ["stratum", "range"])
    rank: Column = F.col("before") + F.col("inside") - 1
    ranked = ranked.withColumn("fraction", (2 * rank + 1).cast("double") / (2 * F.col("stratum_rows")).cast("double"))

    spread = ranked.drop("range", "before", "inside").withColumn("cell", F.least(F.floor(F.col("fraction") * (1 << bits)), F.lit((1 << bits) - 1))).repartition("cell")
    cells = _with_totals_before(spread.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), [], "cell").select("cell", "before")
    order = Window.partitionBy("cell").orderBy("fraction", "stratum", "shuffle_key", "text_crc32", "size")
    placed = spread.withColumn("inside", F.row_number().over(order)).join(cells, "cell").withColumn("position", F.col("before") + F.col("inside") - 1)
    n = max(total, 1)
    return placed.withColumn("shard", F.expr(f"cast((position * {shards}L) div {n}L as int)")).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        F.expr(f"position - (shard * {n}L + {shards - 1}L) div {shards}L").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "fraction",
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 42, id_col: str = "doc_id") -> None:
    """Write ``docs`` as Parquet, a folder a shard, rows of each file in slot order. Ids must be unique."""
    plan = interleaved(docs, shards, seed, id_col).select(F.col("doc_id").alias(id_col), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    joined = docs.join(plan, id_col).repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    joined.withColumnRenamed("_shard", "shard").drop("_slot").write.partitionBy("shard").parquet(path)
