"""Incremental append: new export files join a study, cells that it has stay (M-01)."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casehours.operators.merge import CELL, append_cells, duplicate_cells, first_wins
from casehours.sources.catalog import catalog
from casehours.sources.exports import ranked_files, read_long, read_wide


def append_files(spark: SparkSession, paths: list[str] | str, study: str, case_pattern: str | None = None) -> DataFrame:
    """Read files, refuse those with duplicate cells, and append the rest to ``study``/cells; gives quality rows.

    The facts are parsed once and staged. Only the partitions (case, kind, year) that the files touch are written again, all
    in one step, and the same files written twice leave the same study: a crash and a replay do no harm.
    """
    staged = f"{study}/_staged-{uuid.uuid4().hex[:12]}"
    ranked_files(catalog(spark, paths, case_pattern)).write.parquet(f"{staged}/files")
    files = spark.read.parquet(f"{staged}/files")
    (long, long_bad), (wide, wide_bad) = read_long(spark, files), read_wide(spark, files)
    long.unionByName(wide).write.parquet(f"{staged}/facts")
    facts = spark.read.parquet(f"{staged}/facts")
    twice = duplicate_cells(facts).groupBy("src_file").agg(F.lit("duplicate row").alias("cause"), F.count(F.lit(1)).alias("rows")).select("src_file", "cause", "rows")
    refused = files.filter("reason is not null").select("src_file", F.col("reason").alias("cause"), F.lit(1).cast("long").alias("rows"))
    refused.unionByName(long_bad).unionByName(wide_bad).unionByName(twice).write.parquet(f"{staged}/quality")
    quality = spark.read.parquet(f"{staged}/quality")

    doubled = quality.filter("cause = 'duplicate row'").select("src_file").distinct()
    fresh = first_wins(facts.join(doubled, "src_file", "left_anti"))
    keys = fresh.select("case_id", "kind", "year").distinct()
    try:
        held = spark.read.parquet(f"{study}/cells").join(keys, ["case_id", "kind", "year"], "left_semi").select(*fresh.columns)
        fresh = append_cells(held, fresh, CELL)
    except AnalysisException as x:  # the first append finds no cells
        if x.getCondition() != "PATH_NOT_FOUND":
            raise
    fresh.write.parquet(f"{staged}/cells")
    spark.read.parquet(f"{staged}/cells").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id", "kind", "year").parquet(f"{study}/cells")
    return quality


def watch(spark: SparkSession, directory: str, study: str, checkpoint: str, case_pattern: str | None = None, **trigger) -> StreamingQuery:
    """Append every new file of a directory once; quality rows of a batch are a partition of ``study``/quality, so that a replayed batch writes them again, not twice."""
    names = spark.readStream.format("text").option("wholetext", "true").load(directory).select(F.col("_metadata.file_path").alias("path"))

    def batch(rows: DataFrame, epoch: int) -> None:
        paths = [r["path"] for r in rows.distinct().collect()]  # names of files
        if paths:
            found = append_files(rows.sparkSession, paths, study, case_pattern).withColumn("batch", F.lit(epoch))
            found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{study}/quality")

    return names.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
