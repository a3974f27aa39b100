"""Helpers shared by the training-data operators: shared storage, size-checked broadcasts, files by URI."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casehours.session import scratch as fresh_path
from casehours.session import ship

#: Key rows (16 bytes each or so) that may be broadcast; beyond it the same join shuffles.
BROADCAST_KEYS = 1_000_000


#: Rows of an Arrow batch where the session has Spark's own default: texts can be long, and a batch is in memory at once.
BATCH_ROWS, DEFAULT_BATCH_ROWS = 1000, "10000"


def prepare(spark: SparkSession) -> None:
    """Ship this package to Python workers, which may not have it, and keep batches of texts small. Operators call it themselves."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", DEFAULT_BATCH_ROWS) == DEFAULT_BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    ship(spark)


#: Tables written inside ``temporaries``, innermost last.
_TABLES: list[list[str]] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: ends the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    if _TABLES:
        _TABLES[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def temporaries() -> Iterator[None]:
    """Tables that :func:`cut` writes inside are deleted at the end; what is to stay must be written outside or by :func:`settled`."""
    _TABLES.append([])
    try:
        yield
    finally:
        for path in _TABLES.pop():
            drop_table(path)


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` returns as a written table; the tables that it wrote on the way are deleted."""
    with temporaries():
        out = build()
        path = fresh_path(out.sparkSession, name)
        out.write.parquet(path)
    if _TABLES:
        _TABLES[-1].append(path)
    return out.sparkSession.read.schema(out.schema).parquet(path)


def drop_table(path: str) -> None:
    fs, where = file_system(path)
    with contextlib.suppress(FileNotFoundError):
        fs.delete_dir(where)


def sized(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """``keys`` (narrow, already written by :func:`cut`) hinted for broadcast if it has ``most`` rows or fewer."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


ROW = "_row_id"


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def repeated_ids(docs: DataFrame, id_col: str, text_col: str) -> tuple[bool, DataFrame]:
    """Do several rows share an id? And the ids (id, written) whose rows differ in their text."""
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).filter("id is not null")
    twice = cut(known.groupBy("id").count().filter("count > 1").select("id"), "repeated-ids")
    if not has_rows(twice):
        return False, twice
    texts = known.join(sized(twice), "id", "left_semi").groupBy("id").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    return True, cut(texts.filter("a <> b").select("id"), "differing-ids")


def with_row_ids(docs: DataFrame, id_col: str, text_col: str, differing: DataFrame | None = None) -> DataFrame:
    """``docs`` with a long column ``ROW``: the id; of rows whose id is null or has several texts, a hash of id and text.

    So a decision about one row never reaches another text of the same id; rows equal in id and text have one ``ROW``. Hashes
    are 2^62 or more, so that ids below that come first. ``differing``: from :func:`repeated_ids`, if it is at hand.
    """
    if differing is None:
        repeats, differing = repeated_ids(docs, id_col, text_col)
        several = repeats and has_rows(differing)
    else:
        several = has_rows(differing)
    own = F.xxhash64(F.lit("row"), F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    if not several:  # no join, which every reader of these rows would do again
        return docs.withColumn(ROW, F.when(F.col(id_col).isNull(), own).otherwise(F.col(id_col).cast("long")))
    differing = differing.withColumnRenamed("id", "_several")
    known = docs.join(sized(differing), F.col(id_col).cast("long") == F.col("_several"), "left")
    return known.withColumn(ROW, F.when(F.col(id_col).isNull() | F.col("_several").isNotNull(), own).otherwise(F.col(id_col).cast("long"))).drop("_several")


def repeated_rows(keyed: DataFrame) -> DataFrame:
    """The ``ROW`` of rows of ``keyed`` (from :func:`with_row_ids`) that others equal in id and text, written."""
    return cut(keyed.groupBy(ROW).count().filter("count > 1").select(ROW), "twins")


def kept_rows(keyed: DataFrame, losers: DataFrame, twins: DataFrame | None) -> DataFrame:
    """Rows of ``keyed`` (from :func:`with_row_ids`) whose ``ROW`` is not among the written ``losers``, one of each ``ROW``, without that column.

    Rows of one ``ROW`` are equal in id and text; which of them stays is not said. ``twins``: from :func:`repeated_rows`, None if it has no rows.
    """
    left = keyed.join(sized(losers.select(ROW)), ROW, "left_anti")
    if twins is None:
        return left.drop(ROW)
    single = left.join(sized(twins), ROW, "left_anti")
    # counted before the shuffle: a partition passes one row of each group on
    return single.unionByName(left.join(sized(twins), ROW, "left_semi").dropDuplicates([ROW])).select(*single.columns).drop(ROW)


def without_row_ids(keyed: DataFrame, losers: DataFrame) -> DataFrame:
    """Rows of ``keyed`` (from :func:`with_row_ids`) whose ``ROW`` is not among the written ``losers``, without that column."""
    return keyed.join(sized(losers.select(ROW)), ROW, "left_anti").drop(ROW)


def tidied(run):
    """``run`` over batches; after the last one the worker gives freed memory back, because Spark keeps it for later tasks."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, gs) or of an absolute path."""
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks) -> int:
    """Write byte chunks under a passing name, then move into place: a retried task leaves one whole file."""
    fs, path = file_system(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    passing, size = f"{path}.{uuid.uuid4().hex[:8]}.tmp", 0
    with fs.open_output_stream(passing, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    fs.move(passing, path)
    return size


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
