"""Session defaults."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(app: str = "casehours", **more: str) -> SparkSession:
    """The active session or a new one with the defaults; ``more`` has further settings, dots as double underscores."""
    return SparkSession.builder.appName(app).config(map=DEFAULTS | {k.replace("__", "."): v for k, v in more.items()}).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses, in the folder that driver and executors share (``spark.checkpoint.dir``); in local mode a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="spark-casehours-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(place)
    return f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: what several later steps read is computed once, and a lost executor costs a task."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to Python workers, which may not have it, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    archive.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(PACKAGE)))
    place = scratch(spark, "package") + "/casehours.zip"
    fs, where = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", place))
    fs.create_dir(where.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(where, compression=None) as out:
        out.write(packed.getvalue())
    context.addPyFile(place)
