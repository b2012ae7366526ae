"""The Spark session of applications; libraries take the session they are given."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(name: str = "murmura", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf (dots as double underscores) overrides."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where it is unset: in local mode, as in tests, a temporary folder, and
    on a cluster one in the warehouse, which must then be in a store that executors share, not on local disks."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        folder = shared_folder(context.master, spark.conf.get("spark.sql.warehouse.dir"), context._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///"))
        context.setCheckpointDir(folder)
    return folder


def shared_folder(master: str, warehouse: str, store: str) -> str:
    """A folder for checkpoints: a temporary one in local mode, else one in the warehouse. A warehouse on local disks is an error."""
    if master.split("[")[0] == "local":
        return tempfile.mkdtemp(prefix="murmura-checkpoint-")
    if (warehouse if ":" in warehouse else store).startswith("file:"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share: the warehouse is on local disks")
    return f"{warehouse.rstrip('/')}/murmura-checkpoint"


#: What a table or result of this library that may be deleted once it has been used begins with, in the checkpoint folder.
PREFIX = "murmura-"


def sweep(spark: SparkSession) -> int:
    """Delete the tables that queries of this library have left in the checkpoint folder, and return how many: once results have
    been used. Tables of other sessions that share the folder go too, so sweep when none is running."""
    jvm, folder = spark.sparkContext._jvm, checkpoint_dir(spark)
    place = jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.listStatus(place) if s.getPath().getName().startswith(PREFIX)] if files.exists(place) else []
    return sum(bool(files.delete(p, True)) for p in found)
