"""What the operators of this subpackage share: lineage cuts, checked broadcasts, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import accumulate
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; a larger side is joined by a shuffle.
BROADCAST_ROWS = 300_000
#: Rows in an Arrow batch: texts may be long, so batches are kept short.
BATCH_ROWS = 512

T = TypeVar("T")
_memory: dict[str, object] = {}
#: Tables that this driver has written, by application.
_written: dict[str, list[str]] = {}


def remembered(owner: str, make: Callable[[], T]) -> T:
    """What a Python worker remembers for one owner. Workers are used again, so another owner's memory is given up first."""
    if owner not in _memory:
        _memory.clear()
        pa.default_memory_pool().release_unused()
        _memory[owner] = make()
    return _memory[owner]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where it is unset: in local mode, as in tests, a temporary
    folder, and on a cluster one in the warehouse, which must then be in a store that executors share, not on local disks."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        warehouse, store = spark.conf.get("spark.sql.warehouse.dir"), context._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        if context.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="murmura-checkpoint-")
        elif (warehouse if ":" in warehouse else store).startswith("file:"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share: the warehouse is on local disks")
        else:
            folder = f"{warehouse.rstrip('/')}/murmura-checkpoint"
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Session settings that every operator here relies on: short Arrow batches and a checkpoint folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    checkpoint_dir(spark)


def refuse(given: Iterable[str], new: Iterable[str]) -> None:
    """An error if columns that are kept have names that the result needs."""
    if clashes := set(given) & set(new):
        raise ValueError(f"kept columns must not be called {', '.join(sorted(clashes))}")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows, for narrow tables, while a table is materialized."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and read it back, so that lost executors cost no recomputation.
    The table stays until sweep is called or the folder is cleaned."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/murmura-{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Delete the tables that materialize has written for this session, and return how many: once results have been used."""
    context, n = spark.sparkContext, 0
    for path in _written.pop(context.applicationId, []):
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        n += bool(place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True))
    return n


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many (narrow) rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with position long: 0, 1, 2 ... in the given order. Rows are dealt by ranges and sorted in their parts; only the parts'
    sizes meet. Rows that are equal in all of order are numbered in any order, but are dealt to one task."""
    spark = df.sparkSession
    parted = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("position", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("position", 33), F.col("position").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.part, r["count"]) for r in parted.groupBy(part.alias("part")).count().collect())  # one row a partition
    first = list(accumulate((n for _, n in sizes), initial=0))
    before = spark.createDataFrame([(p, f) for (p, _), f in zip(sizes, first, strict=False)], "__part long, __first long")
    found = parted.join(F.broadcast(before), part == F.col("__part"))
    return found.withColumn("position", F.col("__first") + place).select(*df.columns, "position")


def utf8(column: pa.Array) -> list[bytes | None]:
    """Texts of an Arrow column as UTF-8 bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a long, b long); a component is named by its least node.

    Alternates large-star and small-star contractions until the edges stay the same; each step is a minimum with
    map-side combining and a join, and its edges are checkpointed. Nulls and loops are left out; an empty table
    gives an empty result.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    seen = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = small.checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a")).distinct()
