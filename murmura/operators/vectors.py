"""Exact vector search and index maintenance."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in double; null if either has no length."""
    as_double = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(as_double(x), as_double(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Entries of vectors in a part of the index, and queries in a part, that one group of a task holds; cells that are compared at a time.
PART_ENTRIES, PART_QUERIES, QUERY_ROWS, INDEX_ROWS = 1 << 21, 4096, 1024, 4096


def nearest(index: DataFrame, queries: DataFrame, k: int, most_queries: int = PART_QUERIES, where: str | None = None) -> DataFrame:
    """(query_id, vec_id, distance, rank) of the k nearest rows of index (vec_id, embedding, ...) for any number of queries
    (query_id, vector, ...), by (distance to six decimals, vec_id). Distances that are no number (NaN) come last.

    where is SQL on columns of both (index as v, queries as q, but for their vectors and ids) that must hold for a pair: queries that are alike in
    their columns are parts of their own, and a row of the index goes to the parts that it may meet. Both sides are dealt by hash into parts of bounded
    size (most_queries; PART_ENTRIES), and each pair of parts is a group, compared as matrices, of which k rows a query are left.
    """
    spark = index.sparkSession
    checkpoint_dir(spark)
    index = index.where(F.col("embedding").isNotNull())
    entries = index.agg(F.sum(F.size("embedding") + 1)).first()[0] or 0
    own = max(1, -(-entries // PART_ENTRIES))
    like = [c for c in queries.columns if c not in ("query_id", "vector")] if where else []
    asked = queries.where(F.col("vector").isNotNull()).withColumn("__like", F.md5(F.to_json(F.struct(F.lit(0), *like))))
    parts = asked.groupBy("__like", *like).agg(F.count("*").alias("n")).withColumn("__of", F.ceil(F.col("n") / most_queries)).drop("n").checkpoint()
    asked = asked.join(F.broadcast(parts.select(F.col("__like").alias("__same"), "__of")), F.col("__like") == F.col("__same"))
    asked = asked.withColumn("__part", F.concat_ws("-", "__like", F.pmod(F.xxhash64("query_id"), F.col("__of"))))
    each = parts.withColumn("__sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__of") - 1))).withColumn("__part", F.concat_ws("-", "__like", "__sub"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = asked.select("query_id", "vector", "__part", F.explode(F.sequence(F.lit(0), F.lit(own - 1))).alias("__own"))
    met = index.alias("v").join(F.broadcast(each.alias("q")), F.expr(where) if where else F.lit(True))
    right = met.select("v.vec_id", "v.embedding", "q.__part", F.pmod(F.xxhash64("v.vec_id"), F.lit(own)).cast("int").alias("__own"))
    sides = [df.repartition(tasks, "__part", "__own").groupBy("__part", "__own") for df in (left, right)]
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {index.schema['vec_id'].dataType.simpleString()}, distance double"
    rows = sides[0].cogroup(sides[1]).applyInArrow(lambda a, b: _compared(a, b, k), kinds)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def six_decimals(x: np.ndarray) -> np.ndarray:
    """x to six decimals, halves away from zero by the shortest decimal form, as Spark's round has them."""
    out = np.round(x, 6)
    with np.errstate(invalid="ignore"):
        halves = np.abs(x * 1e6 - np.floor(x * 1e6) - 0.5) < 1e-6
    for i in np.flatnonzero(halves):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out + 0.0


def matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length to (row numbers, vectors in double) of a column of vectors; null entries are NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        out[n] = rows, column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), n)
    return out


def _compared(asked: pa.Table, own: pa.Table, k: int) -> pa.Table:
    """(query_id, vec_id, distance): the k nearest of a part of the index for each query of a part."""
    own = own.take(pc.sort_indices(own, sort_keys=[("vec_id", "ascending")], null_placement="at_start"))  # of equal distances the first row stays
    theirs, found = matrices(own["embedding"]), []
    for n, (at, q) in matrices(asked["vector"]).items():
        if n in theirs:
            rows, v = theirs[n]
            for i in range(0, len(q), QUERY_ROWS):
                which, place, distance = _k_nearest(q[i : i + QUERY_ROWS], v, k)
                found.append((at[i + which], rows[place], distance))
    query, row, distance = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64)))
    return pa.table({"query_id": asked["query_id"].take(pa.array(query)), "vec_id": own["vec_id"].take(pa.array(row)), "distance": pa.array(distance)})


def _k_nearest(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance to six decimals) of the k rows of v with the least (distance, row) for each row of q."""
    norm, norms = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    limit, full = np.full(len(q), np.inf), np.zeros(len(q), bool)
    for b in range(0, len(v), INDEX_ROWS):
        with np.errstate(all="ignore"):
            d = 1 - (q @ v[b : b + INDEX_ROWS].T) / (norm[:, None] * norms[None, b : b + INDEX_ROWS])
        d[~np.isfinite(d)] = np.inf
        cut = np.partition(d, k - 1, axis=1)[:, k - 1] + 2e-6 if b == 0 and d.shape[1] >= k else limit
        # rows come by id: a later one at the distance of the k-th is not nearer
        i, j = np.nonzero((d < cut[:, None]) | (~full & ~np.isfinite(cut))[:, None])
        if len(i):
            query, row, distance = (np.concatenate(x) for x in zip(held, (i, b + j, six_decimals(d[i, j])), strict=True))
            order = np.lexsort((row, distance, query))
            place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
            held = tuple(x[order[place < k]] for x in (query, row, distance))
            last = order[place == k - 1]
            limit[query[last]], full[query[last]] = distance[last] - 0.5e-6 + 1e-9, True
    return held[0], held[1], np.where(np.isfinite(held[2]), held[2], np.nan)


def refreshed(index: DataFrame, fresh: DataFrame, deleted: DataFrame, key: str = "source_file") -> DataFrame:
    """The index without rows of deleted or refreshed sources, with the fresh rows."""
    gone = deleted.select(key).union(fresh.select(key)).distinct()
    return index.join(gone, key, "left_anti").unionByName(fresh)


def upserted(state: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """State with changes over it, the latest change of a key winning."""
    columns = [c for c in state.columns if c not in keys]
    latest = changes.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("new"))
    joined = state.withColumn("__old", F.struct(*columns)).join(latest, keys, "full")
    return joined.select(*keys, *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c) for c in columns])
