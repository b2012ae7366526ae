"""Exact nearest vectors without comparing all pairs: an index clustered by pivots, blocks skipped by the triangle inequality.

Vectors are taken at length 1, where the distance 1 - cosine is half the squared Euclidean one, which keeps the triangle
inequality: a query that is far from a cluster's pivot compared with the cluster's radius can skip all of it, and within a cluster a
vector whose distance from the pivot differs too much from the query's. The index is built once and written by cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .vectors import six_decimals

#: What rounding to six decimals and sums in doubles may change of a distance.
_SLACK = 2e-6
MOST_QUERIES = 10_000


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, vectors at length 1) of the rows with dim entries, none null or infinite, and a length."""
    rows = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dim)
    norm = np.sqrt((flat * flat).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], flat[good] / norm[good][:, None]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors, all of a with all of b."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def pivots(vectors: DataFrame, count: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """`count` different unit vectors at most, of the 4 * count rows whose ids have the least hash: a bounded sample of the most frequent
    length. Which vectors are taken changes how much is compared, never the result."""
    size = vectors.select(F.size(vector_col).alias("n")).where("n > 0").groupBy("n").count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not size:
        return np.zeros((0, 0))
    dim = size[0].n
    rows = vectors.where(F.size(vector_col) == dim).select(F.col(vector_col).alias("v"), F.col(id_col).alias("id")).orderBy(F.xxhash64("id")).limit(4 * count).collect()
    x = np.array([[np.nan if e is None else e for e in r.v] for r in rows], np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    units = x[good] / norm[good][:, None]
    return units[np.sort(np.unique(units.round(9), axis=0, return_index=True)[1])[:count]]


def clustered(vectors: DataFrame, centres: np.ndarray, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Write (cluster, vec_id, apart, unit) of vectors under path, by their nearest pivot, and read it back.

    Vectors of another length than the pivots, with null or infinite entries or without a length are in no cluster.
    """
    spark = vectors.sparkSession
    dim = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, units = _units(batch["vector"], dim)
            apart = _apart(units, centres)
            nearest = apart.argmin(axis=1) if len(rows) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nearest.astype(np.int32)), batch["id"].take(pa.array(rows)), pa.array(apart[np.arange(len(rows)), nearest]), pa.array(list(units), pa.list_(pa.float64()))], ["cluster", "vec_id", "apart", "unit"])

    kind = vectors.schema[id_col].dataType.simpleString()
    found = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).mapInArrow(run, f"cluster int, vec_id {kind}, apart double, unit array<double>")
    # few files a cluster, and a large cluster in several
    found.hint("rebalance", "cluster").sortWithinPartitions("cluster", "apart").write.partitionBy("cluster").mode("overwrite").parquet(path)
    return spark.read.schema(f"vec_id {kind}, apart double, unit array<double>, cluster int").parquet(path)


#: Pairs of a query and a vector that a task compares at a time, and rows it holds beyond its best before these are chosen again.
_CELLS, _HELD = 1 << 22, 1 << 20


def _search(index: DataFrame, asked: np.ndarray, limit: np.ndarray, reach: np.ndarray, to_pivots: np.ndarray, k: int) -> DataFrame:
    """(query, vec_id, distance, compared): of each partition the k nearest within a query's reach of each cluster and within its limit, and,
    in a row of its own, how many pairs were within reach. reach: query x cluster, negative where the cluster is skipped."""
    kind = index.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, new, held, compared, bound = None, [], 0, 0, limit.copy()
        for batch in batches:
            cluster, apart = batch["cluster"].to_numpy(), batch["apart"].to_numpy()
            units, ids = batch["unit"].flatten().to_numpy().reshape(len(apart), -1), batch["vec_id"]
            for c in np.unique(cluster):
                own, open_ = np.flatnonzero(cluster == c), np.flatnonzero(reach[:, c] >= 0)
                for at in range(0, len(open_), step := max(1, _CELLS // len(own))):
                    q = open_[at : at + step]
                    near = np.abs(apart[own][None, :] - to_pivots[q, c][:, None]) <= reach[q, c][:, None]
                    compared += int(near.sum())
                    rows = np.flatnonzero(near.any(axis=0))
                    if not len(rows):
                        continue
                    d = 1 - asked[q] @ units[own[rows]].T
                    i, j = np.nonzero(near[:, rows] & (d <= bound[q][:, None] + _SLACK))
                    new.append(pa.table({"query": pa.array(q[i], pa.int32()), "distance": six_decimals(d[i, j]), "vec_id": ids.take(pa.array(own[rows[j]]))}))
                    held += len(i)
                    if held > _HELD:
                        best, new, held = _best(pa.concat_tables([best, *new] if best else new), k, bound), [], 0
        if new or best:
            best = _best(pa.concat_tables([best, *new] if best else new), k, bound)
            for b in best.combine_chunks().to_batches(max_chunksize=100_000):
                yield pa.RecordBatch.from_arrays([b["query"], b["vec_id"], b["distance"], pa.nulls(len(b), pa.int64())], ["query", "vec_id", "distance", "compared"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, batch_type), pa.nulls(1, pa.float64()), pa.array([compared], pa.int64())], ["query", "vec_id", "distance", "compared"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(index.schema["vec_id"].dataType)
    return index.mapInArrow(run, f"query int, vec_id {kind}, distance double, compared long")


def _best(found: pa.Table, k: int, bound: np.ndarray) -> pa.Table:
    """The k best rows of each query, by (distance, vec_id), null ids first, as Spark has them; the k-th distance becomes its bound."""
    found = found.take(pc.sort_indices(found, sort_keys=[("query", "ascending"), ("distance", "ascending"), ("vec_id", "ascending")], null_placement="at_start"))
    query, distance = found["query"].to_numpy(), found["distance"].to_numpy()
    place = np.arange(len(query)) - np.searchsorted(query, query)
    last = place == k - 1
    bound[query[last]] = np.minimum(bound[query[last]], distance[last])
    return found.filter(pa.array(place < k))


def nearest(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, most_queries: int = MOST_QUERIES) -> tuple[DataFrame, int]:
    """((query_id, vec_id, distance, rank), pairs within reach) of the k nearest vectors of a clustered index for each query (query_id, vector).

    Exact, by (distance to six decimals, vec_id). First each query is compared with the closest clusters that hold k vectors, which
    bounds its k-th distance; then with what that bound leaves of all clusters. The queries of a block go to every task, at most about most_queries:
    more are dealt by hash into blocks, which are searched one after another.
    """
    sizes = {r.cluster: r for r in index.groupBy("cluster").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()}  # one row a pivot
    total = queries.count()
    blocks = 1 if total <= most_queries else -(-2 * total // most_queries)
    done, compared = None, 0
    for n in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)
        found, some = _block(index, centres, sizes, block, k)
        done, compared = found if done is None else done.union(found), compared + some
    return done, compared


def _block(index: DataFrame, centres: np.ndarray, sizes: dict, queries: DataFrame, k: int) -> tuple[DataFrame, int]:
    spark = index.sparkSession
    checkpoint_dir(spark)
    rows = queries.select("query_id", "vector").toArrow()  # at most a block
    asked_kind = queries.schema["query_id"].dataType.simpleString()
    kinds = f"query_id {asked_kind}, vec_id {index.schema['vec_id'].dataType.simpleString()}, distance double, rank long"
    dim = centres.shape[1]
    vectors = rows["vector"].combine_chunks()
    vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
    at, asked = _units(vectors, dim) if dim and len(vectors) else (np.zeros(0, int), np.zeros((0, 0)))
    names = rows["query_id"].take(pa.array(at, pa.int64())).to_pylist()
    if not names or not sizes:
        return spark.createDataFrame([], kinds), 0
    to_pivots = _apart(asked, centres)
    n = np.array([sizes[c].n if c in sizes else 0 for c in range(len(centres))])
    radius = np.array([sizes[c].radius if c in sizes else 0.0 for c in range(len(centres))])
    order = np.argsort(to_pivots, axis=1)
    enough = np.cumsum(n[order], axis=1)
    home = np.full(to_pivots.shape, -1.0)
    for q in range(len(names)):
        home[q, order[q, : int(np.searchsorted(enough[q], min(k, n.sum()))) + 1]] = 4.0
    some = [int(c) for c in np.flatnonzero((home >= 0).any(axis=0))]
    no_limit = np.full(len(names), 2.0)
    first = _search(index.where(F.col("cluster").isin(some)), asked, no_limit, home, to_pivots, k).checkpoint()
    compared = first.agg(F.coalesce(F.sum("compared"), F.lit(0))).first()[0]
    bound = no_limit.copy()
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance"))
    for r in first.where("query is not null").withColumn("place", place).where(F.col("place") == k).select("query", "distance").collect():  # one row a query of the block
        bound[r.query] = r.distance
    tau = np.sqrt(2 * (bound + _SLACK))
    reach = np.where((to_pivots - radius[None, :] <= tau[:, None] + 1e-9) & (n > 0)[None, :], tau[:, None] + 1e-9, -1.0)
    some = [int(c) for c in np.flatnonzero((reach >= 0).any(axis=0))]
    found = _search(index.where(F.col("cluster").isin(some)), asked, bound, reach, to_pivots, k).checkpoint()
    compared += found.agg(F.coalesce(F.sum("compared"), F.lit(0))).first()[0]
    known = spark.createDataFrame(list(enumerate(names)), f"query int, query_id {asked_kind}")
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "vec_id")).cast("long")
    best = found.where("query is not null").withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(known), "query")
    return best.select("query_id", "vec_id", "distance", "rank"), compared
