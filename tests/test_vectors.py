"""Vector search with more queries than are broadcast at once, and by an index clustered by pivots."""

import numpy as np
import pytest
from murmura.operators import pivots as P
from murmura.operators import vectors as V
from pyspark.sql import functions as F

from .conftest import DATA


def test_many_queries_are_asked_in_blocks(spark):
    index = spark.read.parquet(f"{DATA}/embeddings.parquet")
    asked = index.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    at_once = V.nearest(index, asked, 5)
    in_blocks = V.nearest(index, asked, 5, most_queries=10)
    assert asked.count() > 10 and in_blocks.dtypes == at_once.dtypes
    assert sorted(in_blocks.collect()) == sorted(at_once.collect()) != []


KIND = "vec_id long, embedding array<double>"


@pytest.mark.parametrize(("seed", "spread", "k"), [(1, 0.05, 5), (2, 0.3, 1), (3, 2.0, 7), (4, 0.0, 3)])
def test_clusters_give_the_same_and_compare_less(spark, tmp_path, seed, spread, k):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, 8))
    rows = [(i, (centres[i % 12] + spread * r.standard_normal(8)).tolist()) for i in range(600)]
    index = spark.createDataFrame(rows, KIND).repartition(3)
    asked = index.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = sorted(tuple(x) for x in V.nearest(index, asked, k).collect())
    found, compared = P.nearest(P.clustered(index, p := P.pivots(index, 24), str(tmp_path / "i")), p, asked, k)
    assert sorted(tuple(x) for x in found.collect()) == want and found.columns == ["query_id", "vec_id", "distance", "rank"]
    if spread < 1:
        assert compared < 600 * 12 / 2


def test_awkward_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [0.0, 2.0]), (8, [0.0, 2.0]), (9, []), (None, [3.0, 0.0])]
    index = spark.createDataFrame(rows, KIND)
    p = P.pivots(index, 8)
    built = P.clustered(index, p, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0])], "query_id int, vector array<double>")
    found, _ = P.nearest(built, p, asked, 10)
    assert [(x.query_id, x.vec_id, x.distance) for x in found.orderBy("rank").collect()] == [(1, None, 0.0), (1, 1, 0.0), (1, 7, 1.0), (1, 8, 1.0)]
    assert P.nearest(built, p, asked.limit(0), 3)[0].collect() == [] and P.pivots(index.limit(0)).size == 0


def test_a_group_of_a_search_is_bounded_and_copies_are_no_pairs_in_lists(spark, tmp_path, monkeypatch):
    """Parts of both sides, blocks within them and masses of copies give what one comparison gives."""
    for name, value in (("PART_ENTRIES", 400), ("QUERY_ROWS", 3), ("INDEX_ROWS", 7)):
        monkeypatch.setattr(V, name, value)
    monkeypatch.setattr(P, "_CELLS", 50)
    monkeypatch.setattr(P, "_HELD", 40)
    r = np.random.default_rng(5)
    vectors = [r.standard_normal(4).tolist() if i % 3 else [1.0, 2.0, 0.0, 1.0] for i in range(300)]
    index = spark.createDataFrame(list(enumerate(vectors)), KIND).repartition(3)
    asked = index.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    x = np.array(vectors)
    d = V.six_decimals(1 - (x[::20] @ x.T) / np.outer(np.sqrt((x[::20] ** 2).sum(1)), np.sqrt((x**2).sum(1))))
    want = sorted((20 * q, int(i), float(d[q, i]), n + 1) for q in range(15) for n, i in enumerate(np.lexsort((np.arange(300), d[q]))[:5]))
    assert sorted(map(tuple, V.nearest(index, asked, 5, most_queries=4).collect())) == want
    found, _ = P.nearest(P.clustered(index, p := P.pivots(index, 8), str(tmp_path / "i")), p, asked, 5, most_queries=10)
    assert sorted(map(tuple, found.collect())) == want


def test_unknown_distances_come_last_and_pairs_hold_their_condition(spark):
    index = spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.0, 1.0], None), (4, [1.0, 1.0], "b"), (5, [1.0], "a"), (6, None, "a")], KIND + ", shop string")
    asked = spark.createDataFrame([(7, [1.0, 0.0], "a"), (8, [1.0, 0.0], None), (9, [2.0, 0.0], "b")], "query_id int, vector array<double>, asked string")
    rows = lambda where: [(x.query_id, x.vec_id) for x in V.nearest(index, asked, 3, where=where).orderBy("query_id", "rank").collect()]
    assert rows(None) == [(q, v) for q in (7, 8, 9) for v in (2, 4, 3)]
    assert rows("v.shop = 'b' or v.shop = q.asked") == [(7, 2), (7, 4), (7, 1), (8, 4), (9, 4)]


def test_halves_are_rounded_as_spark_rounds_them(spark):
    x = [i / 128 for i in range(-40, 257)] + [0.1234565, 1e-7, -4.9e-7, 5e-7, float("inf")]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select((F.round("x", 6) + 0.0).alias("r")).collect()
    assert [r.r for r in rows] == V.six_decimals(np.array(x)).tolist()
