"""Whitening, mixing and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from murmura.llm import importance, mixing, queries, whitening
from murmura.llm.whitening import SHIFT, lanczos, whiten
from pyspark.sql import functions as F

from ..conftest import DATA

KIND = "vec_id long, embedding array<float>, label int, component string, n string"


def brute_whitening(vectors):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + SHIFT
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    values, turn = np.linalg.eigh(centred.T @ centred / len(fit))
    deviations = ((len(fit) * x.astype(object) - fit.sum(axis=0).astype(object)) ** 2).sum(axis=1)
    return x, fit, values[::-1], turn[:, ::-1], deviations


def test_lanczos_with_breakdowns_restarts_and_equal_eigenvalues():
    r = np.random.default_rng(3)
    for dim, count, block, most, values in [
        (1, 1, 0, 0, [2.0]),
        (5, 8, 0, 0, [3, 3, 3, 1, 1]),
        (40, 6, 2, 0, [5.0] * 10 + [1.0] * 30),  # only two values: blocks break down and start again
        (60, 4, 3, 16, [2.0**-i for i in range(60)]),  # the basis is cut
        (300, 5, 0, 40, list(np.linspace(1, 9, 300) ** 3)),
        (30, 4, 0, 0, [7, 6] + [0] * 28),
    ]:
        q = np.linalg.qr(r.standard_normal((dim, dim)))[0]
        matrix = q @ np.diag(values) @ q.T
        found, vectors = lanczos(lambda x, m=matrix: m @ x, dim, count, block, most)
        k = min(count, dim)
        assert found.shape == (k,) and vectors.shape == (dim, k)
        assert np.allclose(found, sorted(values, reverse=True)[:k], atol=1e-11 * max(values))
        assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-11)
        assert np.allclose(matrix @ vectors, vectors * found, atol=1e-10 * max(values))


def test_whitening_equals_the_eigenvectors(spark):
    frame = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = frame.orderBy("vec_id").toPandas()
    x, fit, values, turn, deviations = brute_whitening(rows.embedding.tolist())
    got = queries.op11_embedding_whitening(spark, DATA).toPandas()
    assert list(got.columns[:7]) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 16 * len(rows) and set(got.n) == {len(fit)} and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    z = got.pivot(index="vec_id", columns="component", values="whitened").loc[rows.vec_id].to_numpy()
    want = (x - fit.mean(axis=0)) @ turn[:, :16] / np.sqrt(values[:16])
    want *= np.sign((z * want).sum(axis=0))
    assert np.abs(z - want).max() < 1e-7
    assert got[got.component == 3].set_index("vec_id").deviation.loc[rows.vec_id].tolist() == deviations.tolist()
    assert np.allclose(got.groupby("component").explained.first(), values[:16] / values.sum(), rtol=1e-9)


def test_whitening_of_awkward_rows(spark):
    r = random.Random(5)
    some = [[r.gauss(0, 1) * (i + 1) for i in range(4)] for _ in range(30)]
    rows = [(i, v, 1, "x", None) for i, v in enumerate(some)]
    rows += [(100 + i, some[0], None, None, None) for i in range(40)]  # copies count once
    rows += [(None, some[1], 1, None, None), (7, some[2], 1, None, None)]
    rows += [(200, None, 1, None, None), (201, [], 1, None, None), (202, [1.0, None, 2.0, 3.0], 1, None, None), (203, [1.0, math.nan, 2.0, 3.0], 1, None, None), (204, [math.inf, 0.0, 0.0, 0.0], 1, None, None), (205, [1.0, 2.0], 1, None, None), (206, [3e38, 0.0, 0.0, 0.0], 1, None, None)]
    got = whiten(spark.createDataFrame(rows, KIND).repartition(5)).toPandas()
    kept = [v for v in rows if v[0] is None or v[0] < 200]
    x, fit, values, turn, deviations = brute_whitening(np.array([v[1] for v in kept], np.float32).tolist())
    assert len(got) == 4 * len(kept) and set(got.n) == {len(fit)} == {30}
    assert Counter(got[got.component == 1].deviation) == Counter(deviations.tolist())
    want = np.abs((x - fit.mean(axis=0)) @ turn / np.sqrt(values))
    assert np.allclose(np.sort(got.whitened.abs()), np.sort(want.ravel()), atol=1e-9)
    assert whiten(spark.createDataFrame([], KIND)).collect() == []
    assert whiten(spark.createDataFrame([rows[0]] * 3, KIND)).collect() == []  # one distinct vector has no variance
    flat = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], 1, None, None) for i in range(20)], KIND)).toPandas()
    assert set(flat.component) == {1} and np.allclose(flat.explained, 1)  # one direction has all of the variance


def test_deviations_beyond_64_bits(spark):
    rows = [(i, [float(i) * 2**30, -float(i) * 2**35, 1.0], 1, None, None) for i in range(50)]
    got = whiten(spark.createDataFrame(rows, KIND)).toPandas()
    x, fit, _, _, deviations = brute_whitening([v[1] for v in rows])
    want = [d if d < 2**63 else None for d in deviations]
    assert [None if v != v or v is None else int(v) for v in got[got.component == 1].sort_values("vec_id").deviation.astype(object)] == want and None in want
    near = whitening.fit(spark.createDataFrame(rows, KIND))
    assert near.sums == [int(v) for v in fit.astype(object).sum(axis=0)] and near.deviations(x) == want


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = total / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in above or open_:
            out[s] = 2.0 * sizes[s] if above else level * weight[s]
        total -= sum(out[s] for s in above)
        open_ -= above or set(open_)
    return out


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_taken(docs, block):
    """docs: (doc_id, text, source). Slot by slot, word by word."""
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += size_of(text)
    goals, out = brute_targets(sizes), []
    for source, goal in goals.items():
        key = lambda d: (hashlib.md5(":".join([*([str(d[0])] if d[0] is not None else []), *([hashlib.md5(d[1].encode()).hexdigest()] if d[1] is not None else [])]).encode()).hexdigest(), size_of(d[1]))
        own = sorted((d for d in docs if d[2] == source), key=key)
        line = [k for k, d in enumerate(own) for _ in range(size_of(d[1]))]
        taken, left, at = Counter(), math.floor(goal + 0.5), 0
        while left and line:
            part = line[at : at + block][:left]
            taken.update(part)
            left -= len(part)
            at = at + block if at + block < len(line) else 0
        out += [(d[0], size_of(d[1]), len(line), round(goal, 6), taken[k]) for k, d in enumerate(own)]
    return Counter(out)


def mixed(frame, **options):
    found, slots = mixing.mix(frame, **options)
    return Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in found.collect()), slots


@pytest.mark.parametrize("block", [1, 7, 64])
def test_mix_equals_brute_force(spark, block):
    r = random.Random(block)
    docs = [(i, " ".join(f"w{j}" for j in range(r.choice([0, 1, 3, 20, 90, 400]))), r.choice(["a", "b", "b", "b", "é", "z", None, "c"])) for i in range(150)]
    docs += [(5, "one two three four", "b")] * 20 + [(None, None, "a"), (None, "", None), (None, "x y", "only"), (900, None, "empty")]
    found, slots = mixed(spark.createDataFrame(docs, "doc_id long, text string, source string"), block_words=block)
    assert found == brute_taken(docs, block)
    rows = slots.orderBy("slot", "sid").collect()
    ranks, n = Counter(), Counter(x.sid for x in rows)
    for x in rows:
        assert x["rank"] == ranks[x.sid] and 0 < x.words <= block
        ranks[x.sid] += 1
    for share in (0.25, 0.5, 0.75):  # every stretch from the beginning holds sources in nearly their shares
        part = Counter(x.sid for x in rows[: int(share * len(rows))])
        assert all(abs(part[s] - share * n[s]) <= 2 + 2 * math.log(len(rows) + 1) for s in n)


def test_mix_of_awkward_rows(spark, awkward, no_rows):
    found, _ = mixed(awkward)
    assert found == brute_taken([(r.doc_id, r.text, r.source) for r in awkward.collect()], 1024)
    assert mixed(awkward)[0] == found == mixed(awkward.repartition(7))[0]
    assert mixed(no_rows)[0] == Counter() and mixed(awkward.where("text is null"))[0] == Counter({(1, 0, 0, 0.0, 0): 1})


def test_many_small_sources(spark):
    docs = [(i, "a b c", f"s{i % 400:03}") for i in range(500)]
    found, slots = mixed(spark.createDataFrame(docs, "doc_id long, text string, source string"), block_words=2)
    assert found == brute_taken(docs, 2)
    assert slots.groupBy("sid", "rank").count().where("count > 1").count() == 0


def brute_scores(docs, target, n, buckets, least=20, percent=10):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)[0]), Counter(bucket(f) for x in target for f in features(x)[0])
    big_s, big_t, rows = sum(s.values()), sum(t.values()), []
    for doc_id, text in docs:
        f, n_words = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in map(bucket, f))
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = percent * len(able) // 100
    return Counter([(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(able)] + [(*r[:4], None) for r in rows if r[4] < least])


@pytest.mark.parametrize(("n", "limit"), [(1, 10**6), (1, 5), (3, 10**6), (2, 40)])
def test_scores_equal_brute_force(spark, monkeypatch, n, limit):
    r = random.Random(n)
    vocabulary = ["The", "the", "bb", "c9", "Éa", "éa", "日本", "don't", "x-y", "A_b", "\x00", "q\x7fr"]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 3, 19, 20, 60])))) for i in range(120)]
    target = [" ".join(r.choice(vocabulary[:5]) for _ in range(30)) for _ in range(5)] + [None, ""]
    frame, wanted = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in target], "text string")
    trie, gains = importance.Trie(n, 97), None
    monkeypatch.setattr(importance, "MOST_NODES", limit)
    totals = np.zeros(97, np.int64)
    for _, text in docs:
        trie.count(importance.words(text.encode()))
        if trie.full:
            trie.pour(totals)
    trie.pour(totals)
    assert totals.tolist() == importance.bucket_totals(frame, n, 97)
    found = importance.resample(frame, wanted, n=n, buckets=97, percent=35)
    assert Counter(tuple(x) for x in found.collect()) == brute_scores(docs, target, n, 97, percent=35)


def test_scores_of_awkward_rows(spark, awkward, no_rows):
    benchmark = spark.createDataFrame([(1, "word1 word2 w3"), (2, None)], "item_id long, text string")
    got = importance.resample(awkward, benchmark, percent=50)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute_scores([(r.doc_id, r.text) for r in awkward.collect()], ["word1 word2 w3"], 1, 10_000, percent=50)
    assert importance.resample(no_rows, benchmark).collect() == []
    assert importance.resample(awkward, benchmark.limit(0), percent=0).where("rank is not null").count() == 0
    same = spark.createDataFrame([(1, "a " * 30)] * 50, "doc_id long, text string")
    assert sorted(r["rank"] for r in importance.resample(same, benchmark, percent=100).collect()) == list(range(1, 51))


@pytest.mark.parametrize("name", ["op12_source_mix", "op13_importance_resampling"])
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert got.columns == want.columns
    plain = lambda rows: Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert plain(got.collect()) == plain(want.fetchall())
    assert {t for _, t in got.dtypes} <= {"bigint", "double"}


def test_mixed_words_are_near_targets(spark):
    got = queries.op12_source_mix(spark, DATA)
    assert got.where("taken > 2 * size").count() == 0
    sums = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).collect()
    assert all(abs(r.taken - r.target) <= 1 for r in sums) and abs(sum(r.taken for r in sums) - 1.5 * sum(r["size"] for r in sums)) <= len(sums)
