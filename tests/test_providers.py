"""Plug points and fuzzy names."""

import random

import pytest

from murmura.operators import providers as P


def test_makers(spark):
    rows = spark.range(3)
    P.maker("halved for a test")(lambda df: df.where("id % 2 = 0"))
    try:
        assert P.made(rows, "halved for a test").count() == 2
        with pytest.raises(ValueError):
            P.maker("halved for a test")(lambda df: df)
        with pytest.raises(KeyError):
            P.made(rows, "none such")
    finally:
        del P.MAKERS["halved for a test"]


def test_embedding_in_batches(spark):
    rows = spark.createDataFrame([("1", "a b"), ("2", "a b"), ("3", " "), (None, "x"), ("", "y"), ("4", "other words")], "id string, text string")
    found = {r.id: r.embedding for r in P.embedded(rows, P.hashed_embedder(), batch=1).collect()}
    assert found.keys() == {"1", "2", "4"} and found["1"] == found["2"] != found["4"] and sum(x * x for x in found["1"]) == pytest.approx(1)
    with pytest.raises(ValueError):
        P.embedded(rows, P.hashed_embedder(), batch=0)
    with pytest.raises(Exception, match="1 texts, 0 vectors"):
        P.embedded(rows, lambda texts: [], batch=1).collect()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_names_equal_brute_force(spark):
    r = random.Random(4)
    catalog = ["".join(r.choice("abcd") for _ in range(r.randint(1, 60))) for _ in range(40)]
    asked = []
    for name in catalog:
        for _ in range(4):
            letters = list(name)
            for _ in range(r.randint(0, 4)):
                k = r.randrange(len(letters) + 1)
                letters[k : k + r.randint(0, 1)] = r.choice(["", "a", "x"])
            asked.append("".join(letters))
    catalog += [c + "y" for c in catalog[:5]]  # two names as near
    found = {x.declared: x.name for x in P.aligned_names(spark.createDataFrame([(a,) for a in asked], "declared string"), spark.createDataFrame([(c,) for c in catalog], "name string"), 0.9).collect()}
    for a in set(asked):
        near = {c for c in catalog if max(len(a), len(c)) and 1 - distance(a, c) / max(len(a), len(c)) >= 0.9}
        assert found[a] == (a if a in catalog else min(near) if len(near) == 1 else None), a
