"""Rules and contexts by signatures."""

import random

import pytest
from murmura.operators import common
from murmura.operators import conditions as C
from murmura.plans import registry
from murmura.plans.conditions import WORDS, contexts_of, rules_of
from pyspark.sql import functions as F

from .conftest import DATA
from .test_growth_of_work import copies_of, shuffled

KIND = "array<string>"


@pytest.fixture(scope="module")
def sides(spark):
    return rules_of(spark, DATA).cache(), contexts_of(spark, DATA).cache()


def pairs(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_names_are_registered_once():
    registry.query()(one := lambda spark, d: None)
    one.__name__ = "<lambda>"
    with pytest.raises(ValueError, match="registered by"):
        registry.query()(one)
    del registry.QUERIES["<lambda>"]


def test_registered_rules_are_the_full_ones():
    from murmura import plans

    found = {n: plans.queries()[n].__module__.rpartition(".")[2] for n in ("quote_extract", "catalog_names")}
    assert found == {"quote_extract": "replies", "catalog_names": "contexts"}


def test_work_grows_with_signatures_not_rows(spark, sides):
    rules, contexts = sides
    copies = lambda df, key, n: df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(key, F.col(key) * n + F.col("k")).drop("k")
    counts = []
    for n in (1, 5):
        (_, r), (_, c) = C.rule_signatures(copies(rules, "rule_id", n), WORDS), C.context_signatures(copies(contexts, "context_id", n), WORDS)
        counts.append(C.candidates(r, c).count())
        one = C.match_conditions(copies(rules, "rule_id", n), copies(contexts, "context_id", n), WORDS)
        assert one.count() == n * n * C.match_conditions(rules, contexts, WORDS).count()
    assert counts[0] == counts[1] > 0
    (_, r), (_, c) = C.rule_signatures(rules, WORDS), C.context_signatures(contexts, WORDS)
    halves = [C.candidates(r, c.where(F.crc32("context_signature") % 2 == x)).count() for x in (0, 1)]
    assert sum(halves) == counts[0]  # linear in signatures


def test_beyond_broadcasts_the_wildcard_is_dealt_out(spark, sides):
    (_, r), (_, c) = C.rule_signatures(sides[0], WORDS), C.context_signatures(sides[1], WORDS)
    assert pairs(C.match_signatures(r, c, WORDS, rows=0)) == pairs(C.match_signatures(r, c, WORDS))
    assert C.candidates(r, c, rows=0).count() == C.candidates(r, c).count()


@pytest.mark.parametrize("k", [1, 3, 10_000])
def test_first_rules_are_the_least_that_match(spark, sides, k):
    rules, contexts = sides
    met = {}
    for context, rule in pairs(C.match_conditions(rules, contexts, WORDS)):
        met.setdefault(context, []).append(rule)
    want = sorted((c, r, i + 1) for c, ids in met.items() for i, r in enumerate(sorted(ids)[:k]))
    assert sorted(pairs(C.first_rules(rules, contexts, WORDS, k))) == want


def test_bits_never_refuse_what_sets_allow(spark):
    r = random.Random(4)
    value = lambda n: [r.choice("abcdefghij") + str(r.randint(0, 9)) for _ in range(n)]
    rows = [(value(r.randint(0, 3)), value(r.randint(0, 60))) for _ in range(300)] + [([], []), (["a"], [])]
    rows += [(b[:2], b) for _, b in rows]
    found = spark.createDataFrame(rows, "a array<string>, b array<string>").withColumns({"x": C._bits(F.col("a")), "y": C._bits(F.col("b"))})
    found = found.withColumns({"bits": C._within("x", "y"), "sets": F.size(F.array_except("a", "b")) == 0})
    assert found.where("sets and not bits").count() == 0 and found.where("not bits").count() > 50


def test_order_and_repeats_in_a_field_are_no_difference(spark):
    schema = "context_id int, shop string, " + ", ".join(f"{f} {KIND}" for f in C.FIELDS)
    empty = [[]] * 7
    rows = [(1, "x", ["b", "a"], *empty), (2, "x", ["a", "b", "a", " GEN "], *empty), (3, "x", ["a"], *empty), (None, None, None, *[None] * 7)]
    own, signatures = C.context_signatures(spark.createDataFrame(rows, schema), WORDS)
    assert own.select("signature").distinct().count() == 3 == signatures.select("context_signature").distinct().count() and own.count() == 4


@pytest.mark.parametrize("any_shop", [False, True])
def test_condition_match_pairs_of_lists_are_no_rows_of_a_shuffle(spark, sides, monkeypatch, any_shop):
    for name, value in (("BROADCAST_IDS", 0), ("CONTEXT_LIST", 4), ("RULE_LIST", 4)):
        monkeypatch.setattr(common, name, value)
    rules, contexts = sides[0].where("rule_id < 60"), sides[1].where("context_id < 60")
    once = C.match_conditions(rules, contexts, WORDS, any_shop).count()
    make = lambda n: C.match_conditions(copies_of(rules, "rule_id", n), copies_of(contexts, "context_id", n), WORDS, any_shop)
    (few, small), (many, large) = shuffled(spark, make(80)), shuffled(spark, make(160))
    assert few == 80 * 80 * once > 0 and many == 4 * few
    assert large < 3 * small and large < many / 16
