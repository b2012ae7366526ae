import random

import pytest
from murmura.functions import records as X
from murmura.operators import knowledge as K
from murmura.plans import queries
from pyspark.sql import functions as F

from .conftest import DATA


def greedy(rows, least):
    slots, values, out = set(), set(), []
    for group, slot, value, score in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if score >= least and (group, slot) not in slots and (group, value) not in values:
            slots.add((group, slot))
            values.add((group, value))
            out.append((group, slot, value, score))
    return sorted(out)


def test_assignment_is_greedy(spark):
    r = random.Random(3)
    rows = [(g, s, v, float(r.randrange(6))) for g in range(4) for s in range(8) for v in range(7) if r.random() < 0.6]
    found = K.assigned(spark.createDataFrame(rows, "shop long, slot long, value long, score double"), least=1.0)
    assert sorted(map(tuple, found.collect())) == greedy(rows, 1.0)
    assert K.assigned(spark.createDataFrame([], "shop long, slot long, value long, score double")).collect() == []


def test_assignment_of_orders(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").selectExpr("l_orderkey", "l_partkey % 5", "l_suppkey % 5", "cast(l_quantity as double) q").groupBy("l_orderkey", "(l_partkey % 5)", "(l_suppkey % 5)").agg(F.max("q"))
    found = queries()["slot_assignment"](spark, DATA).collect()
    assert sorted(map(tuple, found)) == greedy(list(map(tuple, lines.collect())), 5.0)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [
        (None, None), ("", []), ("  ", []), ("free text", [("1", "free text")]),
        ("before\n1. one\n more \n\n2.\n3. three", [("1", "one\n more"), ("3", "three")]), ("1.one 2. two", [("1", "one 2. two")]),
    ],
)
def test_numbered_items(spark, text, want):
    found = one(spark, X.numbered_items(F.col("t")), t=text)
    assert (found and [tuple(x) for x in found]) == (want or found)
    assert found or not want


@pytest.mark.parametrize(
    "info, want",
    [(None, ""), ("", ""), (" plain ", "plain"), ("{broken}", "{broken}"), ('{"10":"c","9":"b","x":"d","-":null,"2":" a "}', "a\nb\nc\nd"), ("{}", "")],
)
def test_message_text(spark, info, want):
    assert one(spark, X.message_text(F.col("t")), t=info) == want


@pytest.mark.parametrize("raw, want", [("  Send flat-fee  offer!", "send_flat_fee_offer"), ("", ""), ("Add to DNC list, stop all outreach", "mark_dnc"), (" Send CPM offer + estimate", "send_cpm_offer"), ("Log creator’s 报价", "log_creators_报价"), ("log creator's minimum rate to quote sheet", "log_creator_quote"), (" - ", "_"), ("!", ""), (None, None)])
def test_action(spark, raw, want):
    assert one(spark, X.action(F.col("t")), t=raw) == want


@pytest.mark.parametrize("text, want", [(None, False), ("", False), ("No!!", True), ("I can't do that", True), ("not sure", False), ("passable", False)])
def test_refuses(spark, text, want):
    assert one(spark, X.refuses(F.col("t")), t=text) is want


@pytest.mark.parametrize(
    "rule, context, want",
    [([], [], True), (["a"], [], False), (["a"], ["a=1"], True), (["a=2"], ["a=1"], False), (["price_negotiation_rounds=2"], ["negotiation_rounds=2"], True), (["price_negotiation_rounds"], ["negotiation_rounds=2"], False)],
)
def test_progress(spark, rule, context, want):
    assert one(spark, X.progress_matches(F.col("r"), F.col("c")), r=rule, c=context) is want


def test_small_text_functions(spark):
    t = F.col("t")
    assert one(spark, X.header(t), t=" Creator — Type ") == "creator-type"
    assert one(spark, X.tokens(t), t="Over 15k, over 15K") == ["over", "15k"]
    assert one(spark, X.unfenced(t), t="```json\n{}\n```") == "{}"
    assert one(spark, X.shortened(t, 5), t="four five") == "four..." and one(spark, X.shortened(t, 5), t=None) == ""
    assert one(spark, X.json_list(t), t='["a", "b"]') == ["a", "b"] and one(spark, X.json_list(t), t="a") == ["a"] and one(spark, X.json_list(t), t=" ") == []
    assert one(spark, X.canonical_intent(t), t="Price  Negotiation") == "Price"


def test_fields_and_filters(spark):
    rows = spark.createDataFrame([(1, ["a"], None), (2, [], ["x", "y"])], "id long, shops array<string>, tiers array<string>")
    assert sorted(map(tuple, K.fields_of(rows, "id", ["shops", "tiers"]).collect())) == [(1, "shops", "a"), (2, "tiers", "x"), (2, "tiers", "y")]
    data = spark.createDataFrame([("s", 1), ("t", 2), ("GEN", 3)], "shop string, n long")
    assert {r.n for r in data.where(K.where_of({"shop": ["s", "GEN"], "n": None})).collect()} == {1}
    assert data.where(K.where_of({"shop": "gen"})).count() == 3
