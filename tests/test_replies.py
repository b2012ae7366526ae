"""Quotes, refusals, intents, conditions, slots and plans, case by case."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from murmura.functions import quotes as Q
from murmura.functions import replies as R
from murmura.functions import values as V
from murmura.operators import conditions as C
from murmura.operators import structuring as K
from murmura.plans.conditions import WORDS


def values(spark, column, *rows, schema="m string"):
    return [r[0] for r in spark.createDataFrame([x if isinstance(x, tuple) else (x,) for x in rows], schema).select(column).collect()]


def test_quotes(spark):
    found = values(spark, Q.quote(F.col("m")), "my rate is $150 per video", "GMV is 9000 usd, I want 200 dollars", "$12345678901234567890", "$0", "$5,000", None, "", "no amount", "min $80/video or $90", "sales $9999999 " * 40 + "asking $70")
    got = [None if f is None else (f.amount_usd, f.confidence) for f in found]
    assert got[0] == (Decimal(150), "high") and got[1] == (Decimal(200), "low") and got[2:4] == [None, None] and got[4] == (Decimal(5), "low")
    assert got[5:8] == [None] * 3 and got[8] == (Decimal(90), "high") and got[9] == (Decimal(70), "high")
    assert found[0].raw_match == "$150 per video"


def test_very_long_text_of_amounts(spark):
    text = "want $7 " + "price $3 " * 3_000
    assert values(spark, Q.quote(F.col("m"))["amount_usd"], text) == [Decimal(7)]


def test_scenarios(spark):
    empty = F.array().cast("array<string>")
    scene = lambda node=None, yes=True: Q.quote_scenario(F.lit(yes), F.col("m"), F.lit("GEN"), F.lit(None).cast("string"), R.reply_flags(F.col("m")), F.array(F.lit(node)) if node else empty)
    assert values(spark, scene(), "my rate is $5", "ok", None) == ["creator_quote", None, None]
    assert values(spark, scene("priority_node:A3"), "ok", "hm", "sounds good") == ["flat_fee_agreed", None, "flat_fee_agreed"]
    assert values(spark, scene("priority_node:A4"), "$5", "five") == ["creator_quote", None]
    assert values(spark, scene(yes=False), "my rate is $5") == [None]


def test_flags_and_refusals(spark):
    assert values(spark, R.reply_flags(F.col("m")), "OK", " yes", "stop", "I won't", "they declined", "bottom line $5", "", None, "hm") == [["reply_ok"], ["reply_yes", "reply_interested"], ["reply_reject"], ["reply_reject"], ["reply_reject"], ["reply_quote"], [], [], []]
    assert values(spark, R.refuses_outreach(F.col("m")), "Nah!", "decline.", "I pass on it", "unsubscribe", "not for me", "sure", "", None) == [True, True, True, True, True, False, False, False]
    assert values(spark, R.rejects_price(F.col("m"), F.lit("a commission-only plan")), "too low", "fine", None) == [True, False, False]


def test_messenger(spark):
    said = ["I don't have WhatsApp", "my whatsapp is +44 7700 900123", "can't find it", "joined!", "hello", None]
    assert values(spark, R.messenger_answer(F.col("m")), *said) == ["no_whatsapp", "shared_number", "not_found", "joined", None, None]
    step = R.next_step(F.col("p"), F.col("a"))
    rows = [([R.SAMPLE_ASKED], "joined"), ([R.SHOWCASED, R.SAMPLE_NOT_ASKED], "joined"), ([], "joined"), ([R.NOT_SHOWCASED], "not_found"), ([R.SHOWCASED], "no_whatsapp"), (["x"], "joined")]
    assert values(spark, step, *rows, schema="p array<string>, a string") == ["sample_review", "sample", "showcase", "showcase", "sample", "showcase"]


def test_effects(spark):
    rows = [("mark_dnc", "c", ""), ("log_creator_quote", "c", "rate is $9"), ("log_creator_quote", "c", "no"), ("join_wa_1", " ", ""), ("other", "c", ""), (None, "c", "")]
    found = values(spark, R.effect(F.col("a"), F.col("c"), F.col("m")), *rows, schema="a string, c string, m string")
    assert [f and (f.kind, f.target, f.value) for f in found] == [("reject", "shop_rejected", "true"), ("quote", "expert_quote", "9.00"), ("none", None, None), None, None, None]


def rule(i, **fields):
    return {"rule_id": i, "shops": [], "source_file": "GEN/x", **dict.fromkeys(C.FIELDS, []), **fields}


def context(i, **fields):
    return {"context_id": i, "shop": "Brand#11", **dict.fromkeys(C.FIELDS, []), **fields}


KINDS = ", ".join(f"{f} array<string>" for f in C.FIELDS)


@pytest.mark.parametrize(
    ("r", "c", "met"),
    [
        ({}, {}, True), ({"shops": ["Brand#11"]}, {}, True), ({"shops": ["Brand#12"]}, {}, False), ({"shops": ["Brand#11", "Brand#12"]}, {}, False), ({"shops": ["gen"]}, {}, True), ({"shops": None}, {}, True),
        ({"source_file": "Brand#11\\x"}, {}, True), ({"source_file": "other/x"}, {}, False), ({"source_file": None}, {}, False), ({"source_file": None}, {"shop": None}, True), ({"source_file": "other/x"}, {"shop": " gen "}, True),
        ({"tiers": ["head"]}, {"tiers": ["A-level"]}, True), ({"tiers": ["head"]}, {"tiers": ["A-level"], "shop": "Brand#33"}, False), ({"tiers": ["head"]}, {}, False), ({"tiers": ["GEN", " "]}, {}, True),
        ({"tiers": ["head", "B-level"]}, {"tiers": ["sampled", "S-level"]}, True), ({"all_tiers": ["x"]}, {}, True), ({"all_tiers": ["x", "y"]}, {"all_tiers": ["x"]}, False), ({"types": ["x"]}, {"types": ["x", "y"]}, True),
        ({"intents": ["earnings"]}, {"intents": ["cpm"]}, True), ({"intents": ["flat_fee"]}, {"intents": ["cpm"]}, False), ({"intents": ["earnings", "quote"]}, {"intents": ["quote"]}, True), ({"intents": ["cpm"]}, {}, False),
        ({"emotions": ["bored"]}, {"emotions": ["annoyed"]}, False), ({"emotions": ["bored", "pleased"]}, {"emotions": ["bored"]}, True), ({"emotions": ["pleased"]}, {}, True), ({"emotions": ["pleased"]}, {"emotions": ["bored"]}, False),
        ({"progress": ["Step = two"]}, {"progress": ["step=two"]}, True), ({"progress": ["step"]}, {"progress": ["step=one"]}, True), ({"progress": ["step=one"]}, {"progress": ["step"]}, False),
        ({"progress": ["price_negotiation_rounds=1"]}, {"progress": ["negotiation_rounds=1"], "tiers": ["head"]}, True), ({"progress": ["price_negotiation_rounds=1"]}, {"progress": ["negotiation_rounds=1"], "tiers": ["B-level"]}, False),
        ({"progress": ["price_negotiation_rounds"]}, {"progress": ["price_negotiation_rounds=1"], "tiers": ["head"]}, False),
        ({"flags": ["vip"]}, {"flags": ["new", "vip"]}, True), ({"flags": ["vip"]}, {}, False), ({"flags": ["priority_node:A1"]}, {"flags": ["priority_node:A1"]}, False), ({"flags": ["priority_node:A1"]}, {"flags": ["priority_node:A1"], "tiers": ["S-level"]}, True),
    ],
)
def test_conditions(spark, r, c, met):
    rules = spark.createDataFrame([rule(1, **r)], f"rule_id long, shops array<string>, source_file string, {KINDS}")
    contexts = spark.createDataFrame([context(7, **c)], f"context_id long, shop string, {KINDS}")
    assert [tuple(x) for x in C.match_conditions(rules, contexts, WORDS).collect()] == [(7, 1)] * met


def test_conditions_of_repeated_rows_and_none(spark):
    rules = spark.createDataFrame([rule(1, shops=["Brand#11", "Brand#12"])] * 2, f"rule_id long, shops array<string>, source_file string, {KINDS}")
    contexts = spark.createDataFrame([context(7), context(8, shop="Brand#12"), context(9, shop="x")], f"context_id long, shop string, {KINDS}")
    assert sorted(map(tuple, C.match_conditions(rules, contexts, WORDS, any_shop=True).collect())) == [(7, 1), (7, 1), (8, 1), (8, 1)]
    assert C.match_conditions(rules.limit(0), contexts, WORDS).collect() == [] == C.match_conditions(rules, contexts.limit(0), WORDS).collect()


def test_values(spark):
    assert values(spark, V.confidence(F.col("m")), "high", " LOW", "0.7", "9", "-1", "x", None) == [0.9, 0.35, 0.7, 1.0, 0.0, None, None]
    assert values(spark, V.with_query(F.col("m"), "t", F.lit("9")), "http://a/b", "http://a/b?x=1#f", "http://a/b?t=1&x=2", "http://a/b?x=2&t=1") == ["http://a/b?t=9", "http://a/b?x=1&t=9#f", "http://a/b?x=2&t=9", "http://a/b?x=2&t=9"]
    assert values(spark, V.table_text(F.col("m")), [["a", None], [" ", ""], ["b", "c "]], schema="m array<array<string>>") == ["a | \nb | c"]
    assert values(spark, V.same_text(F.col("m"), F.lit("aB")), " Ab ", "b", None) == [True, False, None]
    assert V.merged_tree({"a": {"b": [1, 2]}, "c": 1}, {"a": {"b": [2, 3, 3]}, "c": None, "d": 2}) == {"a": {"b": [1, 2, 3]}, "c": 1, "d": 2}


def test_scripts(spark):
    row = [("Use ${a} and {b}", {"a": "X", "b": "Y"}), (None, None), ("{a}", {})]
    assert values(spark, K.prepared_script(F.col("t"), F.lit(" own "), F.col("s")), *row, schema="t string, s map<string,string>")[0] == "Use X and Y"
