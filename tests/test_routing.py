"""Replies by stages: the nine tests, restoring and signing, gates and routes."""

import pytest
from murmura.functions import guard as G
from murmura.operators import routing as W
from murmura.plans import routing as P
from murmura.sources.requests import requests
from pyspark.sql import functions as F

from .conftest import DATA

GUARD = "reply string, authorised array<string>, required array<string>, must array<string>, allowed string"


def values(spark, column, *rows, schema="m string"):
    return [r[0] for r in spark.createDataFrame([x if isinstance(x, tuple) else (x,) for x in rows], schema).select(column).collect()]


def test_nine_tests_in_order(spark):
    sign = "\n\n— Ada"
    cases = [
        (None, [], [], [], "", "empty_reply"), ("  ", [], [], [], "", "empty_reply"), ("hello", [], [], [], "", "missing_signature"), ("hello - ada ", [], [], [], "", "ok"),
        ("hi [name]" + sign, [], [], [], "", "placeholder_in_reply"), ("hi {a_b}" + sign, [], [], [], "", "placeholder_in_reply"), ("hi {a1}" + sign, [], [], [], "", "ok"),
        ("see https://a.example/x." + sign, ["https://a.example/x"], [], [], "", "ok"), ("see https://b.example" + sign, ["https://a.example/x"], ["https://c"], [], "", "unauthorized_url"), ("see wa.me/123" + sign, [], [], [], "", "unauthorized_url"),
        ("hi" + sign, ["https://a"], ["https://a"], ["https://a"], "", "missing_required_url"), ("hi" + sign, [], [], ["CODE"], "", "missing_key_information"), ("CODE" + sign, [], [], ["CODE"], "", "ok"),
        ("$ 5 and 7%" + sign, [], [], [], "", "unauthorized_money"), ("$5 and 7%" + sign, [], [], [], "we said $5", "unauthorized_percent"), ("7% within 3 business days" + sign, [], [], [], "7%", "unauthorized_deadline"),
        ("7% within 3 days, $1,200.50" + sign, [], [], [], "7% Within $1,200.50 within 3 days", "ok"), ("in 2 weeks" + sign, [], [], [], None, "unauthorized_deadline"),
    ]
    got = values(spark, G.verdict(F.col("reply"), F.col("authorised"), F.col("required"), F.col("must"), F.col("allowed"), "Ada"), *[c[:5] for c in cases], schema=GUARD)
    assert got == [c[5] for c in cases]


def test_signatures(spark):
    assert values(spark, G.signed(F.col("m"), "Ada"), "Hi", "Hi\n\n— Ada", "Hi - ada  ", "Hi—Ada\n", "", "  ", None) == ["Hi\n\n— Ada"] * 4 + [""] * 3


def test_restoring(spark):
    rows = [("{a} {{b}} {c}", {"a": "1", "b": "2", "c": None}), ("{a}", None), (None, {"a": "1"})]
    assert values(spark, G.restored(F.col("m"), F.col("v")), *rows, schema="m string, v map<string,string>") == ["1 {2} {c}", "{a}", ""]


def test_earnings(spark):
    got = values(spark, G.earnings(F.col("v"), F.col("n"), F.col("c")), (12300, None, ""), (12300, 0, " Ann "), (5215, 2, None), (None, 3, "x"), (-5, -1, None), (1_000_000_000, 4, None), schema="v int, n int, c string")
    assert got[0] == {"avgVV": "12,300", "videoCount": "4", "total": "98.4", "avgVV*0.002": "24.6", "avgVV*0.004": "49.2", "avgVV*0.003": "36.9", "avgVV*0.0015": "18.45"}
    assert got[1] == got[0] | {"creator": "Ann"} and got[2]["avgVV*0.003"] == "15.64" and got[3] is None and got[4]["total"] == "0" and got[4]["videoCount"] == "1"
    assert got[5]["avgVV"] == "1,000,000,000" and got[5]["total"] == "8000000"
    lacks = G.lacks_earnings(F.col("m"), F.create_map(F.lit("avgVV*0.002"), F.lit("24.6")))
    assert values(spark, lacks, "about $24.6", "you get $ 3", "you get a lot", "", None) == [False, False, True, False, False]


def test_required_and_authorised(spark):
    row = (["group", "other", "plain"], ["Group Link"], "see https://s.example/1, https://s.example/2", {"group": "go https://g.example.", "other": None, "plain": " CODE ", "x_group_link": "https://t.example"})
    schema = "slots array<string>, tags array<string>, script string, v map<string,string>"
    args = [F.col(c) for c in ("slots", "tags", "script", "v")]
    none = ([], ["T"], row[2], row[3])
    assert values(spark, G.required_urls(*args), row, none, (row[0], [], row[2], row[3]), (None, None, None, None), schema=schema) == [["https://g.example"], ["https://s.example/1"], [], []]
    assert values(spark, G.required_values(*args), row, none, (row[0], [], row[2], row[3]), schema=schema) == [["go https://g.example.", "CODE"], ["https://s.example/1", "https://s.example/2"], []]
    assert values(spark, G.tag_urls(F.col("tags"), F.col("v")), row, (None, None, None, None), schema=schema) == [["https://t.example"], []]
    assert values(spark, G.slot_urls(F.col("slots"), F.col("v")), (None, None, None, None), schema=schema) == [[]]


@pytest.fixture(scope="module")
def stages(spark):
    return P._stages(spark, DATA)


def test_every_request_is_decided_once(spark, stages):
    asked = requests(spark, DATA)
    counts = {name: df.count() for name, df in stages.items()}
    assert sum(counts.values()) == asked.count() == W.united(stages).select("request_id").distinct().count() and all(counts.values())
    found = {(r.status, r.mode) for r in W.united(stages).select("status", "mode").distinct().collect()}
    assert {s for s, _ in found} == {"withdrawn", "silent", "goodbye", "messenger", "no_match", "replied", "rejected"}
    assert ("replied", "draft") in found and ("replied", "reference_script") in found


def test_what_is_sent_passes_and_what_fails_is_not_sent(spark, stages):
    done = stages["validation"]
    assert done.where("status = 'rejected' and reply <> ''").count() == 0 == done.where("status = 'replied' and not endswith(reply, '— Ada')").count()
    reasons = {r.reason for r in done.select("reason").distinct().collect()}
    assert reasons >= {"ok", "empty_reply", "unauthorized_url", "unauthorized_money", "unauthorized_percent", "unauthorized_deadline", "placeholder_in_reply", "missing_required_url"}
    assert stages["rules"].where("rule_id is not null or reply <> ''").count() == 0


def test_later_stages_see_open_rows_only(spark):
    decided, open_ = W.split(spark.range(10), F.when(F.col("id") < 3, "first"))
    assert sorted(r.id for r in decided.collect()) == [0, 1, 2] and sorted(r.id for r in open_.collect()) == list(range(3, 10)) and open_.columns == ["id"]


def test_no_requests(spark):
    found = W.route(requests(spark, DATA).limit(0), P.script_rules(spark, DATA), P.shop_values(spark), P.HEAD, "Ada", "north")
    assert W.united(found).collect() == [] and tuple(W.united(found).columns) == W.OUTCOME
    found = W.route(requests(spark, DATA).limit(40), P.script_rules(spark, DATA).limit(0), P.shop_values(spark).limit(0), P.HEAD, "Ada", "north")
    assert found["validation"].count() == 0 and W.united(found).count() == 40


def test_refusals_last(spark):
    rows = [("no", None, None, None), ("fine", "Reject", None, None), ("fine", None, "stop", None), ("fine", None, None, " STOP_outreach"), ("fine", "GEN", "x", "y"), (None, None, None, None)]
    assert values(spark, W.refusing(*[F.col(c) for c in "mira"]), *rows, schema="m string, i string, r string, a string") == [True] * 4 + [False] * 2
