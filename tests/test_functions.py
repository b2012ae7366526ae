"""Truth tables of scalar functions and predicates."""

from decimal import Decimal

from murmura.functions import numbers as N
from murmura.functions import text as X
from murmura.operators import reports as R
from murmura.operators import rules as L
from murmura.operators import vectors as V
from pyspark.sql import functions as F


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_gmv(spark):
    texts = ["8420", "33.6", "0-$5k", "$1,234", "15k", "12k", "none", None, ""]
    assert column(spark, texts, "string", N.gmv) == [8420.0, 33600.0, 2500.0, 1234.0, 5000.0, 12000.0, None, None, None]
    amounts = [5000.0, 5000.01, 1000.0, 999.99, 0.0, None]
    assert column(spark, amounts, "double", N.gmv_flag) == ["gmv_mid", "gmv_high", "gmv_mid", "gmv_low", "gmv_low", None]
    assert column(spark, amounts, "double", N.gmv_tier) == ["A", "A", "B", "C", "C", None]


def test_amounts_as_text(spark):
    assert column(spark, [100.0, 24.6, 49.25, 0.5, 98.4], "double", N.money_text) == ["100", "24.6", "49.25", "0.5", "98.4"]
    assert column(spark, ["12,300", "-4", "x", " 7 "], "string", N.count_or_null) == [12300, None, None, 7]
    assert column(spark, [0.0, 1.0, -0.5, None], "double", N.similarity) == [1.0, 0.5, 1.0, None]


def test_quotes(spark):
    texts = ["My minimum rate is $50", "gmv was $9000 but I charge $36.5 per video", "$5,000", "no amount", "$3 or $4"]
    found = column(spark, texts, "string", X.quote)
    assert [r and r.amount for r in found] == [Decimal("50.00"), Decimal("36.50"), Decimal("5.00"), None, Decimal("4.00")]


def test_text(spark):
    assert column(spark, ["a, b；c ,, ", None, "GEN"], "string", X.values) == [["a", "b", "c"], [], ["GEN"]]
    assert column(spark, ["GEN, gen ,x"], "string", lambda c: X.without_wildcards(X.values(c))) == [["x"]]
    assert column(spark, ["[10:00][creator:Ann] hi", "[--][seller] yo", "nothing"], "string", lambda c: F.concat_ws("|", *[X.line_part(c, p) for p in ("time", "role", "speaker", "body")])) == ["10:00|creator|Ann|hi", "--|seller||yo", "|||"]
    assert column(spark, ["abc 你", "你好 a", ""], "string", X.language_guess) == ["en", "zh", "zh"]
    assert column(spark, ["see https://a.example/x, (https://b.example) https://a.example/x."], "string", X.urls) == [["https://a.example/x", "https://b.example"]]
    assert column(spark, ["{a} ${b} {a} {c.d}"], "string", X.placeholders) == [["a", "b"]]
    assert column(spark, ["Hi", "Hi - Robin", "Hi\n— robin "], "string", lambda c: X.signed(c, "Robin")) == ["Hi\n\n- Robin"] * 3
    slots = {"a": "1", "long": "11"}
    assert column(spark, ["11 1"], "string", lambda c: X.desensitised(c, slots)) == ["{long} {a}"]
    assert column(spark, ["{long} {a} {b}"], "string", lambda c: X.restored(c, slots)) == ["11 1 {b}"]


def test_emotions(spark):
    cases = [("interested", None, True), ("refusal", None, False), ("refusal", "refusal", True), ("interested", "not_interested", False), (None, "refusal", True), ("interested", "neutral", True)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, r string, c string, want boolean")
    assert all(x.want == x.got for x in rows.withColumn("got", L.emotion_matches(F.col("r"), F.col("c"))).collect())


def test_shop_scope(spark):
    cases = [(["x", "y"], "f", "z", False), (["x", "y"], "f", "x", True), (["GEN"], "f", "z", True), ([], "z/a.txt", "z", True), ([], "y\\a.txt", "z", False), ([], "GEN/a", "z", True)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, shops array<string>, f string, shop string, want boolean")
    assert all(x.want == x.got for x in rows.withColumn("got", L.shop_in_scope(F.col("shops"), F.col("f"), F.col("shop"))).collect())


def test_rounds(spark):
    cases = [(0, False, True, "x", 1), (0, True, False, "x", 2), (3, False, True, "x", 3), (1, False, False, "final_offer", 3), (2, False, False, "price_reject", 2)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n int, flat boolean, reject boolean, intent string, want int")
    assert all(x.want == x.got for x in rows.withColumn("got", L.effective_round(F.col("n"), F.col("flat"), F.col("reject"), F.col("intent"))).collect())
    assert column(spark, [0, 1, 4, 5, None], "int", L.node_of_round) == [None, "A1", "A4", None, None]


def test_weeks(spark):
    times = ["2024-01-07 16:29:59", "2024-01-07 16:30:00", "2024-01-08 00:00:00", "2024-01-13 23:00:00"]
    start = lambda back: [str(x) for x in column(spark, times, "string", lambda c: R.week_start(c.cast("timestamp"), back))]
    assert start(False) == ["2023-12-31 16:30:00", "2024-01-07 16:30:00", "2024-01-07 16:30:00", "2024-01-07 16:30:00"]
    assert start(True) == ["2023-12-31 16:30:00", "2023-12-31 16:30:00", "2024-01-07 16:30:00", "2024-01-07 16:30:00"]


def test_rules_match_without_a_cross_join(spark):
    rules = [(1, ["x"], ["A"], [], ["price_reject"], None, []), (2, [], [], ["s1"], [], "refusal", []), (3, ["x", "y"], [], [], ["quote_too_low"], None, ["vip"]), (4, ["z"], [], [], [], None, [])]
    contexts = [(10, "x", ["A"], ["s1"], ["quote_too_low"], "refusal", ["vip"]), (11, "y", ["B"], [], ["greeting"], None, [])]
    r = spark.createDataFrame(rules, "rule_id int, shops array<string>, tiers array<string>, progress array<string>, intents array<string>, emotion string, flags array<string>")
    c = spark.createDataFrame(contexts, "context_id int, shop string, tiers array<string>, progress array<string>, intents array<string>, emotion string, flags array<string>")
    found = L.match_rules(r, c)
    assert {(x.context_id, x.rule_id) for x in found.collect()} == {(10, 1), (10, 2), (10, 3)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nearest_asks_in_blocks(spark):
    index = spark.createDataFrame([(i, [float(i == k) for k in range(4)]) for i in range(4)], "vec_id int, embedding array<float>")
    queries = index.selectExpr("vec_id as query_id", "embedding as vector")
    assert {(r.query_id, r.vec_id) for r in V.nearest(index, queries, 1).collect()} == {(i, i) for i in range(4)}
    assert sorted(V.nearest(index, queries, 1, most_queries=3).collect()) == sorted(V.nearest(index, queries, 1).collect())


def test_upsert(spark):
    state = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, None, 5)], "k int, v string, o int")
    assert {(r.k, r.v) for r in V.upserted(state, changes, ["k"], "o").collect()} == {(1, "a"), (2, "new"), (3, None)}
