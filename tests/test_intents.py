"""Intents: keyword lists of any length, and rankings case by case."""

import random

import pytest
from murmura.operators import intents as I
from pyspark.sql import functions as F

from .conftest import DATA


def brute(texts, words):
    out = {}
    for i, text in texts:
        for intent, word in {(x, w.lower()) for x, w in words}:
            if word and word in (text or "").lower():
                out[i, intent] = out.get((i, intent), 0) + (2 if len(word) > 4 else 1)
    return out


@pytest.mark.parametrize(("most", "block"), [(2_000, 100_000), (0, 100_000), (0, 7)])
def test_scores_by_any_way(spark, monkeypatch, most, block):
    monkeypatch.setattr(I, "MOST_WORDS", most)
    monkeypatch.setattr(I, "BLOCK", block)
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcé ") for _ in range(r.randint(1, 6))).strip()
    words = [(f"i{r.randint(0, 5)}", word().upper() if r.random() < 0.3 else word()) for _ in range(60)] + [("i1", "abc"), ("i1", "ABC"), ("i9", "")]
    texts = [(i, " ".join(word() for _ in range(r.randint(0, 12)))) for i in range(50)] + [(98, ""), (99, None)]
    got = I.keyword_scores(spark.createDataFrame(texts, "message_id long, text string"), spark.createDataFrame(words, "intent string, keyword string"))
    assert {(x.message_id, x.intent): x.score for x in got.collect()} == brute(texts, words) and got.count() == len(brute(texts, words))


def test_twenty_thousand_keywords(spark):
    words = spark.range(20_000).select(F.concat(F.lit("i"), F.col("id") % 50).alias("intent"), F.concat(F.lit("key"), "id").alias("keyword"))
    texts = spark.read.parquet(f"{DATA}/conversations.parquet").select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.concat_ws(" ", "text", F.concat(F.lit("key19999 and key"), F.col("turn"))).alias("text"))
    found = {(r.intent, r.score) for r in I.keyword_scores(texts, words).where("message_id = '0-0'").collect()}
    # key19999 holds key1, key19, key199 and key1999 too
    assert found == {("i1", 1), ("i19", 2), ("i49", 6), ("i0", 1)}


EXACT = [("agree", "ok", 3), ("stop", "STOP", 5)]
WORDS = [("price", "rate", 2), ("price", "quote", 2), ("group", "group", 1), ("sample", "sample", 2), ("GEN", "rate", 9)]


def rank(spark, message, allowed=(), refuses=False, **options):
    rules = lambda rows, name: spark.createDataFrame(rows, f"intent string, {name} string, priority int")
    rows = spark.createDataFrame([(1, message, list(allowed), refuses)], "message_id int, message string, allowed array<string>, refuses_price boolean")
    found = I.ranking(rows, rules(EXACT, "reply"), rules(WORDS, "keyword"), (("price", "sample"),), **options)
    row = found.select("intents", I.single(F.col("intents")).alias("one")).first()
    return [(x.intent, round(x.confidence, 4), x.matched_by) for x in row.intents], tuple(row.one)


@pytest.mark.parametrize(
    ("message", "allowed", "refuses", "want"),
    [
        (None, [], True, []), ("  ", [], False, []), (" OK ", [], False, [("agree", 0.9, "exact")]), ("ok", ["stop"], False, []), ("ok", ["agree"], True, [("agree", 0.9, "exact")]),
        ("your rate and a quote", [], False, [("price", 0.9, "keyword")]), ("group rate sample", [], False, [("sample", 0.9, "keyword"), ("group", 0.9, "keyword"), ("price", 0.675, "keyword")]),
        ("group rate", ["sample"], False, [("price", 0.675, "keyword")]), ("hello", [], False, [("No obvious intention", 0.65, "keyword")]), ("what", [], False, []),
        ("rate", [], True, [("CPM Rate", 0.92, "refined"), ("price", 0.9, "keyword")]), ("what", ["price"], True, []), ("stop", ["x"], True, []),
    ],
)
def test_ranking(spark, message, allowed, refuses, want):
    found, one = rank(spark, message, allowed, refuses)
    assert found == want
    assert one == ((want[0][0], "high" if want[0][1] >= 0.75 else "medium", want[0][2]) if want else ("GEN", "low", "none"))


def test_ranking_of_none_and_few(spark):
    assert rank(spark, "group rate sample", k=1)[0] == [("sample", 0.9, "keyword")]
    assert rank(spark, "group rate", least=0.7)[0] == [("group", 0.9, "keyword")]
