"""Slots and candidates against brute force over all pairs."""

import random
import re

import pytest
from murmura.operators import slots as S
from murmura.operators.common import if_small
from pyspark.sql import functions as F

DOC = "shop string, source_file string, text string"


def found(spark, *rows):
    return [r.asDict() for r in S.candidates(spark.createDataFrame(rows, DOC)).orderBy("source_file", "begin").collect()]


def test_candidates(spark):
    text = "Join https://chat.example/a?x=1). Rate is 12.5 % or 8%; $1,200.50 and $36, v1.5% no. https://fonts.gstatic.com/s"
    rows = found(spark, ("s", "s/page.html", text), ("s", "s/none.txt", None), (None, None, "$5"))
    assert not any(r["kind"] == "url" for r in rows) and len(rows) == 6  # a font nearby: links go as assets
    far = text.replace("https://fonts", " ." * 80 + "https://fonts")
    rows = found(spark, ("s", "s/page.html", far))
    assert [(r["kind"], r["value"], r["role"]) for r in rows] == [("url", "https://chat.example/a?x=1", "illustrative"), ("percent", "12.5%", "illustrative"), ("percent", "8%", "illustrative"), ("money", "$1,200.50", "illustrative"), ("money", "$36", "illustrative"), ("percent", "1.5%", "illustrative")]
    for r in rows:
        assert r["context"][r["value_at"] :].startswith(r["value"][:3]) or "%" in r["value"]


@pytest.mark.parametrize(
    ("file", "text", "kept"),
    [
        ("s/add1.txt", "width: 40%", []), ("s/add1.txt", "PRIORITY 0 is 40%", ["40%"]), ("s/notes.txt", "PRIORITY 0 is 40%", []), ("s/add1.txt", "PRIORITY 0 is $40", []), ("s/notes.txt", "PRIORITY 0 is $40", ["$40"]),
        ("s/add1.txt", "for @ann $40", []), ("s/add1.txt", "GMV of $1,000", []), ("s/add1.txt", "GMV of $999", ["$999"]), ("s/add1.txt", "monthly $1000", []), ("s/supplement-x.md", "pay $7", ["$7"]), ("s/add1.txt", "", []),
        ("s/add1.txt", "see https://w3.org/x", []), ("s/add1.txt", "go to https://a.example/2You", ["https://a.example/2"]),
    ],
)
def test_noise(spark, file, text, kept):
    assert [r["value"] for r in found(spark, ("s", file, text))] == kept


def brute_tokens(text):
    low = text.lower()
    return set(re.findall("[a-z0-9]+", low)) | set(re.findall(r"\d+k", low))


def brute_score(slot, c):
    """The rule as the survey words it, for one pair."""
    tokens, context, value, at = brute_tokens(slot.replace("_", " ")), c["context"], c["value"], c["value_at"]
    inside = brute_tokens(value)
    before, near, after = context[max(0, at - 48) : at], context[max(0, at - 32) : at], context[at + len(value) : at + len(value) + 24]
    score = len(tokens & (brute_tokens(context) | inside)) / len(tokens)
    score += 0.35 * sum(t in inside or len(t) >= 2 and t in value.lower() for t in tokens) / len(tokens)
    roles = {k for k, p in S.NEAR_SIGNS.items() if re.search(p, near)}
    wide = {k for k, p in S.WIDE_SIGNS.items() if re.search(p, before)}
    signs = roles or wide
    score += 0.25 * sum(x in tokens and x in signs for x in ("gte", "lt")) - 0.35 * (("gte" in tokens and "lt" in signs) + ("lt" in tokens and "gte" in signs))
    score += 0.35 * sum(x in tokens and x in roles for x in ("first", "per"))
    score -= 0.4 * (("first" in tokens and "per" in roles and "first" not in roles) + ("per" in tokens and "first" in roles and "per" not in roles))
    kind = kind_of(slot)
    score += 0.05 * (kind == c["kind"])
    if kind == "percent" and "commission" in tokens and not re.search("commission|佣金|rate|percent", context, re.I):
        score -= 0.4
    video = re.search("AI视频|ai video|带货成功", before + after, re.I)
    link = re.search("这条链接", before, re.I)
    if "ai_video" in slot and "commission" in slot:
        score += 0.65 if video else -0.55 if re.search("这条链接|挂链|affiliate", before, re.I) else 0
    if slot == "commission_rate_gmv_gte_1k":
        score += 0.65 * bool(re.search("1k ?以上", before, re.I)) - 0.55 * bool(re.search("1k ?以下", before, re.I))
    if slot == "commission_rate_gmv_lt_1k":
        score += 0.7 * bool(link) - 0.55 * bool(re.search("1k ?以上", before, re.I)) - 0.55 * bool(video)
    return round(score, 6)


def kind_of(slot):
    if slot.endswith(("_pct", "_rate")) or "commission_rate" in slot:
        return "percent"
    if "_usd" in slot or "bonus" in slot or "per_video" in slot:
        return "money"
    return "url" if any(k in slot for k in ("link", "portal", "form", "group", "url")) else "any"


SLOTS = ["affiliate_link", "apply_form_url", "commission_rate_gmv_gte_1k", "commission_rate_gmv_lt_1k", "ai_video_commission_pct", "first_video_bonus_usd", "per_video_usd", "note", "x_rate", "a"]


def documents(r, n):
    parts = ["first video $36", "per video pays $5", "https://formhub.example/a", "https://chat.example/affiliate", "佣金 1k以上 12%", "1k以下 8%", "这条链接 9%", "AI视频 带货成功 7%", "commission rate over 5%", "a note $2", "below $3", "affiliate 4%", "1k 以上 commission 11%", "plain words", "首次 $8 每条 $9"]
    return [(f"s{i % 3}", f"s{i % 3}/add{i}.txt" if i % 4 else f"s{i % 3}/p{i}.html", " ".join(r.choice(parts) + r.choice([" ", "\n", " . " * 40]) for _ in range(r.randint(0, 9)))) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_values_equal_greedy_choice_over_all_pairs(spark, seed):
    r = random.Random(seed)
    docs = documents(r, 12)
    slots = [(f"s{k}", s, i) for k in range(4) for i, s in enumerate(SLOTS)]
    frame = spark.createDataFrame(docs + docs[:3], DOC)
    rows = [c for c in (x.asDict() for x in S.candidates(spark.createDataFrame(docs, DOC)).collect()) if c["role"] == "authoritative"]
    want, pairs = {}, []
    for shop, slot, place in slots:
        for c in rows:
            if c["shop"] == shop and kind_of(slot) in ("any", c["kind"]) and (score := brute_score(slot, c)) >= 0.15:
                order = (c["source_file"], ["url", "percent", "money"].index(c["kind"]), c["begin"])
                pairs.append((-score, place, order, shop, slot, c))
    used = set()
    for worse, _, order, shop, slot, c in sorted(pairs, key=lambda p: p[:3]):
        take = (shop, "take", c["value"] if c["kind"] == "url" else order)
        if (shop, slot) not in used and take not in used:
            used |= {(shop, slot), take}
            want[shop, slot] = (c["value"], c["source_file"], -worse)
    got = {(x.shop, x.slot): (x.value, x.source_file, x.score) for x in S.slot_values(spark.createDataFrame(slots, "shop string, slot string, place int"), frame).collect()}
    assert len(got) == len(slots) and got == {(s, n): want.get((s, n), (None, None, None)) for s, n, _ in slots} and len(want) > 8


def test_no_slots_no_documents(spark):
    slots, docs = spark.createDataFrame([("s", "a_link", 0)], "shop string, slot string, place int"), spark.createDataFrame([("s", "s/add1.txt", "a link https://a.example")], DOC)
    assert S.slot_values(slots.limit(0), docs).collect() == []
    assert [tuple(r) for r in S.slot_values(slots, docs.limit(0)).collect()] == [("s", "a_link", None, None, None)]
    assert S.slot_values(slots, docs).where(F.col("value") == "https://a.example").count() == 1


@pytest.mark.parametrize("vocabulary", [0, 200])
def test_candidates_are_read_once_and_never_broadcast(spark, monkeypatch, vocabulary):
    """Sizes by files say that each side is small; beyond a count of rows none may go to the driver."""
    monkeypatch.setattr(S, "VOCABULARY", vocabulary)
    monkeypatch.setattr(S, "if_small", lambda df: if_small(df, 5))
    docs = spark.createDataFrame(documents(random.Random(7), 12), DOC)
    slots = spark.createDataFrame([(f"s{k}", s, i) for k in range(4) for i, s in enumerate(SLOTS)], "shop string, slot string, place int")
    found = S.candidates(docs).withColumn("candidate", F.struct("shop", "source_file", "begin"))
    pairs = S.scored_pairs(slots, found)
    made = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in made and made.count("MapInPandas") == 1
    want = {(c["shop"], s, c["source_file"], c["begin"]): brute_score(s, c) for c in (x.asDict() for x in found.collect()) for s in SLOTS if kind_of(s) in ("any", c["kind"])}
    got = {(x.shop, x.slot, x.candidate.source_file, x.candidate.begin): x.score for x in pairs.collect()}
    assert got == {k: v for k, v in want.items() if v >= 0.15} != {}
    assert "Broadcast" not in S.slot_values(slots, docs)._jdf.queryExecution().executedPlan().toString()
