"""Quotes in messages: which dollar amount is the offer, and in which situation one is looked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

#: An amount in dollars, what near it makes it a quote, an agreed fee, and words that accept.
AMOUNT = r"(?i)(?:\$\s*([0-9]{1,7}(?:\.[0-9]{1,2})?)|([0-9]{1,7}(?:\.[0-9]{1,2})?)\s*(?:usd|dollars?))(?:\s*(?:/|\bper\b)\s*video|\s*per\s+vid\b)?"
HINT = r"(?i)(?:min(?:imum)?|my\s+(?:rate|price|quote)|need\s+at\s+least|rate\s+is|bottom\s*line|quoted|asking|want\s+\$|\$[0-9]+\s+is\s+(?:too\s+)?low)"
PER_VIDEO = r"(?i)per\s+video|/video"
AGREED = r"(?i)that'?s\s+\$\s*([0-9]{1,7}(?:\.[0-9]{1,2})?)\s+per\s+video"
FLAT_FEE = r"(?i)flat\s+(?:rate|fee)|one[- ]video|cpm\s+capped|that'?s\s+\$\s*([0-9]{1,7}(?:\.[0-9]{1,2})?)\s+per\s+video"
ACCEPTS = r"(?i)\b(deal|sounds good|let'?s do it|i accept|accepted|ok(?:ay)?|sure|yes)\b"
#: Characters on each side that count as near, and the largest amount.
NEAR, LARGEST = 40, 1_000_000


def quote(text: Column, prefer_hints: bool = True) -> Column:
    """struct(amount_usd, raw_match, confidence, score) of the amount that is most likely a quote; null without one.

    Each amount over 0 and up to LARGEST scores 3 for a hint within NEAR characters on either side, 2 for a price per video, 1
    for a dollar sign, 0.5 from 5 to 5000; without prefer_hints, 0.1 if that is under 2. The best score wins, then the larger
    amount, then the earlier. Amounts have no thousands separators: $5,000 is 5. Null, blank and very long texts are fine.
    """
    def parts(body: Column) -> Column:
        raws = F.regexp_extract_all(body, F.lit(AMOUNT), 0)
        values = [F.regexp_extract_all(body, F.lit(AMOUNT), i).alias(f"v{i}") for i in (1, 2)]
        return F.struct(body.alias("body"), raws.alias("raws"), F.split(body, AMOUNT).alias("pieces"), *values)

    def with_ends(p: Column) -> Column:
        # where each amount ends: a running sum, one step an amount
        steps = F.transform(p["raws"], lambda r, i: F.length(F.get(p["pieces"], i)) + F.length(r))
        ends = F.aggregate(steps, F.array().cast("array<int>"), lambda done, n: F.array_append(done, F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + n))
        return F.struct(p.alias("p"), ends.alias("ends"))

    def scores(x: Column) -> Column:
        p = x["p"]

        def scored(raw: Column, i: Column) -> Column:
            amount = F.coalesce(F.nullif(F.get(p["v1"], i), F.lit("")), F.nullif(F.get(p["v2"], i), F.lit(""))).try_cast("decimal(18,2)")
            end = F.get(x["ends"], i)
            begin = F.greatest(end - F.length(raw) - NEAR, F.lit(0))
            return F.struct(amount.alias("amount"), raw.alias("raw"), F.substring(p["body"], begin + 1, end + NEAR - begin).alias("window"), (-i).alias("place"))

        def score(y: Column) -> Column:
            points = F.when(y["window"].rlike(HINT), 3.0).otherwise(0.0) + F.when(y["window"].rlike(PER_VIDEO), 2.0).otherwise(0.0) + F.when(F.contains(y["raw"], F.lit("$")), 1.0).otherwise(0.0)
            points = points + F.when(y["amount"].between(5, 5000), 0.5).otherwise(0.0)
            return F.struct(points.alias("score"), y["amount"].alias("amount_usd"), y["place"].alias("place"), stripped(y["raw"]).alias("raw_match"))

        found = F.transform(F.filter(F.transform(p["raws"], scored), lambda y: (y["amount"] > 0) & (y["amount"] <= LARGEST)), score)
        return found if prefer_hints else F.transform(found, lambda z: z.withField("score", F.when(z["score"] < 2, z["score"] + 0.1).otherwise(z["score"])))

    best = _let(_let(_let(stripped(text), parts), with_ends), lambda x: F.array_max(scores(x)))
    confidence = lambda b: F.when(b["score"] >= 3, "high").when(b["score"] >= 2, "medium").otherwise("low")
    return _let(best, lambda b: F.when(b.isNotNull(), F.struct(b["amount_usd"].alias("amount_usd"), b["raw_match"].alias("raw_match"), confidence(b).alias("confidence"), b["score"].alias("score"))))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def accepted(message: Column, flags: Column) -> Column:
    """Whether a creator agrees, by flags of the message or by its words."""
    said = F.arrays_overlap(flags, F.array(*map(F.lit, ("reply_ok", "reply_yes", "reply_interested"))))
    return F.coalesce((F.trim(message) != "") & (said | message.rlike(ACCEPTS)), F.lit(False))


def quote_scenario(negotiates: Column, message: Column, intent: Column, top_intent: Column, flags: Column, top_flags: Column) -> Column:
    """creator_quote or flat_fee_agreed, or null: whether a quote is looked for. negotiates: prices are negotiated here."""
    at = lambda node: F.array_contains(flags, node) | F.array_contains(top_flags, node)
    is_intent = lambda name: F.coalesce(intent == name, F.lit(False)) | F.coalesce(top_intent == name, F.lit(False))
    hinted = F.array_contains(flags, "reply_quote") | F.coalesce(message.rlike(HINT), F.lit(False))
    yes = accepted(message, flags)
    return (
        F.when(~F.coalesce(negotiates, F.lit(False)), F.lit(None).cast("string"))
        .when(is_intent("Creator Quote") | hinted | (at("priority_node:A4") & quote(message).isNotNull()), "creator_quote")
        .when((is_intent("Flat Fee") | at("priority_node:A3")) & yes, "flat_fee_agreed")
    )


def scenario_quote(scenario: Column, message: Column, seller_text: Column, reply: Column) -> Column:
    """struct(amount_usd, source, raw_match, confidence) for a scenario; null if there is none.

    A creator's quote is in the message. An agreed fee is in the reply, else in the seller's lines, else in the message: in the
    words "that's $x per video", or as the best amount of a text that speaks of a flat fee.
    """
    none = F.lit(None).cast("struct<amount_usd:decimal(18,2),source:string,raw_match:string,confidence:string>")

    def made(found: Column, source: str) -> Column:
        return F.struct(found["amount_usd"].alias("amount_usd"), F.lit(source).alias("source"), found["raw_match"].alias("raw_match"), found["confidence"].alias("confidence"))

    def agreed(text: Column, source: str) -> Column:
        words = F.regexp_extract(text, AGREED, 0)
        amount = F.regexp_extract(text, AGREED, 1).try_cast("decimal(18,2)")
        exact = F.struct(amount.alias("amount_usd"), F.lit(source).alias("source"), words.alias("raw_match"), F.lit("high").alias("confidence"))
        best = _let(quote(text, prefer_hints=False), lambda q: F.when(q.isNotNull(), made(q, source)).otherwise(none))
        return F.when(words != "", exact).when(text.rlike(FLAT_FEE), best).otherwise(none)

    own = _let(quote(message), lambda q: F.when(q.isNotNull(), made(q, "creator_message")))
    fee = F.coalesce(agreed(reply, "generated_reply"), agreed(seller_text, "context_seller"), agreed(message, "creator_message"))
    return F.when(scenario == "creator_quote", own).when(scenario == "flat_fee_agreed", fee)
