"""Replies as staged routing: each stage decides the requests that it can and hands on the rest.

Gates decide by state and message, then rules are matched for what is still open, then drafts are restored, signed and validated. A
stage's rows are checkpointed once and split by whether they are decided, so that a later stage works on open rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guard as G
from ..functions import replies as R
from ..functions.records import SHORT_REFUSALS
from ..session import checkpoint_dir
from .common import dealt, if_small
from .conditions import Vocabulary, first_rules, has_negotiation

#: What a request's outcome is: how it was decided, by what text, and by which rule.
OUTCOME = ("request_id", "status", "mode", "reply", "rule_id", "reason")
#: Intents, rules and actions by which a creator counts as having refused a shop.
REFUSING_INTENTS, REFUSING_RULES, REFUSING_ACTIONS = ("reject", "拒绝", "stop"), ("reject", "stop"), ("停止", "stop_outreach", "mark_shop_rejected")


def split(rows: DataFrame, status: Column) -> tuple[DataFrame, DataFrame]:
    """(decided, open) of rows with a status, computed once: null is open."""
    checkpoint_dir(rows.sparkSession)
    marked = rows.withColumn("status", status).checkpoint()
    return marked.where("status is not null"), marked.where("status is null").drop("status")


def outcome(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows of OUTCOME, null where nothing is said."""
    return rows.select(*[(columns[c] if c in columns else F.col(c) if c in rows.columns else F.lit(None)).cast("long" if c in ("request_id", "rule_id") else "string").alias(c) for c in OUTCOME])


def by_gates(requests: DataFrame, v: Vocabulary, messenger_shop: str) -> tuple[DataFrame, DataFrame]:
    """Requests that need no script: withdrawn, silent, goodbye or messenger; the others with flags, emotion and intent.

    Requests have message, offer, shop, tier, progress, intent, refused and rejected. A refusal that answers an offer of commission where
    prices are negotiated is about the price, and stays open. Facts of a message are computed once. Requests are dealt out first, however few files they
    come from: later stages keep the parts of the first checkpoint.
    """
    flags = dealt(requests, "request_id").withColumn("flags", R.reply_flags(F.col("message")))
    text = F.lower(F.trim(F.coalesce("message", F.lit(""))))
    short = F.regexp_replace(text, r"[.!]+$", "").isin(*SHORT_REFUSALS)
    facts = flags.withColumns({"refuses": R.refuses_outreach(F.col("message")), "answer": F.when(F.col("shop") == messenger_shop, R.messenger_answer(F.col("message")))})
    about_price = has_negotiation(F.col("shop"), F.array("tier"), v) & F.coalesce(F.col("offer").rlike(R.OFFERED_COMMISSION), F.lit(False))
    about_price = about_price & (R.rejects_price(F.col("message"), F.col("offer")) | short | F.array_contains("flags", "reply_reject"))
    status = F.when(F.col("refused"), "withdrawn").when(F.col("rejected"), "silent").when(F.col("refuses") & ~about_price, "goodbye").when(F.col("answer").isNotNull(), "messenger")
    return split(facts, status)


def contexts(open_: DataFrame) -> DataFrame:
    """Open requests as contexts of rules (RUL-13): shop, tier and progress as they are stored, the intent as the message corrects it,
    emotion and flags from the message and the conditions given with the request."""
    none = F.array().cast("array<string>")
    intent = R.refined_intent(F.col("intent"), F.lit("low"), F.col("message"), F.col("offer"))["intent"]
    forced = F.when((F.col("tier") == "A-level") & R.rejects_price(F.col("message"), F.col("offer")), "CPM Rate").otherwise(intent)
    given = F.coalesce("conditions", none) if "conditions" in open_.columns else none
    said = R.enriched_flags(F.col("flags"), F.col("message"), F.col("offer"))
    return open_.select(
        F.col("request_id").alias("context_id"), "shop", F.array("tier").alias("tiers"), none.alias("all_tiers"), F.coalesce("progress", none).alias("progress"), F.array(forced).alias("intents"),
        F.array(R.inferred_emotion(F.col("message"), F.lit("GEN"))).alias("emotions"), none.alias("frequency"), none.alias("types"), F.array_distinct(F.concat(given, said)).alias("flags"),
    )


def by_rules(open_: DataFrame, rules: DataFrame, shop_values: DataFrame, v: Vocabulary, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Requests that meet no rule with a script (no_match); the others with what their first k rules give.

    rules have what match_conditions reads, and script, slots, information. Scripts are restored with the values of the shop
    (shop_values: shop, slots map), and with earnings where the rule's slots ask for them. At most k rules a request are gathered.
    """
    met = first_rules(rules, contexts(open_), v, k).withColumnRenamed("context_id", "request_id")
    text = rules.select("rule_id", "script", F.coalesce("slots", F.array().cast("array<string>")).alias("slots"), "information")
    shops = shop_values.select("shop", F.col("slots").alias("shop_slots"))
    own = open_.join(if_small(shops), "shop", "left").withColumn("earnings", G.earnings(F.col("views"), F.col("videos"), F.lit("")))
    rows = met.join(if_small(text), "rule_id").join(own.select("request_id", "shop_slots", "earnings"), "request_id")
    needs = F.array_contains("slots", "avgVV") & F.col("earnings").isNotNull()
    script = F.trim(G.restored(F.when(needs, G.restored(F.col("script"), F.col("earnings"))).otherwise(F.coalesce("script", F.lit(""))), F.col("shop_slots")))
    ref = F.struct("place", "rule_id", script.alias("script"), "slots", "information", needs.alias("needs"))
    refs = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(ref)).alias("matched"))
    found = own.join(refs, "request_id", "left").withColumn("refs", F.filter("matched", lambda r: r["script"] != ""))
    return split(found, F.when(F.coalesce(F.size("refs"), F.lit(0)) <= 0, "no_match"))


def by_validation(open_: DataFrame, signature: str) -> tuple[DataFrame, DataFrame]:
    """(decided, nothing): drafts restored, signed and validated; else the first script, signed and validated; else rejected.

    Where the first rule asks for earnings and they are known, its script stands in for the draft.
    """
    top, first = F.get("matched", F.lit(0)), F.get("refs", F.lit(0))
    none = F.array().cast("array<string>")
    per_ref = lambda f: F.flatten(F.transform("refs", f))
    slots = F.col("shop_slots")
    extra = F.coalesce(F.exists("matched", lambda r: r["needs"]), F.lit(False))
    rows = open_.withColumns({
        "authorised": F.array_distinct(F.concat(per_ref(lambda r: G.slot_urls(r["slots"], slots)), per_ref(lambda r: G.urls(r["script"])), per_ref(lambda r: G.tag_urls(r["information"], slots)))),
        "required": F.coalesce(G.required_urls(first["slots"], first["information"], first["script"], slots), none), "must": F.coalesce(G.required_values(first["slots"], first["information"], first["script"], slots), none),
        "allowed": F.concat_ws("\n", "offer", "message", F.array_join(F.transform("refs", lambda r: r["script"]), "\n")), "mode": F.when(top["needs"], "reference_script").otherwise("draft"),
        "raw": F.when(top["needs"], first["script"]).otherwise(F.coalesce("draft", F.lit(""))), "fallback": G.signed(first["script"], signature), "rule_id": first["rule_id"],
    })
    filled = G.restored(F.trim("raw"), slots)
    rows = rows.withColumn("body", G.signed(F.when(extra, G.restored(filled, F.col("earnings"))).otherwise(filled), signature))
    judged = lambda c: G.verdict(F.col(c), F.col("authorised"), F.col("required"), F.col("must"), F.col("allowed"), signature)
    rows = rows.withColumn("reason", judged("body")).withColumn("script_reason", F.when(F.col("reason") != "ok", judged("fallback")))
    status = F.when(F.col("reason") == "ok", "replied").when(F.col("script_reason") == "ok", "replied").otherwise("rejected")
    script = (F.col("reason") != "ok") & (F.col("script_reason") == "ok")
    reply = F.when(F.col("reason") == "ok", F.col("body")).when(script, F.col("fallback")).otherwise("")
    rows = rows.withColumns({"reply": reply, "mode": F.when(script, "reference_script").otherwise(F.col("mode"))})
    return split(rows, status)


def route(requests: DataFrame, rules: DataFrame, shop_values: DataFrame, v: Vocabulary, signature: str, messenger_shop: str) -> dict[str, DataFrame]:
    """Stage to its outcomes (OUTCOME): gates, rules, validation. Every request is in one of them; their union is the batch's result."""
    decided, open_ = by_gates(requests, v, messenger_shop)
    unmatched, matched = by_rules(open_, rules, shop_values, v)
    finished, _ = by_validation(matched, signature)
    goodbye = F.when(F.col("status") == "goodbye", R.goodbye(F.col("language"), signature)).otherwise(F.lit(""))
    return {"gates": outcome(decided, reply=goodbye), "rules": outcome(unmatched, reply=F.lit("")), "validation": outcome(finished)}


def united(stages: dict[str, DataFrame]) -> DataFrame:
    first, *rest = stages.values()
    for r in rest:
        first = first.union(r)
    return first


def refusing(message: Column, intent: Column, rule: Column, action: Column) -> Column:
    """Whether an answered message leaves the creator marked as refusing the shop: by its words, its intent, the rule or the action."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return R.refuses_outreach(message) | low(intent).isin(*REFUSING_INTENTS) | low(rule).isin(*REFUSING_RULES) | low(action).isin(*REFUSING_ACTIONS)
