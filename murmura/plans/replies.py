"""Replies as batch queries: quotes, refusals, intents and emotions of messages, messenger groups, effects, the status of a request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quotes as Q
from ..functions import records as X
from ..functions import replies as R
from ..operators.conditions import Vocabulary, has_negotiation
from ..sources.requests import SQL, list_sql, pick, requests, said_sql, text_sql
from .registry import query

HEAD = Vocabulary(tier_groups=(("A-level", "S-level"), ("B-level", "sampled")), head_tiers=("A-level", "S-level"), negotiation_shops=("north",))



def _quote_sql(text: str, prefer: bool = True) -> str:
    """Best amounts of `said` rows with text t: found(request_id, amount_usd, raw_match, score, confidence)."""
    score = f"CASE WHEN {said_sql('w', Q.HINT)} THEN 3.0 ELSE 0 END + CASE WHEN {said_sql('w', Q.PER_VIDEO)} THEN 2.0 ELSE 0 END + CASE WHEN contains(raw, '$') THEN 1.0 ELSE 0 END + CASE WHEN amount BETWEEN 5 AND 5000 THEN 0.5 ELSE 0 END"
    bonus = "s" if prefer else "CASE WHEN s < 2 THEN s + 0.1 ELSE s END"
    return f"""(WITH split AS (SELECT request_id, {text} AS body, regexp_extract_all({text}, {text_sql(Q.AMOUNT)}) AS raws, regexp_extract_all({text}, {text_sql(Q.AMOUNT)}, 1) AS v1,
  regexp_extract_all({text}, {text_sql(Q.AMOUNT)}, 2) AS v2, string_split_regex({text}, {text_sql(Q.AMOUNT)}) AS pieces FROM said WHERE {text} <> ''),
each AS (SELECT *, unnest(range(1, len(raws) + 1)) AS i FROM split WHERE len(raws) > 0),
placed AS (SELECT request_id, body, i, raws[i] AS raw, TRY_CAST(coalesce(nullif(v1[i], ''), nullif(v2[i], '')) AS DECIMAL(18,2)) AS amount,
  CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(raws[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS b FROM each),
near AS (SELECT *, substr(body, greatest(b - 40, 0) + 1, b + length(raw) + 40 - greatest(b - 40, 0)) AS w FROM placed WHERE amount > 0 AND amount <= 1000000),
scored AS (SELECT *, CAST({score} AS DOUBLE) AS s FROM near), final AS (SELECT *, {bonus} AS f FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY f DESC, amount DESC, i) AS place FROM final)
SELECT request_id, amount AS amount_usd, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS raw_match, f AS score, CASE WHEN f >= 3 THEN 'high' WHEN f >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM ranked WHERE place = 1)"""


_S = lambda p: said_sql("t", p)
_FLAGS_SQL = (
    "CASE WHEN t = '' THEN CAST([] AS VARCHAR[]) " + " ".join(f"WHEN lower(t) IN ({', '.join(map(text_sql, w))}) THEN {list_sql(f)}" for w, f in R.WHOLE) + f" WHEN {_S(R.REFUSES)} THEN ['reply_reject'] ELSE list_filter(["
    + ", ".join(f"CASE WHEN {_S(p)} THEN '{f}' END" for f, p in R.SAID) + "], lambda x: x IS NOT NULL) END"
)
_SHORT = f"regexp_replace(lower(t), '[.!]+$', '') IN ({', '.join(map(text_sql, X.SHORT_REFUSALS))})"
_BARE = _S(R.ACCEPTS)
_TWO = f"(t <> '' AND (({_S(R.TWO_VIDEOS)} AND {_S(R.AGREES)}) OR ({said_sql('offer', R.OFFERED_TWO_VIDEOS)} AND ({_BARE} OR lower(t) IN ('yes', 'interested', 'ok', 'sure', 'yes, i''m interested!')))))"
_SAMPLE = f"({_S(R.SAMPLE_QUESTION)} OR ({_S(R.SAMPLE_REQUEST)} AND NOT ({_S(R.TWO_VIDEOS)} AND {_S(R.AGREES)})))"
_LOW = f"(t <> '' AND {_S(R.TOO_LOW)} AND {said_sql('offer', R.OFFERED_COMMISSION)})"
_WORDS = f"""words AS (SELECT *, {_FLAGS_SQL} AS flags FROM said), facts AS (SELECT *, t <> '' AND (list_contains(flags, 'reply_reject') OR {_SHORT} OR {_S(X.REFUSAL_PHRASES)}) AS refuses,
  {_LOW} AS low, shop = 'north' AND tier = 'A-level' AS negotiates, CASE WHEN {_S(R.NO_MESSENGER)} THEN 'no_whatsapp' WHEN {_S(R.SHARED_NUMBER)} OR ({_S('(?i)whatsapp|wa')} AND {_S(R.NUMBER_ONLY)}) THEN 'shared_number'
  WHEN {_S(R.NOT_FOUND)} THEN 'not_found' WHEN {_S(R.JOINED)} THEN 'joined' END AS answer FROM words)"""
_AGREES_SQL = f"(t <> '' AND (list_has_any(flags, ['reply_ok', 'reply_yes', 'reply_interested']) OR {_S(Q.ACCEPTS)}))"


def _negotiates():
    return has_negotiation(F.col("shop"), F.array("tier"), HEAD)


@query(f"WITH {SQL} SELECT s.request_id, CAST(amount_usd AS DOUBLE) AS amount_usd, raw_match, score, confidence FROM said s LEFT JOIN {_quote_sql('t')} q ON q.request_id = s.request_id")
def quote_extract(spark: SparkSession, d: str) -> DataFrame:
    """The likely quote of each message (STR-13, SRT-04, NUM-08)."""
    return requests(spark, d).select("request_id", Q.quote(F.col("message")).alias("q")).select("request_id", F.col("q.amount_usd").cast("double").alias("amount_usd"), "q.raw_match", "q.score", "q.confidence")


_AGREED = lambda x: f"nullif(regexp_extract({x}, {text_sql(Q.AGREED)}, 0), '')"
_SCENARIO = f"""scenes AS (SELECT f.*, q.amount_usd AS own_amount, q.raw_match AS own_raw, q.confidence AS own_conf, m.amount_usd AS loose_amount, m.raw_match AS loose_raw, m.confidence AS loose_conf,
  o.amount_usd AS offer_amount, o.raw_match AS offer_raw, o.confidence AS offer_conf,
  CASE WHEN NOT negotiates THEN NULL WHEN intent = 'Creator Quote' OR list_contains(flags, 'reply_quote') OR {_S(Q.HINT)} THEN 'creator_quote'
    WHEN (intent = 'Flat Fee' OR f.request_id % 3 = 0) AND {_AGREES_SQL} THEN 'flat_fee_agreed' END AS scenario
  FROM facts f LEFT JOIN {_quote_sql('t')} q ON q.request_id = f.request_id LEFT JOIN {_quote_sql('t', False)} m ON m.request_id = f.request_id LEFT JOIN {_quote_sql('offer', False)} o ON o.request_id = f.request_id),
picked AS (SELECT *, CASE WHEN scenario = 'creator_quote' THEN CASE WHEN own_amount IS NOT NULL THEN {{'amount_usd': own_amount, 'source': 'creator_message', 'raw_match': own_raw, 'confidence': own_conf}} END
  WHEN scenario = 'flat_fee_agreed' THEN coalesce(
    CASE WHEN {_AGREED('offer')} IS NOT NULL THEN {{'amount_usd': CAST(regexp_extract(offer, {text_sql(Q.AGREED)}, 1) AS DECIMAL(18,2)), 'source': 'context_seller', 'raw_match': {_AGREED('offer')}, 'confidence': 'high'}}
      WHEN {said_sql('offer', Q.FLAT_FEE)} AND offer_amount IS NOT NULL THEN {{'amount_usd': offer_amount, 'source': 'context_seller', 'raw_match': offer_raw, 'confidence': offer_conf}} END,
    CASE WHEN {_AGREED('t')} IS NOT NULL THEN {{'amount_usd': CAST(regexp_extract(t, {text_sql(Q.AGREED)}, 1) AS DECIMAL(18,2)), 'source': 'creator_message', 'raw_match': {_AGREED('t')}, 'confidence': 'high'}}
      WHEN {_S(Q.FLAT_FEE)} AND loose_amount IS NOT NULL THEN {{'amount_usd': loose_amount, 'source': 'creator_message', 'raw_match': loose_raw, 'confidence': loose_conf}} END) END AS q FROM scenes)"""


@query(f"WITH {SQL}, {_WORDS}, {_SCENARIO} SELECT request_id, scenario, CAST(q.amount_usd AS DOUBLE) AS amount_usd, q.source AS source, q.raw_match AS raw_match, q.confidence AS confidence FROM picked")
def quote_scenario(spark: SparkSession, d: str) -> DataFrame:
    """When a quote is looked for, and what it is (RPL-12, RPL-13)."""
    flags, top = R.reply_flags(F.col("message")), F.when(F.col("request_id") % 3 == 0, F.array(F.lit("priority_node:A3"))).otherwise(F.array().cast("array<string>"))
    rows = requests(spark, d).withColumn("scenario", Q.quote_scenario(_negotiates(), F.col("message"), F.col("intent"), F.lit(None).cast("string"), flags, top))
    rows = rows.withColumn("q", Q.scenario_quote(F.col("scenario"), F.col("message"), F.col("offer"), F.lit("")))
    return rows.select("request_id", "scenario", F.col("q.amount_usd").cast("double").alias("amount_usd"), "q.source", "q.raw_match", "q.confidence")


@query(f"WITH {SQL}, {_WORDS} SELECT request_id, array_to_string(flags, ',') AS flags, refuses, low AS rejects_price, {_TWO} AS confirms, {_SAMPLE} AS asks_sample FROM facts")
def message_facts(spark: SparkSession, d: str) -> DataFrame:
    """Flags of messages and what they mean (RUL-14, FLT-14, INT-11)."""
    return requests(spark, d).select(
        "request_id", F.array_join(R.reply_flags(F.col("message")), ",").alias("flags"), R.refuses_outreach(F.col("message")).alias("refuses"), R.rejects_price(F.col("message"), F.col("offer")).alias("rejects_price"),
        R.confirms_two_videos(F.col("message"), F.col("offer")).alias("confirms"), R.asks_for_sample(F.col("message")).alias("asks_sample"),
    )


@query(f"""WITH {SQL}, {_WORDS} SELECT request_id, r.intent AS intent, r.confidence AS confidence, r.hint AS hint FROM (SELECT request_id, CASE
  WHEN t = '' THEN {{'intent': intent, 'confidence': 'low', 'hint': NULL}}
  WHEN {_SAMPLE} THEN {{'intent': 'Ask for samples', 'confidence': CASE WHEN contains(t, '?') OR regexp_matches(lower(t), '^(how|what|can)') THEN 'high' ELSE 'low' END, 'hint': 'sample_inquiry_not_strong_intent'}}
  WHEN {_TWO} THEN {{'intent': 'interest', 'confidence': 'high', 'hint': 'one_sample_two_videos_confirmed'}}
  WHEN {said_sql('offer', R.OFFERED_AI)} AND {_BARE} THEN {{'intent': 'AI-UGC Earnings', 'confidence': 'high', 'hint': 'ai_ugc_pitch_accept'}}
  WHEN {_S(R.FLAT_FEE_ONLY)} THEN {{'intent': 'Flat Fee', 'confidence': 'high', 'hint': 'a_tier_flat_fee_only'}}
  WHEN low THEN {{'intent': 'CPM Rate', 'confidence': 'high', 'hint': 'a1_reject_price_too_low_to_a2_cpm'}}
  WHEN {_S(R.CPM)} THEN {{'intent': 'CPM Rate', 'confidence': 'high', 'hint': 'a_tier_cpm_negotiation'}}
  WHEN lower(intent) IN ('interest', 'ok', '强意向') AND {_S(r'(?i)\b(interested|yes)\b')} AND {said_sql('offer', R.OFFERED_TWO_VIDEOS)} THEN {{'intent': 'GEN', 'confidence': 'medium', 'hint': 'interested_without_two_video_confirmation'}}
  ELSE {{'intent': intent, 'confidence': 'low', 'hint': NULL}} END AS r FROM facts)""")
def intent_refined(spark: SparkSession, d: str) -> DataFrame:
    """The ladder that corrects an intent (INT-09)."""
    rows = requests(spark, d).select("request_id", R.refined_intent(F.col("intent"), F.lit("low"), F.col("message"), F.col("offer")).alias("r"))
    return rows.select("request_id", "r.intent", "r.confidence", "r.hint")


_RICH = f"list_filter(['reply_yes', 'reply_interested', CASE WHEN {said_sql('offer', R.OFFERED_AI)} THEN 'reply_ai' END], lambda x: x IS NOT NULL)"


@query(f"""WITH {SQL}, {_WORDS} SELECT request_id, CASE WHEN {_BARE} THEN array_to_string(list_concat(flags, list_filter({_RICH}, lambda x: NOT list_contains(flags, x))), ',') ELSE array_to_string(flags, ',') END AS flags,
  CASE WHEN request_id % 9 = 0 THEN 'calm' WHEN t = '' THEN 'GEN' WHEN {_BARE} THEN '{R.INTERESTED}' WHEN list_contains(flags, 'reply_reject') OR {_S(R.EMOTION_REFUSES)} THEN '{R.REFUSED}'
  WHEN {_S(R.EMOTION_NOT_NOW)} THEN '{R.NOT_NOW}' WHEN list_has_any(flags, ['reply_interested', 'reply_yes']) OR {_S(R.EMOTION_INTERESTED)} THEN '{R.INTERESTED}' ELSE 'GEN' END AS emotion FROM facts""")
def match_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Flags and emotions that rules are matched with (INT-10, INT-12, RUL-13)."""
    preset = F.when(F.col("request_id") % 9 == 0, "calm").otherwise("GEN")
    return requests(spark, d).select("request_id", F.array_join(R.enriched_flags(R.reply_flags(F.col("message")), F.col("message"), F.col("offer")), ",").alias("flags"), R.inferred_emotion(F.col("message"), preset).alias("emotion"))


_STEP = f"CASE WHEN list_contains(progress, '{R.SAMPLE_ASKED}') THEN 'sample_review' WHEN answer = 'joined' AND list_contains(progress, '{R.SHOWCASED}') AND list_contains(progress, '{R.SAMPLE_NOT_ASKED}') THEN 'sample' WHEN list_contains(progress, '{R.NOT_SHOWCASED}') OR len(progress) = 0 THEN 'showcase' WHEN list_contains(progress, '{R.SHOWCASED}') THEN 'sample' ELSE 'showcase' END"


@query(f"""WITH {SQL}, {_WORDS} SELECT request_id, answer, {_STEP} AS step, CASE answer WHEN 'joined' THEN 1 WHEN 'no_whatsapp' THEN 2 END AS join_value,
  CASE WHEN sales >= 1000 THEN 'wa_group_gmv_gte_1k' ELSE 'wa_group_gmv_lt_1k' END AS link_slot FROM facts WHERE shop = 'north' AND answer IS NOT NULL""")
def join_flow(spark: SparkSession, d: str) -> DataFrame:
    """Answers about the messenger group and what comes next (RPL-04)."""
    rows = requests(spark, d).where("shop = 'north'").withColumn("answer", R.messenger_answer(F.col("message"))).where("answer is not null")
    answer = F.col("answer")
    return rows.select("request_id", "answer", R.next_step(F.col("progress"), answer).alias("step"), R.messenger_value(answer).alias("join_value"), R.sales_slot("wa_group", F.col("sales")).alias("link_slot"))


_STILL = f"(negotiates AND {said_sql('offer', R.OFFERED_COMMISSION)} AND (low OR {_SHORT} OR list_contains(flags, 'reply_reject')))"
_BYE = """CASE WHEN language LIKE 'zh%' THEN '很遗憾听到这个消息，这里就不再打扰你了。祝你一切顺利！' ELSE 'I''m sorry to hear that. I won''t reach out about this again. All the best!' END || chr(10) || chr(10) || '- Ada'"""


@query(f"WITH {SQL}, {_WORDS} SELECT request_id, creator_id, shop, {_BYE} AS reply, true AS shop_rejected, '已拒绝' AS creator_progress, '{R.REFUSED}' AS creator_emotion FROM facts WHERE NOT refused AND NOT rejected AND refuses AND NOT {_STILL}")
def reject_flow(spark: SparkSession, d: str) -> DataFrame:
    """First refusals, with the farewell and the state that is stored; not where the price is still negotiated (RPL-03)."""
    rows = requests(spark, d).where(~F.col("refused") & ~F.col("rejected") & R.refuses_outreach(F.col("message")) & ~still_negotiating())
    return rows.select(
        "request_id", "creator_id", "shop", R.goodbye(F.col("language"), "Ada").alias("reply"), F.lit(True).alias("shop_rejected"), F.lit("已拒绝").alias("creator_progress"), F.lit(R.REFUSED).alias("creator_emotion"),
    )


def still_negotiating():
    """A refusal that answers an offer of commission where prices are negotiated is about the price."""
    text = F.trim(F.coalesce(F.col("message"), F.lit("")))
    short = F.regexp_replace(F.lower(text), r"[.!]+$", "").isin(*X.SHORT_REFUSALS)
    return _negotiates() & F.coalesce(F.col("offer").rlike(R.OFFERED_COMMISSION), F.lit(False)) & (R.rejects_price(F.col("message"), F.col("offer")) | short | F.array_contains(R.reply_flags(F.col("message")), "reply_reject"))


ACTION_NAMES = tuple(R.EFFECTS)
_EFFECT = "CASE action " + " ".join(
    f"WHEN '{n}' THEN " + (f"CASE WHEN amount_usd IS NOT NULL THEN {{'kind': 'quote', 'target': '{t}', 'value': CAST(amount_usd AS VARCHAR), 'note': '{v}'}} ELSE {{'kind': 'none', 'target': NULL, 'value': NULL, 'note': 'no_amount_in_message'}} END" if k == "quote"
    else f"{{'kind': 'none', 'target': NULL, 'value': NULL, 'note': '{v}'}}" if k == "none" else f"{{'kind': '{k}', 'target': '{t}', 'value': '{v}', 'note': NULL}}") for n, (k, t, v) in R.EFFECTS.items()) + " END"


@query(f"""WITH {SQL}, acts AS (SELECT s.request_id, creator_id, amount_usd, {list_sql((*ACTION_NAMES, 'unknown'))}[CAST((s.request_id // 2) % {len(ACTION_NAMES) + 1} + 1 AS INTEGER)] AS action FROM said s LEFT JOIN {_quote_sql('t')} q ON q.request_id = s.request_id),
made AS (SELECT request_id, creator_id, action, {_EFFECT} AS e FROM acts) SELECT request_id, creator_id, action, e.kind AS kind, e.target AS target, e.value AS value, e.note AS note FROM made WHERE e IS NOT NULL""")
def action_effects(spark: SparkSession, d: str) -> DataFrame:
    """What each action changes, a row for each that is known (RPL-14, RPL-16, UDF-02)."""
    action = pick((*ACTION_NAMES, "unknown"), F.floor(F.col("request_id") / 2))
    rows = requests(spark, d).withColumn("action", action).withColumn("e", R.effect(F.col("action"), F.col("creator_id"), F.col("message"))).where("e is not null")
    return rows.select("request_id", "creator_id", "action", "e.kind", "e.target", "e.value", "e.note")
