"""Reply requests derived from orders, in Spark and in SQL: messages and earlier offers from a list of phrases that meets every case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

MESSAGES = (
    "ok", " Yes ", "interested", "AI", "STOP", "No thanks.", "nah!", "I won't do that", "How can I get a sample?", "please send me the sample", "two videos, yes deal",
    "flat fee only please", "the rate is low, need a base", "what's the rate and CPM", "I'm interested, yes", "my rate is $150 per video", "300 usd for two, my sales are $9000",
    "My quote is $12345678901234567890", "sounds good, let's do it", "I don't have WhatsApp", "my whatsapp is +44 7700 900123", "can't find the group", "joined the group", "maybe later",
    "that's $80.50 per video", "they declined it", "bottom line is 200 dollars per vid", "", "  ", "hello there", "$0 or $5,000", "感兴趣", "$5000/video min $4999",
)
OFFERS = (
    "", "we asked for 2 short videos in return", "our AI UGC creator portal pays well", "this is a commission-only open plan", "that's $95 per video", "a flat fee of $120, one-video", "nothing said",
)
TIERS, SHOPS = ("A-level", "B-level", "C-level", "GEN"), ("north", "south", "GEN")
STEPS = ((), ("已加窗", "未申请批样"), ("未加窗",), ("已申请批样",), ("已加窗",))
INTENTS = ("GEN", "interest", "Flat Fee", "Creator Quote", "ok")
#: What a model might write: some of it must not be sent, some has slots left to fill.
DRAFTS = (
    "", "Thanks, talk soon.", "Join at https://evil.example/x.", "We can pay $999 now", "It is 77% of sales", "We answer within 9 days", "Please use {group_link}", "Apply here: {{form_url}} ok",
    "Reply to [name] soon", "See https://portal.example/x!", "Join here: https://chat.example/north — Ada", "Use {form_url} or {group_link}!", "Views are {avgVV}, all pays ${total}", "That's fine - ada",
)


def pick(items: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (n % len(items) + 1).cast("int"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    """(request_id, creator_id, shop, message, offer, tier, progress, intent, refused, rejected, language, sales, views, videos, draft): orders, every 97th
    without a message."""
    k = F.col("o_orderkey")
    steps = F.array(*[F.array(*map(F.lit, s)).cast("array<string>") for s in STEPS])
    return table(spark, d, "orders").select(
        k.alias("request_id"), F.concat(F.lit("creator_"), "o_custkey").alias("creator_id"), pick(SHOPS, k).alias("shop"),
        F.when(k % 97 != 0, pick(MESSAGES, k)).alias("message"), pick(OFFERS, F.floor(k / 7)).alias("offer"), pick(TIERS, F.floor(k / 5)).alias("tier"),
        F.element_at(steps, (F.floor(k / 3) % len(STEPS) + 1).cast("int")).alias("progress"), pick(INTENTS, F.floor(k / 11)).alias("intent"),
        (F.col("o_custkey") % 11 == 0).alias("refused"), (F.col("o_custkey") % 13 == 0).alias("rejected"), F.when(k % 2 == 0, "English").otherwise("zh-CN").alias("language"),
        F.when(k % 6 != 0, F.col("o_totalprice").cast("double") / 50).alias("sales"), F.when(k % 10 != 0, F.floor(F.col("o_totalprice")).cast("int")).alias("views"),
        F.when(k % 3 == 0, (k % 8).cast("int")).alias("videos"), pick(DRAFTS, F.floor(k / 13)).alias("draft"),
    )


def text_sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def list_sql(items: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(text_sql, items)) + "]" if items else "CAST([] AS VARCHAR[])"


def said_sql(text: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({text}, {text_sql(pattern)}), false)"


def _pick(items: tuple[str, ...], n: str) -> str:
    return f"{list_sql(items)}[CAST({n} % {len(items)} + 1 AS INTEGER)]"


SQL = f"""requests AS (SELECT o_orderkey AS request_id, 'creator_' || o_custkey AS creator_id, {_pick(SHOPS, "o_orderkey")} AS shop,
  CASE WHEN o_orderkey % 97 <> 0 THEN {_pick(MESSAGES, "o_orderkey")} END AS message, {_pick(OFFERS, "(o_orderkey // 7)")} AS offer, {_pick(TIERS, "(o_orderkey // 5)")} AS tier,
  [{", ".join(map(list_sql, STEPS))}][CAST((o_orderkey // 3) % {len(STEPS)} + 1 AS INTEGER)] AS progress, {_pick(INTENTS, "(o_orderkey // 11)")} AS intent,
  o_custkey % 11 = 0 AS refused, o_custkey % 13 = 0 AS rejected, CASE WHEN o_orderkey % 2 = 0 THEN 'English' ELSE 'zh-CN' END AS language,
  CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_totalprice AS DOUBLE) / 50 END AS sales, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(floor(o_totalprice) AS INTEGER) END AS views,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 8 AS INTEGER) END AS videos, {_pick(DRAFTS, "(o_orderkey // 13)")} AS draft FROM orders),
said AS (SELECT *, regexp_replace(coalesce(message, ''), '^\\s+|\\s+$', '', 'g') AS t FROM requests)"""
