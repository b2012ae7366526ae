"""Replies by stages: contexts of requests, routes and verdicts, and what answers leave in the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import guard as G
from ..functions import replies as R
from ..operators import routing as W
from ..sources import tables as T
from ..sources.requests import SQL, list_sql, pick, requests, said_sql, text_sql
from .registry import query
from .replies import _BARE, _BYE, _LOW, _RICH, _SAMPLE, _STILL, _TWO, _WORDS, HEAD

#: Scripts of rules: text, slots, key information.
SCRIPTS = (
    ("Join here: {group_link}", ("group_link",), ("Group",)),
    ("Your base is ${avgVV*0.002} a video at {avgVV} views, up to ${avgVV*0.004}; {videoCount} videos make ${total}.", ("avgVV",), ()),
    ("", (), ()),
    ("Apply at {form_url} within 3 days, we pay 12% and $5.", ("form_url",), ("Form",)),
    ("Thanks, we will see.", (), ()),
    ("See https://portal.example/x, please.", (), ("Portal",)),
    ("Hi {missing_slot}", (), ()),
)
RULE_SHOPS, RULE_TIERS = ((), ("north",), ("south",), ("GEN",), ("north",)), ((), ("A-level",), (), ("B-level", "C-level"))
RULE_INTENTS, RULE_FLAGS = (("interest",), ("Flat Fee",), ("CPM Rate",), ("Ask for samples",), ("AI-UGC Earnings",)), ((), (), ("reply_yes",), ())
VALUES = {"north": {"group_link": "https://chat.example/north", "form_url": "https://form.example/n?id=1"}, "south": {"form_url": "https://form.example/s"}}


def _lists(items: tuple[tuple[str, ...], ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.array(*map(F.lit, i)).cast("array<string>") for i in items]), (n % len(items) + 1).cast("int"))


def script_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules with scripts, of parts."""
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    half = lambda n: F.floor(k / n)
    return T.table(spark, d, "part").select(
        k.alias("rule_id"), _lists(RULE_SHOPS, k).alias("shops"), F.lit("GEN/rules.txt").alias("source_file"), _lists(RULE_TIERS, half(3)).alias("tiers"), _lists(RULE_INTENTS, half(2)).alias("intents"), _lists(RULE_FLAGS, half(5)).alias("flags"),
        *[none.alias(c) for c in ("all_tiers", "progress", "emotions", "frequency", "types")],
        pick(tuple(s for s, _, _ in SCRIPTS), k).alias("script"), _lists(tuple(s for _, s, _ in SCRIPTS), k).alias("slots"), _lists(tuple(s for _, _, s in SCRIPTS), k).alias("information"),
    )


def shop_values(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VALUES.items()), "shop string, slots map<string,string>")


_pick = lambda items, n: f"[{', '.join(list_sql(i) if isinstance(i, tuple) else text_sql(i) for i in items)}][CAST({n} % {len(items)} + 1 AS INTEGER)]"
_URLS = lambda x: rf"""list_transform(regexp_extract_all({x}, '(?i)https?://[^\s\)\]"''<>]+|wa\.me/[^\s\)\]"''<>]+'), lambda u: regexp_replace(u, '[.,;:!?)"'']+$', ''))"""
_filled = lambda x: f"replace(replace(replace(replace({x}, '{{group_link}}', coalesce(gl, '{{group_link}}')), '{{{{group_link}}}}', coalesce(gl, '{{{{group_link}}}}')), '{{form_url}}', coalesce(fu, '{{form_url}}')), '{{{{form_url}}}}', coalesce(fu, '{{{{form_url}}}}'))"
_money = lambda x: f"regexp_replace(printf('%.2f', CAST({x} AS DOUBLE)), '\\.?0+$', '')"
_VIEWS, _N = "CAST(greatest(views, 0) AS DOUBLE)", "greatest(coalesce(nullif(videos, 0), 4), 1)"
_PAID = [("{avgVV*0.002}", _money(f"{_VIEWS} * CAST(0.002 AS DOUBLE)")), ("{avgVV*0.004}", _money(f"{_VIEWS} * CAST(0.002 AS DOUBLE) * 2")), ("{avgVV*0.003}", _money(f"{_VIEWS} * CAST(0.003 AS DOUBLE)")), ("{avgVV*0.0015}", _money(f"{_VIEWS} * CAST(0.003 AS DOUBLE) / 2")), ("{avgVV}", f"format('{{:,}}', CAST({_VIEWS} AS BIGINT))"), ("{videoCount}", f"CAST({_N} AS VARCHAR)"), ("{total}", _money(f"{_N} * ({_VIEWS} * CAST(0.002 AS DOUBLE))"))]


def _earned(x: str) -> str:
    for name, value in _PAID:
        x = f"replace({x}, '{name}', {value})"
    return x


_signed = lambda x: f"CASE WHEN regexp_replace({x}, '\\s+$', '') = '' THEN '' ELSE regexp_replace(regexp_replace(regexp_replace({x}, '\\s+$', ''), '(?i)\\s*[—\\-]\\s*Ada\\s*$', ''), '\\s+$', '') || chr(10) || chr(10) || '— Ada' END"
_foreign = lambda b, p: f"len(list_filter(regexp_extract_all({b}, '{p}'), lambda m: NOT contains(allowed, m))) > 0"
_judged = lambda b: rf"""CASE WHEN trim({b}) = '' THEN 'empty_reply' WHEN NOT regexp_matches({b}, '(?i)\s*[—\-]\s*Ada\s*$') THEN 'missing_signature' WHEN regexp_matches({b}, '\[[^\]]+\]|\{{[a-zA-Z_]+\}}') THEN 'placeholder_in_reply'
  WHEN len(list_filter({_URLS(b)}, lambda u: NOT list_contains(authorised, u))) > 0 THEN 'unauthorized_url' WHEN len(list_filter(required, lambda u: NOT contains({b}, u))) > 0 THEN 'missing_required_url'
  WHEN len(list_filter(must, lambda u: NOT contains({b}, u))) > 0 THEN 'missing_key_information' WHEN {_foreign(b, chr(92) + '$' + chr(92) + 's*[0-9][0-9,]*(?:' + chr(92) + '.[0-9]+)?')} THEN 'unauthorized_money'
  WHEN {_foreign(b, chr(92) + 'b[0-9]+(?:' + chr(92) + '.[0-9]+)?' + chr(92) + 's*%')} THEN 'unauthorized_percent'
  WHEN {_foreign(b, '(?i)' + chr(92) + 'b(?:within|in|after)' + chr(92) + 's+[0-9]+' + chr(92) + 's+(?:business' + chr(92) + 's+)?(?:days?|hours?|weeks?)' + chr(92) + 'b')} THEN 'unauthorized_deadline' ELSE 'ok' END"""  # noqa: E731
_INTENT = f"""CASE WHEN tier = 'A-level' AND low THEN 'CPM Rate' WHEN t = '' THEN intent WHEN {_SAMPLE} THEN 'Ask for samples' WHEN {_TWO} THEN 'interest' WHEN {said_sql('offer', R.OFFERED_AI)} AND {_BARE} THEN 'AI-UGC Earnings'
  WHEN {said_sql('t', R.FLAT_FEE_ONLY)} THEN 'Flat Fee' WHEN {_LOW} OR {said_sql('t', R.CPM)} THEN 'CPM Rate' WHEN lower(intent) IN ('interest', 'ok', '强意向') AND {said_sql('t', r'(?i)\b(interested|yes)\b')} AND {said_sql('offer', R.OFFERED_TWO_VIDEOS)} THEN 'GEN' ELSE intent END"""
_CONTEXTS_SQL = f"""{SQL}, {_WORDS},
gated AS (SELECT *, CASE WHEN refused THEN 'withdrawn' WHEN rejected THEN 'silent' WHEN refuses AND NOT {_STILL} THEN 'goodbye' WHEN shop = 'north' AND answer IS NOT NULL THEN 'messenger' END AS gate FROM facts),
ctx AS (SELECT *, {_INTENT} AS intent_now, CASE WHEN {_BARE} THEN list_concat(flags, list_filter({_RICH}, lambda x: NOT list_contains(flags, x))) ELSE flags END AS flags_now FROM gated WHERE gate IS NULL)"""
_ROUTES_SQL = f"""{_CONTEXTS_SQL},
rules AS (SELECT p_partkey AS rule_id, list_filter({_pick(RULE_SHOPS, "p_partkey")}, lambda s: s <> 'GEN') AS shops, {_pick(RULE_TIERS, "(p_partkey // 3)")} AS tiers, {_pick(RULE_INTENTS, "(p_partkey // 2)")} AS intents, {_pick(RULE_FLAGS, "(p_partkey // 5)")} AS rflags,
  {_pick(tuple(s for s, _, _ in SCRIPTS), "p_partkey")} AS script, {_pick(tuple(s for _, s, _ in SCRIPTS), "p_partkey")} AS slots, {_pick(tuple(s for _, _, s in SCRIPTS), "p_partkey")} AS info FROM part),
signatures AS (SELECT DISTINCT shop, tier, intent_now, flags_now FROM ctx),
chosen AS (SELECT * FROM (SELECT s.*, r.rule_id, row_number() OVER (PARTITION BY s.shop, s.tier, s.intent_now, s.flags_now ORDER BY r.rule_id) AS place FROM signatures s JOIN rules r ON s.intent_now <> 'GEN' AND list_contains(r.intents, s.intent_now)
  AND (len(r.shops) = 0 OR (s.shop <> 'GEN' AND list_contains(r.shops, s.shop))) AND (len(r.tiers) = 0 OR list_contains(r.tiers, s.tier)) AND list_has_all(s.flags_now, r.rflags)) WHERE place <= 3),
met AS (SELECT c.request_id, views, videos, place, r.rule_id, slots, info, r.script AS raw_script, list_contains(slots, 'avgVV') AND views IS NOT NULL AS needs,
  CASE c.shop WHEN 'north' THEN 'https://chat.example/north' END AS gl, CASE c.shop WHEN 'north' THEN 'https://form.example/n?id=1' WHEN 'south' THEN 'https://form.example/s' END AS fu
  FROM ctx c JOIN chosen h ON h.shop = c.shop AND h.tier = c.tier AND h.intent_now = c.intent_now AND h.flags_now = c.flags_now JOIN rules r USING (rule_id)),
scripted AS (SELECT *, trim({_filled("CASE WHEN needs THEN " + _earned("raw_script") + " ELSE raw_script END")}) AS text FROM met),
valued AS (SELECT *, list_filter([CASE WHEN list_contains(slots, 'group_link') THEN gl END, CASE WHEN list_contains(slots, 'form_url') THEN fu END], lambda x: x IS NOT NULL) AS own, list_filter([CASE WHEN list_contains(info, 'Group') THEN gl END, CASE WHEN list_contains(info, 'Form') THEN fu END], lambda x: x IS NOT NULL) AS tagged FROM scripted),
tops AS (SELECT request_id, arg_min(needs, place) AS top_needs, bool_or(needs) AS extra FROM valued GROUP BY request_id),
refs AS (SELECT request_id, flatten(list(list_concat(list_concat(own, tagged), {_URLS("text")}))) AS authorised, arg_min(rule_id, place) AS rule_id, arg_min(text, place) AS script, arg_min(own, place) AS own, arg_min(info, place) AS info, string_agg(text, chr(10) ORDER BY place) AS texts FROM valued WHERE text <> '' GROUP BY request_id),
drafted AS (SELECT c.*, r.* EXCLUDE (request_id), top_needs, extra, CASE c.shop WHEN 'north' THEN 'https://chat.example/north' END AS gl, CASE c.shop WHEN 'north' THEN 'https://form.example/n?id=1' WHEN 'south' THEN 'https://form.example/s' END AS fu,
  CASE WHEN len(info) = 0 THEN [] WHEN len(own) > 0 THEN own ELSE {_URLS("script")}[1:1] END AS required, CASE WHEN len(info) = 0 THEN [] WHEN len(own) > 0 THEN own ELSE {_URLS("script")} END AS must,
  concat_ws(chr(10), offer, message, texts) AS allowed, trim(CASE WHEN top_needs THEN script ELSE draft END) AS raw FROM ctx c JOIN refs r ON r.request_id = c.request_id JOIN tops t ON t.request_id = c.request_id),
bodies AS (SELECT *, {_signed("(CASE WHEN extra THEN " + _earned(_filled("raw")) + " ELSE " + _filled("raw") + " END)")} AS body, {_signed("script")} AS fallback FROM drafted),
judged AS (SELECT *, {_judged("body")} AS reason, {_judged("fallback")} AS script_reason FROM bodies),
routes AS (
  SELECT request_id, gate AS status, NULL AS mode, CASE WHEN gate = 'goodbye' THEN {_BYE} ELSE '' END AS reply, CAST(NULL AS BIGINT) AS rule_id, NULL AS reason FROM gated WHERE gate IS NOT NULL
  UNION ALL SELECT request_id, 'no_match', NULL, '', NULL, NULL FROM ctx WHERE request_id NOT IN (SELECT request_id FROM refs)
  UNION ALL SELECT request_id, CASE WHEN reason = 'ok' OR script_reason = 'ok' THEN 'replied' ELSE 'rejected' END, CASE WHEN (reason <> 'ok' AND script_reason = 'ok') OR top_needs THEN 'reference_script' ELSE 'draft' END,
    CASE WHEN reason = 'ok' THEN body WHEN script_reason = 'ok' THEN fallback ELSE '' END, rule_id, reason FROM judged)"""


def _stages(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return W.route(requests(spark, d), script_rules(spark, d), shop_values(spark), HEAD, "Ada", "north")


@query(f"WITH {_CONTEXTS_SQL} SELECT request_id, shop, tier, intent_now AS intent, array_to_string(list_sort(list_distinct(flags_now)), ',') AS flags FROM ctx")
def request_contexts(spark: SparkSession, d: str) -> DataFrame:
    """What open requests are matched with: state, corrected intent, flags (RUL-13)."""
    _, open_ = W.by_gates(requests(spark, d), HEAD, "north")
    return W.contexts(open_).select(F.col("context_id").alias("request_id"), "shop", F.col("tiers")[0].alias("tier"), F.col("intents")[0].alias("intent"), F.array_join(F.array_sort("flags"), ",").alias("flags"))


@query(f"WITH {_ROUTES_SQL} SELECT request_id, status, mode, reply, rule_id, reason FROM routes")
def reply_routes(spark: SparkSession, d: str) -> DataFrame:
    """How each request is answered, by gates, matched rules and validation (RPL-01, RPL-05, RPL-08, RPL-11)."""
    return W.united(_stages(spark, d))


@query(f"WITH {_ROUTES_SQL} SELECT request_id, status FROM routes")
def reply_status(spark: SparkSession, d: str) -> DataFrame:
    """Where each request leaves the pipeline (RPL-01, RPL-02): the stage that decides it."""
    return W.united(_stages(spark, d)).select("request_id", "status")


@query(f"WITH {_ROUTES_SQL} SELECT request_id, reason AS verdict FROM judged")
def reply_guard(spark: SparkSession, d: str) -> DataFrame:
    """What the nine tests say of restored and signed replies (RPL-09, RPL-10)."""
    return _stages(spark, d)["validation"].select("request_id", F.col("reason").alias("verdict"))


@query(f"""WITH {_ROUTES_SQL}, answered AS (SELECT f.request_id, creator_id, shop, refuses OR lower(intent) IN ('reject', '拒绝', 'stop') OR rejected AS no, status, rule_id, reply FROM facts f JOIN routes r ON r.request_id = f.request_id)
SELECT creator_id, shop, bool_or(no) AS shop_rejected, count(*) FILTER (WHERE status = 'replied') AS replies, arg_max(rule_id, request_id) FILTER (WHERE rule_id IS NOT NULL AND status = 'replied') AS rule_id FROM answered GROUP BY creator_id, shop""")
def post_reply_updates(spark: SparkSession, d: str) -> DataFrame:
    """What replies leave in the state of a creator in a shop (RPL-15): a refusal, which no later message clears, the replies sent and
    the rule of the last one."""
    said = requests(spark, d).select("request_id", "creator_id", "shop", (F.col("rejected") | W.refusing(F.col("message"), F.col("intent"), F.lit(None), F.lit(None))).alias("no"))
    rows = said.join(W.united(_stages(spark, d)).select("request_id", "status", "rule_id"), "request_id")
    sent = F.col("status") == "replied"
    last = F.max_by("rule_id", F.when(F.col("rule_id").isNotNull() & sent, F.col("request_id")))
    return rows.groupBy("creator_id", "shop").agg(F.bool_or("no").alias("shop_rejected"), F.count(F.when(sent, 1)).alias("replies"), last.alias("rule_id"))


@query("""WITH t AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(floor(o_totalprice) AS INTEGER) END AS views, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 8 AS INTEGER) END AS videos FROM orders) SELECT request_id, """ + ", ".join(f"{v} AS {n}" for n, v in zip(("base", "cap", "second", "half", "views_text", "videos", "total"), (v for _, v in _PAID), strict=True)) + " FROM t WHERE views IS NOT NULL")
def earnings_slots(spark: SparkSession, d: str) -> DataFrame:
    """Estimated earnings of requests with average views, at every rate (NUM-05, RPL-11)."""
    rows = requests(spark, d).where("views is not null").select("request_id", G.earnings(F.col("views"), F.col("videos"), F.lit(None)).alias("e"))
    names = {"base": "avgVV*0.002", "cap": "avgVV*0.004", "second": "avgVV*0.003", "half": "avgVV*0.0015", "views_text": "avgVV", "videos": "videoCount", "total": "total"}
    return rows.select("request_id", *[F.element_at("e", F.lit(k)).alias(n) for n, k in names.items()])
