"""Values of slots from the documents of shops: candidates, scores and one value a slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import slots as S
from ..sources import tables as T
from .registry import query

_SLOTS = ("affiliate_group_link", "apply_form_url", "portal_link", "commission_rate_gmv_gte_1k", "commission_rate_gmv_lt_1k", "first_video_bonus_usd", "per_video_usd", "gmv_bonus", "invite_note", "ai_video_commission_pct")
#: Four documents a shop, of parts; {s} is the type of text and {d} whole division.
_TEXT = """CASE p_partkey % 4
 WHEN 0 THEN concat('For the first video we pay $', cast(p_size AS {s}), '. Per video after it $', cast(p_size % 7 + 1 AS {s}), '.5 is paid. Commission with GMV above 1k is ', cast(p_size % 20 AS {s}), '%, below 1k ', cast(p_size % 9 AS {s}), '%. ', p_name)
 WHEN 1 THEN concat('Join the affiliate group at https://chat.example/', cast(p_partkey AS {s}), '. The apply form: https://form', cast(p_size % 3 AS {s}), '.example/apply?id=', cast(p_size AS {s}), ', then the
 portal: https://portal.example/', cast({d} * 2 AS {s}), repeat(' -', 60), ' font https://fonts.gstatic.com/x', cast(p_size AS {s}))
 WHEN 2 THEN concat('Example: a rate of 50% and $', cast(p_size AS {s}), ' for @someone, AI video commission 12%')
 ELSE concat('width: 40% only', repeat(' .', 60), 'monthly GMV $', cast(p_size AS {s}), ',000 earns', repeat(' .', 60), ' a GMV bonus of $', cast(p_size AS {s}), repeat(' -', 60), ' commission rate lt 1k is ', cast(p_size % 5 AS {s}), '%; ai video commission 7.', cast(p_size % 3 AS {s}), ' %; invite link https://chat.example/', cast({d} * 8 + 1 AS {s}), ').')
 END"""
_FILE = "concat({shop}, CASE p_partkey % 4 WHEN 0 THEN '/add1.txt' WHEN 1 THEN '/supplement-links.md' WHEN 2 THEN '/page.html' ELSE '/add2.txt' END)"


def documents_of(spark: SparkSession, d: str) -> DataFrame:
    """(shop, source_file, text): four files a shop, three of them authoritative."""
    shop = "concat('s', p_partkey div 4)"
    return T.table(spark, d, "part").select(F.expr(shop).alias("shop"), F.expr(_FILE.format(shop=shop)).alias("source_file"), F.expr(_TEXT.format(s="string", d="(p_partkey div 8)")).alias("text"))


def slots_of(spark: SparkSession, d: str) -> DataFrame:
    """(shop, slot, place): three in four of the slots for each shop."""
    each = F.array(*[F.struct(F.lit(n).alias("slot"), F.lit(i).alias("place")) for i, n in enumerate(_SLOTS)])
    shops = T.table(spark, d, "part").select(F.expr("p_partkey div 4").alias("k")).distinct()
    return shops.select("k", F.inline(each)).where("(k + place) % 4 <> 0").select(F.concat(F.lit("s"), "k").alias("shop"), "slot", "place")


def _matches(kind: str, pattern: str, value: str) -> str:
    return f"""SELECT shop, source_file, '{kind}' AS kind, {value} AS value, t,
  CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(r[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS b, length(r[i]) AS n
  FROM (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM (SELECT *, regexp_extract_all(t, '{pattern}') AS r, regexp_split_to_array(t, '{pattern}') AS p FROM docs))"""


_CANDIDATES_SQL = f"""docs AS (SELECT 's' || (p_partkey // 4) AS shop, {_FILE.format(shop="concat('s', p_partkey // 4)")} AS source_file, {_TEXT.format(s="VARCHAR", d="(p_partkey // 8)")} AS t FROM part),
raw AS ({_matches("url", "https?://[^\\s''\"<>()\\[\\]{}，,；;]+", "rtrim(r[i], '.,;)')")}
  UNION ALL {_matches("percent", "[0-9]+(?:\\.[0-9]+)?\\s*%", "regexp_replace(r[i], '\\s', '', 'g')")}
  UNION ALL {_matches("money", "\\$(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\\.[0-9]+)?|[0-9]+(?:\\.[0-9]+)?)", "r[i]")}),
placed AS (SELECT *, trim(regexp_replace(substr(t, greatest(b - 96, 0) + 1, b + n + 96 - greatest(b - 96, 0)), '\\s+', ' ', 'g')) AS context, regexp_matches(source_file, '/(add[0-9]+|supplement)([._-].*)?\\.(txt|md)$') AS auth FROM raw),
cands AS (SELECT shop, source_file, kind, value, b AS begin, context, CASE WHEN b - greatest(b - 96, 0) < length(context) THEN b - greatest(b - 96, 0) ELSE greatest(instr(context, value) - 1, 0) END AS value_at,
    CASE WHEN auth THEN 'authoritative' WHEN regexp_matches(context, '100%\\s*可见') THEN 'policy' ELSE 'illustrative' END AS role FROM placed
  WHERE NOT CASE kind WHEN 'url' THEN regexp_matches(value, '(^|\\.)(fonts\\.googleapis|fonts\\.gstatic|googleapis\\.com|gstatic\\.com|w3\\.org)') OR regexp_matches(context, '(?i)font|stylesheet|preconnect|\\.css|w3\\.org|schema\\.org')
    WHEN 'percent' THEN regexp_matches(context, '(?i)(width|height|font-size|margin|padding|color|top|left|right|transform)\\s*:')
    ELSE auth AND (regexp_matches(context, '@[A-Za-z0-9_]+') OR (CAST(replace(value[2:], ',', '') AS DOUBLE) >= 1000 AND regexp_matches(context, '(?i)GMV|monthly'))) END)"""
_tokens = lambda x: f"list_distinct(list_concat(regexp_extract_all(lower({x}), '[a-z0-9]+'), regexp_extract_all(lower({x}), '[0-9]+k')))"
_has = lambda a, b: f"list_contains({a}, '{b}')"
_two = lambda own, other, signs, yes, no, but="": f"CASE WHEN {_has('k', own)} AND {_has(signs, own)} THEN {yes} ELSE 0 END - CASE WHEN {_has('k', own)} AND {_has(signs, other)}{but} THEN {no} ELSE 0 END"
_SCORES_SQL = f"""slots AS (SELECT DISTINCT 's' || (p_partkey // 4) AS shop, slot, place FROM part, (SELECT unnest({list(_SLOTS)}) AS slot, unnest(range({len(_SLOTS)})) AS place) WHERE (p_partkey // 4 + place) % 4 <> 0),
asked AS (SELECT *, {_tokens("replace(slot, '_', ' ')")} AS k, CASE WHEN slot LIKE 'commission_rate%' OR slot LIKE '%_pct' THEN 'percent' WHEN slot LIKE '%_usd' OR slot LIKE '%bonus%' OR slot LIKE '%per_video%' THEN 'money' WHEN regexp_matches(slot, 'link|portal|form|group|url') THEN 'url' ELSE 'any' END AS sk FROM slots),
parts AS (SELECT *, substr(context, greatest(value_at - 48, 0) + 1, least(value_at, 48)) AS before, substr(context, greatest(value_at - 32, 0) + 1, least(value_at, 32)) AS near_text, substr(context, value_at + length(value) + 1, 24) AS after, {_tokens("context || ' ' || value")} AS o, {_tokens("value")} AS inner_tokens FROM cands WHERE role = 'authoritative'),
signed AS (SELECT *, list_concat(list_concat(CASE WHEN regexp_matches(near_text, '(?i)first|1st') THEN ['first'] ELSE [] END, CASE WHEN regexp_matches(near_text, '(?i)per video|each video|per post') THEN ['per'] ELSE [] END), list_concat(CASE WHEN regexp_matches(near_text, 'gte|>=') THEN ['gte'] ELSE [] END, CASE WHEN regexp_matches(near_text, 'lt|<') THEN ['lt'] ELSE [] END)) AS near,
  list_concat(CASE WHEN regexp_matches(before, '(?i)gte|>=|above|over|minimum') THEN ['gte'] ELSE [] END, CASE WHEN regexp_matches(before, '(?i)lt|<|below|under|less') THEN ['lt'] ELSE [] END) AS wide FROM parts),
pairs AS (SELECT s.shop, s.slot, s.place, c.source_file, c.kind, c.value, c.begin, CASE c.kind WHEN 'url' THEN 1 WHEN 'percent' THEN 2 ELSE 3 END AS kp,
  round(CAST(len(list_intersect(k, o)) AS DOUBLE) / len(k) + 0.35 * len(list_filter(k, lambda x: list_contains(inner_tokens, x) OR (length(x) >= 2 AND contains(lower(value), x)))) / len(k)
   + {_two("gte", "lt", "(CASE WHEN len(near) > 0 THEN near ELSE wide END)", 0.25, 0.35)} + {_two("lt", "gte", "(CASE WHEN len(near) > 0 THEN near ELSE wide END)", 0.25, 0.35)}
   + {_two("first", "per", "near", 0.35, 0.4, " AND NOT list_contains(near, 'first')")} + {_two("per", "first", "near", 0.35, 0.4, " AND NOT list_contains(near, 'per')")}
   + CASE WHEN sk = c.kind THEN 0.05 ELSE 0 END - CASE WHEN sk = 'percent' AND list_contains(k, 'commission') AND NOT regexp_matches(context, '(?i)commission|rate|percent') THEN 0.4 ELSE 0 END
   + CASE WHEN slot LIKE '%ai_video%' AND slot LIKE '%commission%' THEN CASE WHEN regexp_matches(before || after, '(?i)ai video') THEN 0.65 WHEN regexp_matches(before, '(?i)affiliate') THEN -0.55 ELSE 0 END ELSE 0 END
   - CASE WHEN slot = 'commission_rate_gmv_lt_1k' AND regexp_matches(before || after, '(?i)ai video') THEN 0.55 ELSE 0 END, 6) AS score
  FROM asked s JOIN signed c ON c.shop = s.shop AND (s.sk = 'any' OR s.sk = c.kind))"""


@query(f"WITH {_CANDIDATES_SQL} SELECT shop, source_file, kind, value, begin, context, value_at, role FROM cands")
def slot_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Values in documents with their surroundings and roles, without noise (KB-15, FLT-13, STR-20)."""
    return S.candidates(documents_of(spark, d))


@query(f"""WITH RECURSIVE {_CANDIDATES_SQL}, {_SCORES_SQL},
listed AS MATERIALIZED (SELECT *, CASE WHEN kind = 'url' THEN value ELSE source_file || ' ' || kind || ' ' || begin END AS take, row_number() OVER (PARTITION BY shop ORDER BY score DESC, place, source_file, kp, begin) AS i FROM pairs WHERE score >= 0.15),
walk(shop, i, used, chosen) AS (
  SELECT DISTINCT shop, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]) FROM listed
  UNION ALL
  SELECT w.shop, l.i, CASE WHEN free THEN list_concat(used, ['slot ' || slot, 'take ' || take]) ELSE used END, CASE WHEN free THEN list_append(chosen, l.i) ELSE chosen END
  FROM walk w JOIN (SELECT shop, i, slot, take FROM listed) l ON l.shop = w.shop AND l.i = w.i + 1, LATERAL (SELECT NOT list_has_any(used, ['slot ' || l.slot, 'take ' || l.take]) AS free)
), best AS (SELECT shop, unnest(chosen) AS i FROM (SELECT shop, max_by(chosen, i) AS chosen FROM walk GROUP BY shop))
SELECT s.shop, s.slot, value, source_file, score FROM slots s LEFT JOIN (SELECT l.* FROM listed l JOIN best USING (shop, i)) b ON b.shop = s.shop AND b.slot = s.slot""")
def slot_values(spark: SparkSession, d: str) -> DataFrame:
    """The value that each slot of a shop gets from its documents (JOIN-11, KB-16, SRT-06, NUM-11)."""
    return S.slot_values(slots_of(spark, d), documents_of(spark, d))
