"""Scalar functions applied to derived rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..sources import tables as T
from ..sources.tables import with_tables
from .registry import query

SLOTS = {"group_link": "https://example.com/join", "rate": "36", "brand": "Example Shop"}

_GMV_RAW = "CASE o_orderkey % 6 WHEN 0 THEN '$' || cast(floor(o_totalprice) AS BIGINT) WHEN 1 THEN cast(cast(floor(o_totalprice) AS BIGINT) % 90 AS VARCHAR) || 'k' WHEN 2 THEN '0-$5k' WHEN 3 THEN cast(cast(floor(o_totalprice) AS BIGINT) % 90 AS VARCHAR) || '.5' WHEN 4 THEN 'about 15k' ELSE 'unknown' END"


def _gmv_raw(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr(_GMV_RAW.replace("VARCHAR", "STRING"))
    return T.table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))


_GMV_SQL = f"""raws AS (SELECT o_orderkey, {_GMV_RAW} AS raw FROM orders), texts AS (SELECT o_orderkey, raw, lower(regexp_replace(raw, '[\\s,$]', '', 'g')) AS t FROM raws),
parts AS (SELECT *, regexp_extract(t, '[0-9]+(?:\\.[0-9]+)?', 0) AS num, TRY_CAST(regexp_extract(t, '[0-9]+(?:\\.[0-9]+)?', 0) AS DOUBLE) AS v FROM texts),
amounts AS (SELECT o_orderkey, raw, CASE WHEN (contains(t, '5k') OR contains(t, '5000')) AND (starts_with(t, '0') OR contains(t, '0-')) THEN 2500.0 WHEN contains(t, '5k') OR contains(t, '5000') THEN 5000.0
  WHEN regexp_matches(t, '[0-9]k') THEN v * 1000 WHEN v < 100 AND contains(num, '.') THEN v * 1000 ELSE v END AS amount FROM parts)"""


@query("WITH " + _GMV_SQL + " SELECT o_orderkey, raw, amount FROM amounts")
def gmv_parse(spark: SparkSession, d: str) -> DataFrame:
    return _gmv_raw(spark, d).withColumn("amount", N.gmv(F.col("raw")))


@query("WITH " + _GMV_SQL + """ SELECT o_orderkey, CASE WHEN amount > 5000 THEN 'gmv_high' WHEN amount >= 1000 THEN 'gmv_mid' WHEN amount IS NOT NULL THEN 'gmv_low' END AS flag,
CASE WHEN amount >= 5000 THEN 'A' WHEN amount >= 1000 THEN 'B' WHEN amount IS NOT NULL THEN 'C' END AS tier FROM amounts""")
def gmv_flags(spark: SparkSession, d: str) -> DataFrame:
    amount = N.gmv(F.col("raw"))
    return _gmv_raw(spark, d).select("o_orderkey", N.gmv_flag(amount).alias("flag"), N.gmv_tier(amount).alias("tier"))


@query("""WITH v AS (SELECT p_partkey, CAST(p_partkey * 37 AS DECIMAL(18,4)) AS views, p_size % 6 + 1 AS n FROM part)
SELECT p_partkey, format('{:,}', CAST(views AS BIGINT)) AS views_text, regexp_replace(printf('%.2f', CAST(views * 0.002 AS DOUBLE)), '\\.?0+$', '') AS base,
regexp_replace(printf('%.2f', CAST(views * 0.004 AS DOUBLE)), '\\.?0+$', '') AS double_rate, regexp_replace(printf('%.2f', CAST(views * 0.002 * n AS DOUBLE)), '\\.?0+$', '') AS total FROM v""".replace("\\\\", "\\"))
def earnings(spark: SparkSession, d: str) -> DataFrame:
    views, n = (F.col("p_partkey") * 37).cast("decimal(18,4)"), F.col("p_size") % 6 + 1
    rate = lambda r: views * F.lit(r).cast("decimal(6,4)")
    return T.table(spark, d, "part").select("p_partkey", F.format_number(views, 0).alias("views_text"), N.money_text(rate("0.002")).alias("base"), N.money_text(rate("0.004")).alias("double_rate"), N.money_text(rate("0.002") * n).alias("total"))


@query("SELECT c_custkey, round(least(1.0, greatest(0.0, 1 / (1 + abs(c_acctbal) / 1000))), 6) AS similarity FROM customer")
def similarity(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "customer").select("c_custkey", N.similarity(F.abs("c_acctbal") / 1000).alias("similarity"))


_QUOTE_TEXT = "concat('gmv was $', cast(cast(floor(o_totalprice) AS bigint) % 700 AS {s}), ' last month, my rate is $', cast(cast(floor(o_totalprice) AS bigint) % 5000 AS {s}), CASE WHEN o_orderkey % 2 = 0 THEN '.50 per video' ELSE ' for a set of clips, or $9' END)"


@query(r"""WITH texts AS (SELECT o_orderkey, """ + _QUOTE_TEXT.format(s="VARCHAR") + r""" AS t FROM orders),
cut AS (SELECT o_orderkey, regexp_split_to_array(regexp_replace(t, '\$\s?([0-9])', '§\1', 'g'), '§') AS p FROM texts),
each AS (SELECT o_orderkey, lower(right(p[i], 40)) AS b, CAST(regexp_extract(p[i + 1], '^[0-9]+(?:\.[0-9]{1,2})?', 0) AS DECIMAL(18,2)) AS amount FROM (SELECT o_orderkey, p, unnest(range(1, len(p))) AS i FROM cut)),
scored AS (SELECT o_orderkey, amount, 1 + """ + " + ".join(f"CASE WHEN contains(b, '{h}') THEN 2 ELSE 0 END" for h in X.QUOTE_HINTS) + " - " + " - ".join(f"CASE WHEN contains(b, '{h}') THEN 2 ELSE 0 END" for h in X.QUOTE_AGAINST) + """ AS score FROM each),
best AS (SELECT o_orderkey, max({'score': score, 'amount': amount}) AS q FROM scored GROUP BY o_orderkey)
SELECT o_orderkey, CAST(q.amount AS DOUBLE) AS amount, q.score AS score FROM best""")
def quote_before_hints(spark: SparkSession, d: str) -> DataFrame:
    """The dollar amount with the most hints before it; quote_extract weighs hints on both sides."""
    rows = T.table(spark, d, "orders").select("o_orderkey", F.expr(_QUOTE_TEXT.format(s="string")).alias("t"))
    return rows.withColumn("q", X.quote(F.col("t"))).select("o_orderkey", F.col("q.amount").cast("double").alias("amount"), F.col("q.score").alias("score"))


@query("""WITH cells AS (SELECT p_partkey, p_brand || ', ' || p_type || '；' || CASE WHEN p_size % 5 = 0 THEN 'GEN' ELSE p_name END || ' ,; ' AS cell FROM part)
SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(cell, '[,，;；]+'), lambda x: trim(x)), lambda x: x <> ''), '|') AS all_values,
array_to_string(list_filter(list_transform(regexp_split_to_array(cell, '[,，;；]+'), lambda x: trim(x)), lambda x: x <> '' AND upper(x) <> 'GEN'), '|') AS constraints FROM cells""")
def multi_values(spark: SparkSession, d: str) -> DataFrame:
    cell = F.concat("p_brand", F.lit(", "), "p_type", F.lit("；"), F.when(F.col("p_size") % 5 == 0, "GEN").otherwise(F.col("p_name")), F.lit(" ,; "))
    found = X.values(cell)
    return T.table(spark, d, "part").select("p_partkey", F.array_join(found, "|").alias("all_values"), F.array_join(X.without_wildcards(found), "|").alias("constraints"))


@query(r"""SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) THEN 'en' ELSE 'zh' END AS guess FROM documents""")
def language_guess(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").select("doc_id", X.language_guess(F.col("text")).alias("guess"))


@query(r"SELECT page_id, lower(regexp_replace(regexp_replace(url, '[^\p{L}\p{N}]+', '-', 'g'), '^-|-$', '', 'g')) AS slug FROM pages")
def page_slug(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "pages").select("page_id", X.slug(F.col("url")).alias("slug"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(?:script|style)\b.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS shown FROM a""")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "pages").select("page_id", X.html_text(F.col("html")).alias("shown"))


_OFFER = "concat('See ', url, '. Or (', url, '), pay $', cast(page_id % 90 AS {s}), '.50 now, ', cast(page_id % 30 AS {s}), '% off; $ 7')"


@query(r"WITH o AS (SELECT page_id, " + _OFFER.format(s="VARCHAR") + r""" AS t FROM pages)
SELECT page_id, array_to_string(list_distinct(list_transform(regexp_extract_all(t, 'https?://[^\s<>"'')\]]+'), lambda u: regexp_replace(u, '[.,;:!?]+$', ''))), ' ') AS links,
array_to_string(regexp_extract_all(t, '\$\s?[0-9]+(?:\.[0-9]+)?'), ' ') AS money, array_to_string(regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)?\s?%'), ' ') AS percents FROM o""")
def offers(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr(_OFFER.format(s="string"))
    rows = T.table(spark, d, "pages").select("page_id", t.alias("t"))
    return rows.select("page_id", F.array_join(X.urls(F.col("t")), " ").alias("links"), F.array_join(X.amounts(F.col("t")), " ").alias("money"), F.array_join(X.percentages(F.col("t")), " ").alias("percents"))


@query("""SELECT p_partkey, replace(replace(replace('Join {group_link} for {rate}, ${brand} {other} ' || p_name, '{group_link}', 'https://example.com/join'), '{rate}', '36'), '{brand}', 'Example Shop') AS script,
'other' AS missing FROM part""")
def restore_slots(spark: SparkSession, d: str) -> DataFrame:
    script = X.restored(F.concat(F.lit("Join {group_link} for {rate}, ${brand} {other} "), "p_name"), SLOTS)
    return T.table(spark, d, "part").select("p_partkey", script.alias("script"), F.array_join(X.placeholders(script), ",").alias("missing"))


@query("""SELECT p_partkey, replace(replace(replace('Go to https://example.com/join, Example Shop pays $36 for ' || p_name, 'https://example.com/join', '{group_link}'), 'Example Shop', '{brand}'), '36', '{rate}') AS script FROM part""")
def desensitise(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "part").select("p_partkey", X.desensitised(F.concat(F.lit("Go to https://example.com/join, Example Shop pays $36 for "), "p_name"), SLOTS).alias("script"))


@query(r"""WITH b AS (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || '- Robin ' ELSE '  — robin' END AS t FROM part)
SELECT p_partkey, regexp_replace(regexp_replace(t, '(?i)\s*[-–—]*\s*Robin\s*$', ''), '^\s+|\s+$', '', 'g') || chr(10) || chr(10) || '- Robin' AS signed FROM b""")
def signature(spark: SparkSession, d: str) -> DataFrame:
    end = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, "\n- Robin ").otherwise("  — robin")
    return T.table(spark, d, "part").select("p_partkey", X.signed(F.concat("p_name", end), "Robin").alias("signed"))


_STAMP = "CASE event_id % 4 WHEN 0 THEN {f1} WHEN 1 THEN {f2} WHEN 2 THEN {f3} ELSE 'no time' END"


@query("""WITH s AS (SELECT event_id, """ + _STAMP.format(f1="strftime(ts, '%Y-%m-%d %H:%M:%S')", f2="strftime(ts, '%Y/%m/%d %H:%M')", f3="strftime(ts, '%Y-%m-%dT%H:%M:%S')") + """ AS t FROM events)
SELECT event_id, coalesce(try_strptime(t, '%Y-%m-%d %H:%M:%S'), try_strptime(t, '%Y/%m/%d %H:%M'), try_strptime(t, '%Y-%m-%dT%H:%M:%S')) AS parsed FROM s""")
def datetime_parse(spark: SparkSession, d: str) -> DataFrame:
    made = F.expr(_STAMP.format(f1="date_format(ts, 'yyyy-MM-dd HH:mm:ss')", f2="date_format(ts, 'yyyy/MM/dd HH:mm')", f3="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"))
    parse = lambda f: F.try_to_timestamp("t", F.lit(f))
    rows = T.table(spark, d, "events").select("event_id", made.alias("t"))
    return rows.select("event_id", F.coalesce(parse("yyyy-MM-dd HH:mm:ss"), parse("yyyy/MM/dd HH:mm"), parse("yyyy-MM-dd'T'HH:mm:ss")).alias("parsed"))


_PAIRS = "concat('(''', cast(p_partkey AS VARCHAR), ''', ''', cast(p_size AS VARCHAR), ''')')"


@query("SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(regexp_replace(" + _PAIRS + ", '[()''\" ]', '', 'g'), ','), lambda x: x <> ''), '|') AS ids FROM part")
def tuple_parse(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("('"), "p_partkey", F.lit("', '"), "p_size", F.lit("')"))
    bare = F.regexp_replace(made, "[()'\" ]", "")
    return T.table(spark, d, "part").select("p_partkey", F.array_join(F.filter(F.split(bare, ","), lambda x: x != ""), "|").alias("ids"))


@query(with_tables("messages audit_log", r"""lines AS (SELECT id, unnest(string_split(message_info, chr(10))) AS line, unnest(range(0, len(string_split(message_info, chr(10))))) AS pos FROM audit_log)
SELECT id, pos, regexp_extract(line, '^\[([^\]]*)\]\[([a-z]+)(?::([^\]]*))?\]\s*(.*)$', 1) AS at, regexp_extract(line, '^\[([^\]]*)\]\[([a-z]+)(?::([^\]]*))?\]\s*(.*)$', 2) AS role,
regexp_extract(line, '^\[([^\]]*)\]\[([a-z]+)(?::([^\]]*))?\]\s*(.*)$', 4) AS body FROM lines"""))
def conversation_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = T.audit_log(spark, d).select("id", F.posexplode(F.split("message_info", "\n")).alias("pos", "line"))
    return lines.select("id", F.col("pos").cast("long").alias("pos"), *[X.line_part(F.col("line"), p).alias(n) for p, n in (("time", "at"), ("role", "role"), ("body", "body"))])
