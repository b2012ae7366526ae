"""Values of records: cells, flags, labels, scores, names, links and metadata, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources import tables as T
from ..sources.tables import with_tables
from .registry import query

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(f"""WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' || p_name WHEN 2 THEN p_brand || ' ;， ' || p_type WHEN 3 THEN ',' || p_brand ELSE ' ;; ' END AS raw FROM part),
s AS (SELECT p_partkey, {_STRIP.format("coalesce(raw, '')")} AS s FROM t), p AS (SELECT *, list_filter(list_transform(string_split_regex(s, '[,，;；]+'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS parts FROM s),
v AS (SELECT *, CASE WHEN NOT regexp_matches(s, '[,，;；]+') THEN s WHEN len(parts) = 0 THEN '' WHEN len(parts) = 1 THEN parts[1] END AS value FROM p)
SELECT p_partkey, value, CASE WHEN value IS NULL THEN array_to_string(parts, '|') END AS items, CASE WHEN value IS NULL THEN CAST(to_json(parts) AS VARCHAR) END AS json FROM v""")
def cell_values(spark: SparkSession, d: str) -> DataFrame:
    """Cells with several values (ARR-01, ARR-03)."""
    k = F.col("p_partkey") % 5
    raw = F.when(k == 1, F.concat(F.lit(" "), "p_name")).when(k == 2, F.concat("p_brand", F.lit(" ;， "), "p_type")).when(k == 3, F.concat(F.lit(","), "p_brand")).when(k == 4, " ;; ")
    rows = T.table(spark, d, "part").select("p_partkey", V.cell(raw).alias("c"))
    return rows.select("p_partkey", "c.value", F.array_join("c.items", "|").alias("items"), V.json_text(F.col("c.items")).alias("json"))


@query("""WITH t AS (SELECT c_custkey, ['vip', 'node:A' || (c_custkey % 3), 'new'] AS own, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE ['new', 'seg:' || c_mktsegment, 'seg:' || c_mktsegment] END AS more FROM customer)
SELECT c_custkey, array_to_string(list_concat(own, list_filter(['new', list_extract(more, 2)], lambda x: x IS NOT NULL AND NOT list_contains(own, x))), ',') AS merged,
  array_to_string(list_filter(own, lambda x: more IS NULL OR NOT list_contains(more, x)), ',') AS beyond, array_to_string(list_filter(own, lambda x: NOT starts_with(x, 'node:')), ',') AS plain FROM t""")
def flag_lists(spark: SparkSession, d: str) -> DataFrame:
    """Flags merged in order, beyond a general layer, without prefixes (ARR-08, ARR-10, SET-06, SET-07)."""
    own = F.array(F.lit("vip"), F.concat(F.lit("node:A"), F.col("c_custkey") % 3), F.lit("new"))
    segment = F.concat(F.lit("seg:"), "c_mktsegment")
    more = F.when(F.col("c_custkey") % 4 != 0, F.array(F.lit("new"), segment, segment))
    join = lambda x: F.array_join(x, ",")
    return T.table(spark, d, "customer").select("c_custkey", join(V.merged(own, more)).alias("merged"), join(V.overlay(own, more)).alias("beyond"), join(V.without_prefixes(own, ("node:",))).alias("plain"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ' High' WHEN 1 THEN 'medium' WHEN 2 THEN '0.8' WHEN 3 THEN '7' WHEN 4 THEN 'none' END AS label, CASE o_orderkey % 3 WHEN 0 THEN '1,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN '-5' ELSE ' 12.5 ' END AS raw, o_totalprice FROM orders)
SELECT o_orderkey, CASE lower(trim(label)) WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.65 WHEN 'low' THEN 0.35 ELSE CASE WHEN TRY_CAST(trim(label) AS DOUBLE) IS NOT NULL THEN least(1.0, greatest(0.0, TRY_CAST(trim(label) AS DOUBLE))) END END AS confidence,
CASE WHEN TRY_CAST(regexp_replace(raw, '[,\\s]', '', 'g') AS DOUBLE) >= 0 THEN TRY_CAST(regexp_replace(raw, '[,\\s]', '', 'g') AS DOUBLE) END AS number, CAST(round(CAST(o_totalprice AS DECIMAL(18,4)) / 3, 2) AS DECIMAL(18,2)) AS quote,
CASE o_orderkey % 4 WHEN 0 THEN 'gmv_high,vip' WHEN 1 THEN 'gmv_low' ELSE '' END AS flags FROM t""".replace("CAST(round(CAST(o_totalprice AS DECIMAL(18,4)) / 3, 2) AS DECIMAL(18,2))", "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)"))
def label_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Labels and texts as numbers, quotes with two decimals, flags of levels (NUM-04, NUM-08, NUM-09, NUM-10)."""
    k = F.col("o_orderkey")
    label = F.when(k % 6 == 0, " High").when(k % 6 == 1, "medium").when(k % 6 == 2, "0.8").when(k % 6 == 3, "7").when(k % 6 == 4, "none")
    raw = F.when(k % 3 == 0, F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"))).when(k % 3 == 1, "-5").otherwise(" 12.5 ")
    level = F.when(k % 4 == 0, " top").when(k % 4 == 1, "low").when(k % 4 == 2, "?")
    flags = V.level_flags(level, {"top": ("gmv_high", "vip"), "low": ("gmv_low",)})
    return T.table(spark, d, "orders").select("o_orderkey", V.confidence(label).alias("confidence"), V.number_or_null(raw).alias("number"), V.quote_amount(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("quote"), F.array_join(flags, ",").alias("flags"))


@query(f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source END AS et, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN ' ' || lang END AS eb, source AS ti, substr(coalesce(text, ''), 1, 60) AS bo, CASE WHEN doc_id % 4 = 0 THEN ' step ' END AS pr FROM documents),
u AS (SELECT doc_id, {_STRIP.format("coalesce(et, '')")} AS et, {_STRIP.format("coalesce(eb, '')")} AS eb, {_STRIP.format("coalesce(ti, '')")} AS ti, {_STRIP.format("bo")} AS bo, trim(coalesce(pr, '')) AS pr FROM t),
b AS (SELECT doc_id, pr, CASE WHEN {_STRIP.format("et || chr(10) || eb")} <> '' THEN {_STRIP.format("et || chr(10) || eb")} ELSE {_STRIP.format("ti || chr(10) || bo")} END AS base FROM u)
SELECT doc_id, CASE WHEN pr <> '' THEN {_STRIP.format("base || chr(10) || '三级分类-达人进度: ' || pr")} ELSE base END AS text FROM b""")
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    """What is embedded of each chunk (STR-09)."""
    k = F.col("doc_id")
    text = V.embedding_text(
        F.when(k % 3 == 0, F.col("source")), F.when((k % 3 == 0) & (k % 2 == 0), F.concat(F.lit(" "), "lang")), F.col("source"),
        F.substring(F.coalesce("text", F.lit("")), 1, 60), F.when(k % 4 == 0, " step "),
    )
    return T.table(spark, d, "documents").select("doc_id", text.alias("text"))


@query(r"""WITH t AS (SELECT doc_id, text, CAST(instr(text, ' the ') AS BIGINT) - 1 AS b FROM documents WHERE contains(text, ' the '))
SELECT doc_id, regexp_replace(regexp_replace(substr(text, greatest(b - 96, 0) + 1, b + 5 + 96 - greatest(b - 96, 0)), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS around FROM t""")
def context_windows(spark: SparkSession, d: str) -> DataFrame:
    """What stands around the first match of each text (STR-20)."""
    found = T.table(spark, d, "documents").where(F.contains("text", F.lit(" the ")))
    return found.select("doc_id", V.context_window(F.col("text"), F.instr("text", F.lit(" the ")) - 1, F.lit(5)).alias("around"))


_SLOTS = "CASE p_partkey % 4 WHEN 0 THEN 'affiliate_link_gmv_gte_1k' WHEN 1 THEN 'first_bonus_usd' WHEN 2 THEN 'commission_rate' ELSE 'per_video_usd' END"
_VALUES = "CASE p_partkey % 3 WHEN 0 THEN concat('https://affiliate.example/', p_partkey) WHEN 1 THEN concat('$', p_size) ELSE concat(p_size, '%') END"
_AROUND = "CASE p_partkey % 5 WHEN 0 THEN 'the first bonus' WHEN 1 THEN 'gmv lt 1k link' WHEN 2 THEN 'commission rate for all' WHEN 3 THEN 'gte 1k per video' ELSE 'width of the page' END"
_TOKENS = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[0-9]+k|[a-z]+|[0-9]+'))"
_KIND = "CASE WHEN slot LIKE '%commission_rate%' THEN 'percent' WHEN regexp_matches(slot, '_usd|bonus|per_video') THEN 'money' WHEN regexp_matches(slot, 'link|portal|form|group|url') THEN 'url' ELSE 'any' END"
_BOUNDS = " + ".join(f"CASE WHEN list_contains(k, '{a}') AND list_contains(n, '{a}') THEN {x} ELSE 0 END - CASE WHEN list_contains(k, '{a}') AND list_contains(n, '{b}'){c} THEN {y} ELSE 0 END"
                     for a, b, x, y, c in (("gte", "lt", 0.25, 0.35, ""), ("lt", "gte", 0.25, 0.35, ""), ("first", "per", 0.35, 0.4, " AND NOT list_contains(n, 'first')"), ("per", "first", 0.35, 0.4, " AND NOT list_contains(n, 'per')")))


@query(f"""WITH t AS (SELECT p_partkey, {_SLOTS} AS slot, {_VALUES} AS v, {_AROUND} AS a FROM part),
u AS (SELECT *, {_TOKENS("replace(slot, '_', ' ')")} AS k, {_TOKENS("a || ' ' || v")} AS n, {_TOKENS("v")} AS i, {_KIND} AS kind, CASE p_partkey % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'money' ELSE 'percent' END AS vk FROM t)
SELECT p_partkey, kind, round(CAST(len(list_intersect(k, n)) AS DOUBLE) / len(k) + 0.35 * len(list_filter(k, lambda x: list_contains(i, x) OR (length(x) >= 2 AND contains(lower(v), x)))) / len(k) + {_BOUNDS} + CASE WHEN kind = vk THEN 0.05 ELSE 0 END, 6) AS score,
  coalesce(CASE vk WHEN 'url' THEN false WHEN 'percent' THEN regexp_matches(a, 'width|height|opacity|margin|padding') WHEN 'money' THEN regexp_matches(a, 'policy|penalty|example') OR (TRY_CAST(replace(v, '$', '') AS DOUBLE) >= 1000 AND regexp_matches(a, 'gmv|monthly')) END, false) AS noise FROM u""")
def slot_scores(spark: SparkSession, d: str) -> DataFrame:
    """How well candidates fit slots, and which are noise (NUM-11, FLT-13, JOIN-11)."""
    kind = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'money' ELSE 'percent' END")
    rows = T.table(spark, d, "part").select("p_partkey", F.expr(_SLOTS).alias("slot"), F.expr(_VALUES).alias("v"), F.expr(_AROUND).alias("a"), kind.alias("vk"))
    own = V.slot_kind(F.col("slot"))
    return rows.select("p_partkey", own.alias("kind"), V.slot_score(F.col("slot"), F.col("v"), F.col("a"), own == F.col("vk")).alias("score"), V.is_noise(F.col("vk"), F.col("v"), F.col("a")).alias("noise"))


@query(with_tables("messages", """SELECT conv_id, turn, trim(coalesce(text, '')) = '' OR contains(lower(text), 'intent_skip') OR role = 'system' AS handoff FROM messages"""))
def handoffs(spark: SparkSession, d: str) -> DataFrame:
    """Messages that are left to people (FLT-11)."""
    title = F.when(F.col("role") == "system", "INTENT_classifier_handoff")
    return T.messages(spark, d).select("conv_id", "turn", V.is_handoff(F.col("text"), title).alias("handoff"))


@query("""WITH t AS (SELECT event_id, ts, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2024-01-07 16:30') AS s, event_id % 3 + 1 AS part FROM events)
SELECT event_id, strftime(s, '%Y-%m-%d') || '_' || strftime(s + INTERVAL 7 DAY, '%Y-%m-%d') || CASE WHEN part = 1 THEN '' ELSE '-' || part END AS name, 'Log ' || strftime(s, '%Y年%m月%d日') || '-' || strftime(s + INTERVAL 7 DAY, '%Y年%m月%d日') AS words,
date_trunc('day', ts) - INTERVAL 1 DAY + INTERVAL 990 MINUTE AS report_start FROM t""")
def week_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of weekly tables and the bounds of a report (DT-01, DT-07)."""
    week = F.window("ts", "7 days", "7 days", "3 days 16 hours 30 minutes")
    rows = T.table(spark, d, "events").select("event_id", "ts", week.alias("w"))
    start, end = F.col("w.start"), F.col("w.end")
    return rows.select(
        "event_id", V.week_name(start, end, F.col("event_id") % 3 + 1).alias("name"), V.week_name(start, end, F.lit(1), "Log").alias("words"), V.report_bounds(F.col("ts"))["start"].alias("report_start"),
    )


@query(r"""WITH t AS (SELECT page_id, url, split_part(url, '#', 1) AS bare FROM pages), u AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '([?&])table=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&', '?'), '[?&]$', '') AS b, regexp_extract(url, '(#.*)$', 1) AS f FROM t)
SELECT page_id, b || CASE WHEN contains(b, '?') THEN '&' ELSE '?' END || 'table=t' || page_id || f AS url FROM u""")
def url_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Links with a parameter set (STR-28)."""
    return T.table(spark, d, "pages").select("page_id", V.with_query(F.col("url"), "table", F.concat(F.lit("t"), "page_id")).alias("url"))


@query("""WITH x AS (SELECT doc_id, MAP {'source': source, 'lang': CASE WHEN doc_id % 3 <> 0 THEN lang END, 'note': CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE 'n' || doc_id END} AS m, doc_id % 2 = 0 AS sheet, n_chars FROM documents)
SELECT doc_id, array_to_string(list_sort(list_concat(list_transform(list_filter(map_entries(m), lambda e: e.value IS NOT NULL AND (NOT sheet OR trim(e.value) <> '')), lambda e: e.key || '=' || e.value), CASE WHEN n_chars IS NULL THEN CAST([] AS VARCHAR[]) ELSE ['col_chars=' || n_chars] END)), ';') AS metadata FROM x""")
def chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of chunks as flat maps (ARR-07)."""
    k = F.col("doc_id")
    fields = {"source": F.col("source"), "lang": F.when(k % 3 != 0, F.col("lang")), "note": F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("n"), "doc_id"))}
    made = V.metadata(fields, F.create_map(F.lit("chars"), F.col("n_chars").cast("string")), k % 2 == 0)
    pairs = F.transform(F.map_entries(made), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return T.table(spark, d, "documents").select("doc_id", F.array_join(F.sort_array(pairs), ";").alias("metadata"))


@query("""WITH names AS (SELECT DISTINCT CASE p_partkey % 9 WHEN 0 THEN 'GEN' WHEN 1 THEN 'A-level' WHEN 2 THEN 'SS-level' WHEN 3 THEN 'C-level' ELSE p_brand END AS name FROM part),
r AS (SELECT name, CAST(CASE WHEN name = 'GEN' THEN 0 WHEN name = 'A-level' THEN 1 WHEN name = 'C-level' THEN 3 WHEN name = 'SS-level' THEN 5 ELSE 6 END AS INTEGER) AS rank FROM names)
SELECT name, rank, row_number() OVER (ORDER BY rank, lower(name)) AS place FROM r""")
def tier_order(spark: SparkSession, d: str) -> DataFrame:
    """Tiers of a hierarchy in their order, the wildcard first (SRT-07, SRT-08); the names of a vocabulary fit in one task."""
    k = F.col("p_partkey") % 9
    name = F.when(k == 0, "GEN").when(k == 1, "A-level").when(k == 2, "SS-level").when(k == 3, "C-level").otherwise(F.col("p_brand"))
    ranked = T.table(spark, d, "part").select(name.alias("name")).distinct().withColumn("rank", V.tier_rank(F.col("name")))
    listed = ranked.agg(F.array_sort(F.collect_list(F.struct("rank", F.lower("name").alias("low"), "name"))).alias("all"))
    return listed.select(F.posexplode("all")).select("col.name", "col.rank", (F.col("pos") + 1).cast("long").alias("place"))
