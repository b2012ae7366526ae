"""Parsing of pages, headers, replies of models, lists and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import records as X
from ..operators import outline
from ..sources import tables as T
from .registry import query

_PAGE = "CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN replace(html, '</article>', '</article><h2>Terms</h2><p>short</p><h3>Fine print</h3><h1 class=\"x\">Next <b>part</b></h1><!-- <h2>no</h2> --><H3>Detail</H3>some text') WHEN 2 THEN 'no heading at all' WHEN 3 THEN concat('<p>', repeat('long text ', 20), '</p><h2> </h2>end') END"
_TEXT = lambda x: rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(?:script|style)\b.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query(rf"""WITH t AS (SELECT page_id, {_PAGE} AS h FROM pages), m AS (SELECT page_id, h, string_split(regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', '', 'g'), '(?i)(<h[1-3][\s>])', chr(1) || '\1', 'g'), chr(1)) AS parts FROM t WHERE h IS NOT NULL),
e AS (SELECT page_id, h, unnest(parts) AS p, unnest(range(len(parts))) AS pos FROM m),
l AS (SELECT page_id, h, pos, coalesce(TRY_CAST(regexp_extract(p, '(?i)^<h([1-3])[\s>]', 1) AS INTEGER), 0) AS level, nullif({_TEXT("regexp_extract(p, '(?is)^<h[1-3][^>]*>(.*?)</h[1-3]>', 1)")}, '') AS heading, {_TEXT("CASE WHEN regexp_matches(p, '(?i)^<h[1-3][\\s>]') THEN regexp_replace(p, '(?is)^<h[1-3][^>]*>(?:.*?</h[1-3]>)?', '') ELSE p END")} AS body FROM e),
f AS (SELECT *, last_value(CASE WHEN level = 1 THEN heading END IGNORE NULLS) OVER w AS section, last_value(CASE WHEN level = 2 THEN heading END IGNORE NULLS) OVER w AS carried, coalesce(last_value(CASE WHEN level = 1 THEN pos END IGNORE NULLS) OVER w, -1) AS a, coalesce(last_value(CASE WHEN level = 2 AND heading IS NOT NULL THEN pos END IGNORE NULLS) OVER w, -1) AS b FROM l
  WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT *, coalesce(carried, section, 'General') AS intent, coalesce(CASE WHEN level = 3 THEN heading END, CASE WHEN b > a THEN carried END, section) AS titled FROM f), c AS (SELECT *, CASE WHEN body <> '' THEN body ELSE coalesce(titled, '') END AS content FROM g),
k AS (SELECT *, NOT (content = coalesce(titled, '') AND length(content) < 40) AND NOT (titled IS NULL AND length(content) < 150) AS keeps FROM c),
s AS (SELECT *, CAST(sum(CASE WHEN keeps THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS seq, max(keeps) OVER (PARTITION BY page_id) AS found FROM k)
SELECT page_id, seq, intent AS intent_category, coalesce(titled, 'HTML-' || seq) AS title, content FROM s WHERE keeps
UNION ALL SELECT page_id, 1, coalesce(section, 'page' || page_id), coalesce(section, 'page' || page_id), {_TEXT("h")} FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos DESC) AS r FROM s WHERE NOT found) WHERE r = 1 AND {_TEXT("h")} <> ''""")
def html_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of pages by headings that are carried down (CHK-03, WIN-09, SRC-02)."""
    pages = T.table(spark, d, "pages").select("page_id", F.expr(_PAGE).alias("h"), F.concat(F.lit("page"), "page_id").alias("name"))
    return outline.html_chunks(pages, "page_id", "h", "name")


_REPLY = "CASE p_partkey % 4 WHEN 0 THEN concat('```json\n{\"a\": ', p_size, '}\n```') WHEN 1 THEN concat(' {\"a\": ', p_size, '} ') WHEN 2 THEN '``` plain ```' ELSE NULL END"


@query(rf"""WITH t AS (SELECT p_partkey, {_REPLY.replace(chr(10), "' || chr(10) || '")} AS raw, p_type, p_name, p_size FROM part)
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '^```[A-Za-z]*\s*', ''), '\s*```$', ''), '^\s+|\s+$', '', 'g') AS bare,
  lower(regexp_replace(translate(p_type || ' — ' || p_size || '－x', '–—－', '---'), '\s+', '', 'g')) AS header, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type || ' 5K'), '[a-z0-9]+'))), ',') AS tokens,
  CASE WHEN length(p_name) > 10 THEN regexp_replace(substr(p_name, 1, 10), '\s+$', '') || '...' ELSE p_name END AS short FROM t""")
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Texts without fences, headers for comparison, tokens, shortened names (STR-05, STR-19, STR-22, STR-23)."""
    rows = T.table(spark, d, "part").withColumn("raw", F.expr(_REPLY.replace("\n", "\\n")))
    header = X.header(F.concat("p_type", F.lit(" — "), "p_size", F.lit("－x")))
    return rows.select("p_partkey", X.unfenced(F.col("raw")).alias("bare"), header.alias("header"), F.array_join(F.sort_array(X.tokens(F.concat_ws(" ", "p_name", "p_type", F.lit("5K")))), ",").alias("tokens"), X.shortened(F.col("p_name"), 10).alias("short"))


_LIST = "CASE c_custkey % 5 WHEN 0 THEN concat('[\"', c_mktsegment, '\", \"', c_name, '\"]') WHEN 1 THEN concat(' ', c_name, ' ') WHEN 2 THEN '' WHEN 3 THEN '[]' END"


@query(f"""WITH t AS (SELECT c_custkey, {_LIST} AS raw, CASE c_custkey % 4 WHEN 0 THEN '1,' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN '-3' WHEN 2 THEN 'x' ELSE ' 12 ' END AS n FROM customer)
SELECT c_custkey, CASE WHEN raw IS NULL OR trim(raw) = '' THEN '' WHEN starts_with(trim(raw), '[') THEN array_to_string(from_json(raw, '["VARCHAR"]'), '|') ELSE trim(raw) END AS items,
  CASE WHEN TRY_CAST(regexp_replace(n, '[,\\s]', '', 'g') AS BIGINT) >= 0 THEN TRY_CAST(regexp_replace(n, '[,\\s]', '', 'g') AS BIGINT) END AS count, CAST(to_timestamp(c_custkey * 100000) AT TIME ZONE 'UTC' AS TIMESTAMP) AS at FROM t""")
def parsed_cells(spark: SparkSession, d: str) -> DataFrame:
    """Lists from JSON, counts from text, times from seconds (ARR-02, NUM-10, DT-05)."""
    k = F.col("c_custkey")
    n = F.when(k % 4 == 0, F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"))).when(k % 4 == 1, "-3").when(k % 4 == 2, "x").otherwise(" 12 ")
    items = F.coalesce(F.array_join(X.json_list(F.expr(_LIST)), "|"), F.lit(""))
    return T.table(spark, d, "customer").select(k, items.alias("items"), N.count_or_null(n).alias("count"), X.epoch_time(k * 100_000).alias("at"))


@query("""WITH r AS (SELECT p_brand AS shop, CASE p_partkey % 9 WHEN 0 THEN 'GEN' WHEN 1 THEN 'A-level' WHEN 2 THEN 'SS-level' ELSE p_type END AS tier, CASE WHEN p_size % 4 = 0 THEN 'GEN' ELSE 'step' || (p_size % 4) END AS progress, CASE WHEN p_partkey % 7 = 0 THEN 'GEN' ELSE p_name END AS intent FROM part),
i AS (SELECT shop, tier, progress, string_agg(DISTINCT CASE WHEN intent = 'GEN' THEN ' ' ELSE intent END, '|' ORDER BY CASE WHEN intent = 'GEN' THEN ' ' ELSE intent END) AS intents FROM r GROUP BY 1, 2, 3)
SELECT shop, tier, string_agg(progress || ':' || replace(intents, ' |', 'GEN|'), ';' ORDER BY CASE WHEN progress = 'GEN' THEN ' ' ELSE progress END) AS tree, CAST(CASE WHEN tier = 'GEN' THEN 0 WHEN tier = 'A-level' THEN 1 WHEN tier = 'SS-level' THEN 5 ELSE 6 END AS INTEGER) AS rank FROM (SELECT shop, tier, progress, CASE WHEN intents = ' ' THEN 'GEN' WHEN starts_with(intents, ' |') THEN 'GEN' || substr(intents, 2) ELSE intents END AS intents FROM i) GROUP BY shop, tier""")
def hierarchy_tree(spark: SparkSession, d: str) -> DataFrame:
    """Shop, tier, progress and intents as a tree, wildcards first (AGG-09, KB-17, SRT-07, SNK-08)."""
    from ..functions.values import tier_rank

    k = F.col("p_partkey")
    tier = F.when(k % 9 == 0, "GEN").when(k % 9 == 1, "A-level").when(k % 9 == 2, "SS-level").otherwise(F.col("p_type"))
    progress = F.when(F.col("p_size") % 4 == 0, "GEN").otherwise(F.concat(F.lit("step"), F.col("p_size") % 4))
    rows = T.table(spark, d, "part").select(F.col("p_brand").alias("shop"), tier.alias("tier"), progress.alias("progress"), F.when(k % 7 == 0, "GEN").otherwise(F.col("p_name")).alias("intent"))
    first = lambda c: F.array_sort(F.collect_set(F.struct((F.col(c) != "GEN").alias("named"), F.col(c).alias("v"))))["v"]
    steps = rows.groupBy("shop", "tier", "progress").agg(F.array_join(first("intent"), "|").alias("intents"))
    branch = F.struct((F.col("progress") != "GEN").alias("named"), "progress", F.concat_ws(":", "progress", "intents").alias("t"))
    tree = steps.groupBy("shop", "tier").agg(F.array_join(F.array_sort(F.collect_list(branch))["t"], ";").alias("tree"))
    return tree.withColumn("rank", tier_rank(F.col("tier")))
