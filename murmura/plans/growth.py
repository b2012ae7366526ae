"""Chains of negotiations, records made along them, and vocabularies that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chains as C
from ..operators import labels as L
from ..operators import vocabulary as V
from ..sources import dispatch, sinks
from ..sources import tables as T
from ..sources.requests import list_sql, text_sql
from .registry import query

_NODES = "nodes AS (SELECT DISTINCT p_brand AS shop, p_size AS node, CASE WHEN p_size % 7 = 6 THEN NULL WHEN p_size > 40 THEN p_size - 10 ELSE p_size + 3 END AS next FROM part)"
_PATHS = f"""{_NODES}, before AS (SELECT n.shop, n.next AS node, min(n.node) AS previous FROM nodes n WHERE n.next IS NOT NULL AND n.next <> n.node GROUP BY 1, 2),
linked AS (SELECT n.shop, n.node, b.previous FROM nodes n LEFT JOIN before b ON b.shop = n.shop AND b.node = n.node),
paths(shop, entry, node, place, previous) AS (SELECT shop, node, node, CAST(1 AS BIGINT), previous FROM linked WHERE previous IS NULL UNION ALL SELECT p.shop, p.entry, l.node, p.place + 1, l.previous FROM paths p JOIN linked l ON l.shop = p.shop AND l.previous = p.node)"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return T.table(spark, d, "part").select(F.col("p_brand").alias("shop"), size.alias("node"), F.when(size % 7 == 6, None).when(size > 40, size - 10).otherwise(size + 3).alias("next"))


@query(f"WITH RECURSIVE {_PATHS} SELECT shop, entry, node, place, previous, (shop, node) NOT IN (SELECT (shop, previous) FROM paths WHERE previous IS NOT NULL) AS is_end FROM paths")
def negotiation_chains(spark: SparkSession, d: str) -> DataFrame:
    """Paths of nodes from their entries, by shop (KB-06, RUL-15)."""
    return C.chains(_nodes(spark, d))


@query(f"""WITH RECURSIVE {_PATHS}, firsts AS (SELECT shop, min(entry) AS entry FROM paths WHERE shop LIKE '%1' OR shop = 'Brand#22' GROUP BY shop),
chosen AS (SELECT CASE WHEN p.shop = 'Brand#22' THEN 'GEN' ELSE p.shop END AS shop, p.node, p.place, p.previous FROM paths p JOIN firsts USING (shop, entry))
SELECT c_custkey, 'Brand#' || (c_custkey % 45 + 10) AS shop, CAST(c_custkey % 7 AS BIGINT) AS round, n.node, n.previous FROM customer LEFT JOIN chosen n
ON n.shop = CASE WHEN 'Brand#' || (c_custkey % 45 + 10) IN (SELECT shop FROM chosen) THEN 'Brand#' || (c_custkey % 45 + 10) ELSE 'GEN' END AND n.place = c_custkey % 7""")
def chain_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The node of a round in the chain of the shop, else in the default one (RUL-20)."""
    paths = C.chains(_nodes(spark, d).where("shop like '%1' or shop = 'Brand#22'"))
    firsts = paths.groupBy("shop").agg(F.min("entry").alias("entry"))
    chosen = paths.join(firsts, ["shop", "entry"]).withColumn("shop", F.when(F.col("shop") == "Brand#22", "GEN").otherwise(F.col("shop")))
    k = F.col("c_custkey")
    asked = T.table(spark, d, "customer").select(k, F.concat(F.lit("Brand#"), k % 45 + 10).alias("shop"), (k % 7).cast("long").alias("round"))
    return C.node_of(asked, chosen)


TEMPLATES = [
    C.Template("A1-Outreach", ("A1-Pure", "A1-"), {"intent": "Pure Commission", "note": "opening"}, ("priority_node:A1",)),
    C.Template("A1-Accept", ("A1-Pure", "A1-"), {"intent": "Pure Commission", "title": "OK"}, ("priority_node:A1", "reply_ok"), keep_flags=False),
    C.Template("A2-Offer", ("A2-CPM", "A2-"), {"intent": "CPM Rate"}, ("priority_node:A2", "prev_node:A1")),
    C.Template("A3-Shortcut", ("none",), {"intent": "Flat Fee", "title": "Fixed price only"}, ("priority_node:A3", "prev_node:A1")),
]
_IDS = ("A1-Pure-x", "A2-CPM", "A2-old", "B-Interest", "C-AI")
_RECORDS = f"""records AS (SELECT p_brand AS shop, {list_sql(_IDS)}[CAST(p_partkey % 5 + 1 AS INTEGER)] || '-' || p_partkey AS id, p_partkey AS place, CASE p_partkey % 3 WHEN 0 THEN ['gmv_high', 'vip'] WHEN 1 THEN ['priority_node:A1'] ELSE CAST([] AS VARCHAR[]) END AS flags,
  p_name AS title, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS intent, CAST(NULL AS VARCHAR) AS note FROM part)"""
_TEMPLATES_SQL = ", ".join(f"({n}, {text_sql(t.id)}, {list_sql(t.bases)}, {list_sql(t.flags)}, {t.keep_flags}, {text_sql(t.sets['title']) if 'title' in t.sets else 'NULL'}, {text_sql(t.sets['intent'])}, {text_sql(t.sets['note']) if 'note' in t.sets else 'NULL'})" for n, t in enumerate(TEMPLATES))


@query(f"""WITH {_RECORDS}, templates(n, id, bases, more, keeps, title, intent, note) AS (VALUES {_TEMPLATES_SQL}), shops AS (SELECT DISTINCT shop FROM records),
listed AS (SELECT r.shop, t.n, row_number() OVER (PARTITION BY r.shop, t.n ORDER BY list_position(list_transform(bases, lambda b: starts_with(r.id, b)), true), r.place) AS p, r.flags, r.title, r.intent, r.note FROM records r JOIN templates t ON len(list_filter(bases, lambda b: starts_with(r.id, b))) > 0),
made AS (SELECT s.shop, t.id, CAST(t.n AS BIGINT) AS place, list_concat(CASE WHEN keeps AND l.flags IS NOT NULL THEN l.flags ELSE CAST([] AS VARCHAR[]) END, list_filter(more, lambda m: NOT (keeps AND list_contains(coalesce(l.flags, []), m)))) AS flags, coalesce(t.title, l.title) AS title, coalesce(t.intent, l.intent) AS intent, coalesce(t.note, l.note) AS note
  FROM shops s CROSS JOIN templates t LEFT JOIN listed l ON l.shop = s.shop AND l.n = t.n AND l.p = 1),
every AS (SELECT * FROM made UNION ALL SELECT shop, id, place + 4, flags, title, intent, note FROM records WHERE NOT (starts_with(id, 'A1-') OR starts_with(id, 'A2-')))
SELECT shop, id, place, array_to_string(list_filter(flags, lambda f: NOT starts_with(f, 'gmv_')), ',') AS flags, title, intent, note FROM every""")
def chain_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of a chain made from what a shop has, in place of its old ones; flags of sales stripped (KB-06)."""
    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, _IDS)), (k % 5 + 1).cast("int"))
    flags = F.when(k % 3 == 0, F.array(F.lit("gmv_high"), F.lit("vip"))).when(k % 3 == 1, F.array(F.lit("priority_node:A1"))).otherwise(F.array().cast("array<string>"))
    records = T.table(spark, d, "part").select(F.col("p_brand").alias("shop"), F.concat(name, F.lit("-"), k).alias("id"), k.alias("place"), flags.alias("flags"), F.col("p_name").alias("title"), F.when(k % 4 != 0, F.col("p_type")).alias("intent"), F.lit(None).cast("string").alias("note"))
    made = C.synthesised(records, TEMPLATES, ("A1-", "A2-"), ("gmv_",))
    return made.select("shop", "id", "place", F.array_join("flags", ",").alias("flags"), "title", "intent", "note")


_OLD_VALUE, _NEW_VALUE = "CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE concat(' ', p_type) END", "CASE p_partkey % 5 WHEN 0 THEN lower(p_brand) WHEN 1 THEN ' ' WHEN 2 THEN upper(p_name) ELSE concat(p_name, ' ') END"
_OLD_ALIAS, _NEW_ALIAS = "concat('x', p_size)", "CASE p_partkey % 4 WHEN 0 THEN upper(p_brand) WHEN 1 THEN concat('X', p_size) WHEN 2 THEN NULL ELSE concat('y', p_partkey % 90) END"
_FIELD = "CASE WHEN p_partkey % 11 = 10 AND p_partkey % 3 = 2 THEN 'other' ELSE concat('f', p_partkey % 3) END"
_MERGED = f"""every AS (
  SELECT field, 'value' AS kind, CAST(NULL AS VARCHAR) AS canon, trim(v) AS item, true AS old FROM (SELECT 'f' || p_partkey % 3 AS field, {_OLD_VALUE} AS v FROM part WHERE p_size < 25) UNION ALL SELECT 'f' || p_partkey % 3, 'alias', p_brand, {_OLD_ALIAS}, true FROM part WHERE p_size < 25
  UNION ALL SELECT {_FIELD}, 'value', NULL, trim({_NEW_VALUE}), false FROM part UNION ALL SELECT {_FIELD}, 'alias', p_brand, trim({_NEW_ALIAS}), false FROM part),
grouped AS (SELECT field, kind, lower(coalesce(canon, '')) AS lc, lower(coalesce(item, '')) AS li, min(CASE WHEN old THEN item END) AS there, min(CASE WHEN NOT old THEN item END) AS new, count(*) FILTER (WHERE NOT old) AS asked, min(canon) AS canon FROM every GROUP BY 1, 2, 3, 4),
decided AS (SELECT *, CASE WHEN there IS NOT NULL THEN CASE WHEN asked > 0 THEN 'known' END WHEN li = '' THEN 'blank' WHEN field NOT IN (SELECT field FROM grouped WHERE there IS NOT NULL) THEN 'unknown_field' WHEN kind = 'alias' AND li = lc THEN 'same_as_canon' END AS reason FROM grouped)"""


def _vocabulary(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part, old = T.table(spark, d, "part"), T.table(spark, d, "part").where("p_size < 25")
    known, field = F.expr("concat('f', p_partkey % 3)").alias("field"), F.expr(_FIELD).alias("field")
    return V.merged(
        old.select(known, F.expr(_OLD_VALUE).alias("value")), old.select(known, F.col("p_brand").alias("canon"), F.expr(_OLD_ALIAS).alias("alias")),
        part.select(field, F.expr(_NEW_VALUE).alias("value")), part.select(field, F.col("p_brand").alias("canon"), F.expr(_NEW_ALIAS).alias("alias")),
    )


@query(f"WITH {_MERGED} SELECT field, kind, canon, coalesce(there, new) AS item FROM decided WHERE there IS NOT NULL OR reason IS NULL")
def vocabulary_sync(spark: SparkSession, d: str) -> DataFrame:
    """A vocabulary with new values and aliases (SET-12, KB-09, KB-02)."""
    return _vocabulary(spark, d)[0]


@query(f"WITH {_MERGED} SELECT field, kind, canon, coalesce(new, there) AS item, CASE WHEN reason IS NULL THEN 'inserted' ELSE 'rejected' END AS action, reason FROM decided WHERE there IS NULL OR reason IS NOT NULL")
def vocabulary_changes(spark: SparkSession, d: str) -> DataFrame:
    """What a vocabulary took in and what it refused, and why (SET-12, KB-09)."""
    return _vocabulary(spark, d)[1]


@query("""WITH RECURSIVE edges AS (SELECT DISTINCT 'f' || p_partkey % 3 AS field, lower(p_brand) AS a, 'x' || p_size AS b FROM part WHERE p_size % 10 = p_partkey % 9), pairs AS (SELECT * FROM edges UNION SELECT field, b, a FROM edges),
reach AS (SELECT DISTINCT field, a AS name, a AS other FROM pairs UNION SELECT r.field, r.name, e.b FROM reach r JOIN pairs e ON e.field = r.field AND e.a = r.other) SELECT field, name, min(other) AS head FROM reach GROUP BY field, name""")
def alias_classes(spark: SparkSession, d: str) -> DataFrame:
    """Names that chains of aliases connect, under the least (KB-11, JOIN-17)."""
    rows = T.table(spark, d, "part").where("p_size % 10 = p_partkey % 9")
    return V.classes(rows.select(F.expr("concat('f', p_partkey % 3)").alias("field"), F.col("p_brand").alias("canon"), F.concat(F.lit("X"), "p_size").alias("alias")))


@query("""WITH t AS (SELECT DISTINCT p_brand AS shop, 'T' || p_size % 4 AS tier, 'step' || p_size % 3 AS progress, p_type AS intent FROM part),
i AS (SELECT shop, tier, progress, '"' || progress || '":["' || string_agg(intent, '","' ORDER BY intent) || '"]' AS j FROM t GROUP BY shop, tier, progress), s AS (SELECT shop, tier, '"' || tier || '":{' || string_agg(j, ',' ORDER BY progress) || '}' AS j FROM i GROUP BY shop, tier)
SELECT shop, '{' || string_agg(j, ',' ORDER BY tier) || '}' AS value FROM s GROUP BY shop""")
def hierarchy_documents(spark: SparkSession, d: str) -> DataFrame:
    """The hierarchy of each shop as nested JSON (SNK-08)."""
    rows = T.table(spark, d, "part").select(F.col("p_brand").alias("shop"), F.concat(F.lit("T"), F.col("p_size") % 4).alias("tier"), F.concat(F.lit("step"), F.col("p_size") % 3).alias("progress"), F.col("p_type").alias("intent"))
    return sinks.hierarchy_json(rows)


_SLOT_LISTS = (("wa_group_1k", "other_slot"), (), ("affiliate_link_x", "commission_rate_gmv"), ("whatsapp_form_a", "wa_group_1k"), (" ",))
_INFORMATION = ((), ("WA Group",), ("commission rate", "Affiliate_Link", "nothing"), (), (" ", "WA group", "form"))
_RECORD_TEXT = "CASE p_partkey % 4 WHEN 0 THEN 'see {ai_ugc_portal} and {wa_group_2}' WHEN 1 THEN NULL WHEN 2 THEN '{commission_rate_gmv} {commission_rate_gmv}' ELSE p_name END"
_VALUED = ("wa_group_1k", "wa_group_2", "affiliate_link_x", "commission_rate_gmv", "whatsapp_form_a", "ai_ugc_portal")


@query(f"""WITH prefixes(prefix, tag) AS (VALUES {", ".join(f"('{p}', '{t}')" for p, t in (("wa_group_", "whatsapp_group"), ("whatsapp_form_", "whatsapp_form"), ("affiliate_link_", "affiliate_link"), ("commission_rate_", "commission_rate"), ("ai_ugc_", "ai_ugc_portal"), ("wa_", "wa_other")))}),
r AS (SELECT p_partkey AS record_id, p_brand AS shop, list_filter({"[" + ", ".join(map(list_sql, _SLOT_LISTS)) + "]"}[CAST(p_partkey % 5 + 1 AS INTEGER)], lambda s: trim(s) <> '') AS named, {_RECORD_TEXT} AS content,
  list_filter({"[" + ", ".join(map(list_sql, _INFORMATION)) + "]"}[CAST(p_partkey // 3 % 5 + 1 AS INTEGER)], lambda s: trim(s) <> '') AS own FROM part),
s AS (SELECT *, list_concat(named, list_filter(regexp_extract_all(coalesce(content, ''), '\\{{([a-zA-Z0-9_]+)\\}}', 1), lambda x: NOT list_contains(named, x))) AS slots FROM r),
valued AS (SELECT DISTINCT p_brand AS shop, {list_sql(_VALUED)}[CAST(p_size % {len(_VALUED)} + 1 AS INTEGER)] AS slot FROM part WHERE p_size % 9 <> 0), words AS (SELECT DISTINCT p_brand AS shop, CASE p_size % 3 WHEN 0 THEN 'whatsapp_group' WHEN 1 THEN 'commission_rate' ELSE 'ai_ugc_portal' END AS tag FROM part WHERE p_brand LIKE '%1'),
rows AS (SELECT record_id, s.shop, i, slots[i] AS slot FROM s, unnest(range(1, len(slots) + 1)) u(i)),
tagged AS (SELECT record_id, r.shop, i, (SELECT tag FROM prefixes p WHERE starts_with(r.slot, p.prefix) ORDER BY length(p.prefix) DESC LIMIT 1) AS tag FROM rows r JOIN valued v ON v.shop = r.shop AND v.slot = r.slot),
backed AS (SELECT record_id, t.shop, t.tag, min(i) AS i FROM tagged t WHERE t.tag IS NOT NULL AND (t.shop NOT IN (SELECT shop FROM words) OR EXISTS (SELECT 1 FROM words w WHERE w.shop = t.shop AND w.tag = t.tag)) GROUP BY 1, 2, 3),
items AS (SELECT record_id, shop, u.i, lower(trim(own[u.i])) AS low FROM s, unnest(range(1, len(own) + 1)) u(i)),
given AS (SELECT x.record_id, b.tag, x.i FROM items x JOIN backed b ON b.record_id = x.record_id AND (x.low = b.tag OR (b.tag = 'whatsapp_group' AND x.low IN ('wa group', 'group')) OR (b.tag = 'commission_rate' AND x.low = 'commission rate'))),
chosen AS (SELECT * FROM given UNION ALL SELECT record_id, tag, i FROM backed WHERE record_id IN (SELECT record_id FROM s WHERE len(own) = 0)),
shown AS (SELECT record_id, CASE tag WHEN 'whatsapp_group' THEN 'WA group' ELSE replace(tag, '_', ' ') END AS label, min(i) AS i FROM chosen GROUP BY 1, 2)
SELECT record_id, string_agg(label, '|' ORDER BY i) AS labels FROM shown GROUP BY record_id""")
def key_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of key information of records, from their slots, what shops have values for, and words for it (KB-13, KB-14)."""
    k, part = F.col("p_partkey"), T.table(spark, d, "part")
    lists = lambda items, n: F.element_at(F.array(*[F.array(*map(F.lit, i)).cast("array<string>") for i in items]), (n % len(items) + 1).cast("int"))
    records = part.select(k.alias("record_id"), F.col("p_brand").alias("shop"), lists(_SLOT_LISTS, k).alias("slots"), F.expr(_RECORD_TEXT).alias("content"), F.lit(None).cast("string").alias("encontent"), lists(_INFORMATION, F.floor(k / 3)).alias("information"))
    valued = part.where("p_size % 9 <> 0").select(F.col("p_brand").alias("shop"), F.element_at(F.array(*map(F.lit, _VALUED)), F.col("p_size") % len(_VALUED) + 1).alias("slot"), F.lit("v").alias("value"))
    words = part.where("p_brand like '%1'").select(F.col("p_brand").alias("shop"), F.expr("CASE p_size % 3 WHEN 0 THEN 'whatsapp_group' WHEN 1 THEN 'commission_rate' ELSE 'ai_ugc_portal' END").alias("tag")).distinct()
    spelt = spark.createDataFrame([("whatsapp_group", 0, "WA group"), ("whatsapp_group", 1, "group"), ("commission_rate", 0, "commission rate")], "tag string, place int, alias string")
    aliases = part.select(F.col("p_brand").alias("shop")).distinct().join(spelt)
    prefixes = L.fixed_prefixes(part).union(spark.createDataFrame([("wa_", "wa_other")], "prefix string, tag string"))
    return L.labels(records, valued, words, aliases, prefixes).select("record_id", F.array_join("labels", "|").alias("labels"))


_FILE = "concat('page', page_id, CASE page_id % 4 WHEN 0 THEN '.html' WHEN 1 THEN '.TXT' WHEN 2 THEN '.json' ELSE '.docx' END)"
_FILE_TEXT = """CASE page_id % 4 WHEN 0 THEN concat('<h1>Section ', page_id, '</h1><h2>Intent</h2><p>', repeat('body ', 40), page_id, '</p><h3>Case</h3>', repeat('more ', 20))
  WHEN 1 THEN concat('Notes{n}1. first of ', page_id, '{n}  2. second', '{n}3. ', repeat('long ', 20)) WHEN 2 THEN concat('{{"records": [{{"title": "t', page_id, '", "content": "c"}}, {{"title": "u", "intent_category": "i"}}]}}') ELSE 'none' END"""


@query(f"""WITH f AS (SELECT page_id, {_FILE} AS source_file, page_id % 4 AS kind FROM pages)
SELECT source_file, seq, intent_category, title, content FROM (
  SELECT source_file, 1 AS seq, 'Intent' AS intent_category, 'Intent' AS title, trim(repeat('body ', 40) || page_id) AS content FROM f WHERE kind = 0 UNION ALL SELECT source_file, 2, 'Intent', 'Case', trim(repeat('more ', 20)) FROM f WHERE kind = 0
  UNION ALL SELECT source_file, 1, 'GEN', 'first of ' || page_id, 'first of ' || page_id FROM f WHERE kind = 1 UNION ALL SELECT source_file, 2, 'GEN', 'second', 'second' FROM f WHERE kind = 1 UNION ALL SELECT source_file, 3, 'GEN', rtrim(substr(trim(repeat('long ', 20)), 1, 72)) || '...', trim(repeat('long ', 20)) FROM f WHERE kind = 1
  UNION ALL SELECT source_file, 1, NULL, 't' || page_id, 'c' FROM f WHERE kind = 2 UNION ALL SELECT source_file, 2, 'i', 'u', NULL FROM f WHERE kind = 2)""")
def dispatched_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Files of three kinds to their chunkers in one plan (CHK-07, SRC-13)."""
    found = T.table(spark, d, "pages").select(F.expr(_FILE).alias("source_file"), F.expr(_FILE_TEXT.format(n="\\n")).alias("text"))
    return dispatch.chunked(found)
