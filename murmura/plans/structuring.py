"""Structuring of knowledge records, build plans, and what replies take from records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import replies as R
from ..operators import intents as I
from ..operators import structuring as K
from ..sources import tables as T
from ..sources.requests import SQL, list_sql, requests, said_sql, text_sql
from .registry import query


@query("""WITH t AS (SELECT o_custkey, o_orderkey, 'r' || (o_orderkey // 3 % 3) AS record_id FROM orders)
SELECT o_custkey, o_orderkey, 'K-' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS id, record_id || CASE WHEN row_number() OVER (PARTITION BY o_custkey, record_id ORDER BY o_orderkey) = 1 THEN '' ELSE '-' || row_number() OVER (PARTITION BY o_custkey, record_id ORDER BY o_orderkey) END AS unique_id FROM t""")
def record_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Records numbered in their documents, repeated ids told apart (WIN-08)."""
    rows = T.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("r"), F.floor(F.col("o_orderkey") / 3) % 3).alias("record_id"))
    return K.numbered_ids(rows, "o_custkey", ["o_orderkey"], "K").drop("record_id")


_RAW = {
    "title": "CASE k % 4 WHEN 0 THEN ' ' WHEN 1 THEN b ELSE n END", "content": "CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE concat(' ', t) END", "entitle": "CASE k % 5 WHEN 0 THEN 'En' END", "encontent": "CASE k % 7 WHEN 0 THEN ' body ' END",
    "language": "CASE k % 2 WHEN 0 THEN 'zh' END", "applicable_shops": "CASE k % 6 WHEN 0 THEN 'gen' WHEN 1 THEN b END", "rule_type": "CASE k % 8 WHEN 0 THEN 'action' WHEN 4 THEN 'action' WHEN 1 THEN 'policy' END", "action": "CASE k % 16 WHEN 0 THEN 'join' WHEN 8 THEN ' ' WHEN 4 THEN 'mark' END",
    "intent": "CASE k % 32 WHEN 0 THEN 'ask' END",
}
_S = lambda c: rf"nullif(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '')"


@query("WITH raw AS (SELECT p_partkey AS k, p_brand AS b, p_name AS n, p_type AS t FROM part), f AS (SELECT k, " + ", ".join(f"{_S(v)} AS {c}" for c, v in _RAW.items()) + """ FROM raw),
g AS (SELECT *, coalesce(rule_type = 'action' AND action IS NOT NULL, false) AS acts FROM f), h AS (SELECT * REPLACE (coalesce(title, CASE WHEN acts THEN coalesce(intent, 'Action trigger') END) AS title) FROM g)
SELECT k, title, content, coalesce(entitle, title) AS entitle, coalesce(encontent, content) AS encontent, coalesce(language, 'en') AS language, CASE WHEN applicable_shops IS NULL OR upper(applicable_shops) = 'GEN' THEN 'shop' || (k % 9) ELSE applicable_shops END AS applicable_shops, rule_type, action
FROM h WHERE acts OR title IS NOT NULL OR content IS NOT NULL""")
def record_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    """Records in normal form (KB-04)."""
    raw = T.table(spark, d, "part").selectExpr("p_partkey AS k", "p_brand AS b", "p_name AS n", "p_type AS t").selectExpr("k", *[f"{v} AS {c}" for c, v in _RAW.items()])
    return K.normalised(raw, F.concat(F.lit("shop"), F.col("k") % 9)).drop("intent")


@query("""WITH layers AS (SELECT 'f' || (p_size % 5) AS field, CASE WHEN p_partkey % 4 = 0 THEN 'GEN' ELSE p_brand END AS shop, CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_type END AS value, CAST(p_partkey % 2 AS INTEGER) AS layer FROM part),
k AS (SELECT *, lower(trim(value)) AS k FROM layers WHERE trim(value) <> ''), o AS (SELECT *, row_number() OVER (PARTITION BY field, shop, k ORDER BY layer, value) AS p FROM k)
SELECT field, shop, trim(value) AS value, layer FROM o WHERE p = 1 AND (shop = 'GEN' OR NOT EXISTS (SELECT 1 FROM k g WHERE g.shop = 'GEN' AND g.field = o.field AND g.k = o.k))""")
def vocabulary_layers(spark: SparkSession, d: str) -> DataFrame:
    """Layers of a vocabulary merged, general values left out of shops (KB-08, SET-07)."""
    k = F.col("p_partkey")
    value = F.when(k % 3 == 0, F.upper("p_type")).when(k % 11 == 0, " ").otherwise(F.col("p_type"))
    return K.merged_layers(T.table(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_size") % 5).alias("field"), F.when(k % 4 == 0, "GEN").otherwise(F.col("p_brand")).alias("shop"), value.alias("value"), (k % 2).cast("int").alias("layer")))


@query("""WITH s AS (SELECT DISTINCT CASE WHEN p_partkey % 10 = 0 THEN 'GEN' ELSE p_brand END AS shop, CASE WHEN p_partkey % 10 = 0 THEN 'general_' || (p_size % 4) ELSE 'link_' || p_size END AS slot FROM part),
e AS (SELECT shop, slot FROM s WHERE shop <> 'GEN' UNION SELECT a.shop, b.slot FROM (SELECT DISTINCT shop FROM s WHERE shop <> 'GEN') a, s b WHERE b.shop = 'GEN') SELECT shop, string_agg(slot, ',' ORDER BY slot) AS slots FROM e GROUP BY 1""")
def shop_slots(spark: SparkSession, d: str) -> DataFrame:
    """Slots of each shop (KB-12)."""
    general = F.col("p_partkey") % 10 == 0
    rows = T.table(spark, d, "part").select(F.when(general, "GEN").otherwise(F.col("p_brand")).alias("shop"), F.when(general, F.concat(F.lit("general_"), F.col("p_size") % 4)).otherwise(F.concat(F.lit("link_"), "p_size")).alias("slot")).distinct()
    return K.slots_of_shops(rows).select("shop", F.array_join("slots", ",").alias("slots"))


SECTIONS = [("invite", 2, "Join the group"), ("affiliate", 2, "Use the link"), ("video", 3, "Post a video"), ("table", 16, "See the table")]
_NEW = """new AS (SELECT s_suppkey AS shop, t.tier, x.section || '-' || t.tier || '-' || i.i AS id, x.title FROM supplier, (VALUES ('A'), ('B')) t(tier), (VALUES """ + ", ".join(f"('{a}', {n}, '{t}')" for a, n, t in SECTIONS) + ") x(section, n, title), range(1, 17) i(i) WHERE i.i <= x.n)"


@query("WITH " + _NEW + """, old AS (SELECT s_suppkey AS shop, 'A' AS tier, unnest(['invite-A-9', 'manual-1', 'table-x']) AS id, s_name AS title FROM supplier)
SELECT * FROM old WHERE NOT (starts_with(id, 'invite-') OR starts_with(id, 'table-')) UNION ALL SELECT * FROM new""")
def supplement_records(spark: SparkSession, d: str) -> DataFrame:
    """Supplements made for each tier, in place of those made before (KB-06, KB-07, SET-11, UDF-01)."""
    suppliers = T.table(spark, d, "supplier")
    tiers = suppliers.select(F.col("s_suppkey").alias("shop"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("tier"))
    old = suppliers.select(F.col("s_suppkey").alias("shop"), F.lit("A").alias("tier"), F.explode(F.array(*map(F.lit, ("invite-A-9", "manual-1", "table-x")))).alias("id"), F.col("s_name").alias("title"))
    return K.replaced_by_prefix(old, K.supplements(tiers, SECTIONS), ("invite-", "table-"))


@query("""WITH c AS (SELECT 'f' || l_partkey AS source_file, CASE l_returnflag WHEN 'R' THEN 'deleted' WHEN 'A' THEN 'added' ELSE 'modified' END AS operation, l_orderkey * 8 + l_linenumber AS place FROM lineitem),
o AS (SELECT 'f' || p_partkey AS supplement, 'book' || (p_partkey % 50) AS playbook FROM part WHERE p_size < 20),
m AS (SELECT coalesce(playbook, source_file) AS target, CASE WHEN operation = 'deleted' AND playbook IS NULL THEN 'delete' ELSE 'build' END AS operation, place FROM c LEFT JOIN o ON supplement = source_file)
SELECT target, arg_min(operation, place) AS operation, CAST(min(place) AS BIGINT) AS place FROM m GROUP BY 1""")
def build_plan(spark: SparkSession, d: str) -> DataFrame:
    """What changed files ask to be built (KB-18, KB-19, JOIN-13)."""
    op = F.when(F.col("l_returnflag") == "R", "deleted").when(F.col("l_returnflag") == "A", "added").otherwise("modified")
    changes = T.table(spark, d, "lineitem").select(F.concat(F.lit("f"), "l_partkey").alias("source_file"), op.alias("operation"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"))
    owners = T.table(spark, d, "part").where("p_size < 20").select(F.concat(F.lit("f"), "p_partkey").alias("supplement"), F.concat(F.lit("book"), F.col("p_partkey") % 50).alias("playbook"))
    return K.build_plan(changes, owners)


_URLS = r"list_distinct(list_transform(regexp_extract_all({}, 'https?://[^\s<>\"'')\]]+'), lambda u: regexp_replace(u, '[.,;:!?]+$', '')))"


@query(rf"""WITH t AS (SELECT p_partkey, [CASE WHEN p_partkey % 3 = 0 THEN 'go to https://a.example/' || p_size || '.' WHEN p_partkey % 3 = 1 THEN ' ' ELSE p_brand END, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END] AS v,
  CASE WHEN p_partkey % 4 <> 0 THEN 'see https://b.example/x, or https://a.example/' || p_size END AS s, p_partkey % 5 <> 0 AS ki FROM part),
u AS (SELECT *, {_URLS.format("coalesce(s, '')")} AS su, {_URLS.format("v[1]")} AS vu FROM t),
w AS (SELECT *, list_filter([trim(v[1]), trim(v[2])], lambda x: x <> '') AS own FROM u)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(vu, su))), ' ') AS allowed, CASE WHEN NOT ki THEN '' WHEN len(own) > 0 THEN array_to_string(list_sort(list_distinct(own)), '|') ELSE array_to_string(list_sort(su), '|') END AS required FROM w""")
def reply_values(spark: SparkSession, d: str) -> DataFrame:
    """Links that replies may hold, and values that they must (RPL-10, KB-14)."""
    k = F.col("p_partkey")
    link = F.concat(F.lit("https://a.example/"), "p_size")
    values = F.array(F.when(k % 3 == 0, F.concat(F.lit("go to "), link, F.lit("."))).when(k % 3 == 1, " ").otherwise(F.col("p_brand")), F.when(k % 2 == 0, F.col("p_brand")).otherwise(""))
    script = F.when(k % 4 != 0, F.concat(F.lit("see https://b.example/x, or "), link))
    allowed, required = K.authorised_urls(values, script), K.required_values(values, script, k % 5 != 0)
    return T.table(spark, d, "part").select("p_partkey", F.array_join(F.sort_array(allowed), " ").alias("allowed"), F.array_join(F.sort_array(required), "|").alias("required"))


@query(r"""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ' Use ${link} with {code}. ' END AS en, 'own {code} ' || p_name || ' {other}' AS b FROM part)
SELECT p_partkey, replace(replace(regexp_replace(coalesce(nullif(trim(en), ''), trim(b)), '\$\{', '{', 'g'), '{link}', 'https://a.example/' || p_partkey), '{code}', 'C' || p_partkey) AS script FROM t""")
def prepared_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Scripts with their slots filled (RPL-05, STR-15)."""
    k = F.col("p_partkey")
    slots = F.create_map(F.lit("link"), F.concat(F.lit("https://a.example/"), k), F.lit("code"), F.concat(F.lit("C"), k))
    body = F.concat(F.lit("own {code} "), "p_name", F.lit(" {other}"))
    return T.table(spark, d, "part").select("p_partkey", K.prepared_script(F.when(k % 2 == 0, " Use ${link} with {code}. "), body, slots).alias("script"))


@query("""WITH r AS (SELECT p_brand AS shop, p_partkey AS id, p_type AS rule_type, CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_name END AS body FROM part), k AS (SELECT * FROM r WHERE rule_type LIKE 'STANDARD%' AND trim(body) <> '')
SELECT shop, 'Policies of ' || shop || chr(10) || string_agg('[' || id || '] ' || body, chr(10) ORDER BY CAST(id AS VARCHAR)) AS text, count(*) AS n FROM k GROUP BY shop""")
def policy_texts(spark: SparkSession, d: str) -> DataFrame:
    """Policies of each shop as a text, by id (FLT-08, RPL-06, RPL-18)."""
    rows = T.table(spark, d, "part").where(F.startswith("p_type", F.lit("STANDARD")) & (F.col("p_size") % 5 != 0) & (F.trim("p_name") != ""))
    line = F.concat(F.lit("["), "p_partkey", F.lit("] "), "p_name")
    lines = F.array_sort(F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("id"), line.alias("line"))))["line"]
    text = F.concat(F.lit("Policies of "), "p_brand", F.lit("\n"), F.array_join(lines, "\n"))
    return rows.groupBy("p_brand").agg(lines.alias("l"), F.count("*").alias("n")).select(F.col("p_brand").alias("shop"), F.concat(F.lit("Policies of "), "p_brand", F.lit("\n"), F.array_join("l", "\n")).alias("text"), "n")


#: Intents with whole replies and words, and their priorities.
EXACT = [("agree", "ok", 3), ("agree", "interested", 3), ("agree", "yes", 3), ("stop", "STOP", 5), ("other", "ok", 1)]
WORDS = [("price", "rate", 2), ("price", "quote", 2), ("price", "感兴趣", 2), ("group", "whatsapp", 1), ("group", "group", 1), ("group", "joined", 1), ("sample", "sample", 2), ("video", "video", 0)]
_VALUES = lambda rows: ", ".join(f"({text_sql(a)}, {text_sql(b)}, {c})" for a, b, c in rows)


@query(f"""WITH {SQL}, exact(intent, reply, priority) AS (VALUES {_VALUES(EXACT)}), words(intent, w, priority) AS (VALUES {_VALUES(WORDS)}), texts AS (SELECT DISTINCT t FROM said WHERE t <> ''),
e AS (SELECT t, arg_min(intent, [lpad(CAST(100 - priority AS VARCHAR), 4, '0'), intent]) AS intent FROM texts JOIN exact ON lower(reply) = lower(t) GROUP BY t),
s AS (SELECT t, intent, max(priority) AS priority, sum(CASE WHEN NOT contains(lower(t), w) THEN 0 WHEN regexp_matches(w, '[^\\x00-\\x7F]') OR length(w) > 4 THEN 2 ELSE 1 END) AS score FROM texts, words GROUP BY t, intent),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, priority DESC, intent) AS p FROM s WHERE score > 0)
SELECT request_id, CASE WHEN said.t = '' THEN 'GEN' WHEN e.intent IS NOT NULL THEN e.intent WHEN k.intent IS NOT NULL THEN k.intent WHEN regexp_matches(lower(said.t), '^(hi|hello|hey|thanks|thank you)\\b') THEN 'No obvious intention' ELSE 'GEN' END AS intent,
  CASE WHEN said.t = '' THEN 'low' WHEN e.intent IS NOT NULL OR k.score >= 3 THEN 'high' WHEN k.intent IS NOT NULL OR regexp_matches(lower(said.t), '^(hi|hello|hey|thanks|thank you)\\b') THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN said.t = '' THEN 'none' WHEN e.intent IS NOT NULL THEN 'exact' WHEN k.intent IS NOT NULL OR regexp_matches(lower(said.t), '^(hi|hello|hey|thanks|thank you)\\b') THEN 'keyword' ELSE 'none' END AS matched_by
FROM said LEFT JOIN e ON e.t = said.t LEFT JOIN k ON k.t = said.t AND k.p = 1""")
def intent_classify(spark: SparkSession, d: str) -> DataFrame:
    """The cascade of exact replies, keywords and greetings, in its mode without a model (INT-01, INT-02, INT-03, INT-13)."""
    rules = lambda rows, name: spark.createDataFrame(rows, f"intent string, {name} string, priority int")
    return I.classified(requests(spark, d).select("request_id", "message"), rules(EXACT, "reply"), rules(WORDS, "keyword"))




#: Intents that some requests allow only.
SCOPES, ALIKE = ((), ("price", "group"), ("agree", "No obvious intention"), ("CPM Rate", "sample"), ()), (("price", "sample"),)
_ALLOWED = lambda x: f"(len(allowed) = 0 OR list_contains(allowed, {x}) OR ({x} IN ('price', 'sample') AND list_has_any(allowed, ['price', 'sample'])))"


@query(f"""WITH {SQL}, exact(intent, reply, priority) AS (VALUES {_VALUES(EXACT)}), words(intent, w, priority) AS (VALUES {_VALUES(WORDS)}),
asked AS (SELECT request_id, t, lower(t) AS low, [{", ".join(map(list_sql, SCOPES))}][CAST(request_id // 3 % {len(SCOPES)} + 1 AS INTEGER)] AS allowed, coalesce(shop = 'north' AND tier = 'A-level' AND t <> ''
  AND {said_sql("t", R.TOO_LOW)} AND {said_sql("offer", R.OFFERED_COMMISSION)}, false) AS refused FROM said),
e AS (SELECT lower(reply) AS low, arg_min(intent, [lpad(CAST(100 - priority AS VARCHAR), 4, '0'), intent]) AS exact FROM exact GROUP BY 1),
s AS (SELECT low, intent, max(priority) AS priority, sum(CASE WHEN NOT contains(low, w) THEN 0 WHEN regexp_matches(w, '[^\\x00-\\x7F]') OR length(w) > 4 THEN 2 ELSE 1 END) AS score FROM (SELECT DISTINCT low FROM asked WHERE low <> ''), words GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY low ORDER BY score DESC, priority DESC, intent) AS place, max(score) OVER (PARTITION BY low) AS most FROM s WHERE score > 0),
base AS (
  SELECT request_id, intent, least(0.92, 0.45 + CAST(score AS DOUBLE) / most * 0.45) AS confidence, 'keyword' AS matched_by, place FROM asked JOIN p USING (low) WHERE place <= 8
  UNION ALL SELECT request_id, coalesce(exact, 'No obvious intention'), CASE WHEN exact IS NULL THEN 0.65 ELSE 0.9 END, CASE WHEN exact IS NULL THEN 'keyword' ELSE 'exact' END, 1 FROM asked LEFT JOIN e USING (low) WHERE low NOT IN (SELECT low FROM p) AND (exact IS NOT NULL OR regexp_matches(low, '^(hi|hello|hey|thanks|thank you)\\b'))
  UNION ALL SELECT request_id, 'CPM Rate', 0.92, 'refined', 0 FROM asked WHERE refused
), alone AS (SELECT request_id, exact AS intent, 0.9 AS confidence, 'exact' AS matched_by, 1 AS place FROM asked JOIN e USING (low) WHERE {_ALLOWED("exact")}),
kept AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY confidence DESC, place) AS rank FROM (SELECT * FROM alone UNION ALL SELECT b.* FROM base b JOIN asked a USING (request_id) WHERE b.request_id NOT IN (SELECT request_id FROM alone) AND low <> '' AND confidence >= 0.5 AND {_ALLOWED("b.intent")})),
tops AS (SELECT request_id, string_agg(intent || ' ' || printf('%.4f', confidence) || ' ' || matched_by, '; ' ORDER BY rank) AS intents, arg_min(intent, rank) AS top, max(confidence) AS best FROM kept WHERE rank <= 3 GROUP BY request_id)
SELECT a.request_id, coalesce(intents, '') AS intents, coalesce(top, 'GEN') AS intent, CASE WHEN best >= 0.75 THEN 'high' WHEN best >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM asked a LEFT JOIN tops t USING (request_id)""")
def intent_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The best three intents of each message within its scope, and the first of them (INT-07, INT-08, INT-13, INT-14)."""
    rules = lambda rows, name: spark.createDataFrame(rows, f"intent string, {name} string, priority int")
    k = F.floor(F.col("request_id") / 3) % len(SCOPES) + 1
    allowed = F.element_at(F.array(*[F.array(*map(F.lit, s)).cast("array<string>") for s in SCOPES]), k.cast("int"))
    refuses = (F.col("shop") == "north") & (F.col("tier") == "A-level") & R.rejects_price(F.col("message"), F.col("offer"))
    rows = requests(spark, d).select(F.col("request_id").alias("message_id"), "message", allowed.alias("allowed"), refuses.alias("refuses_price"))
    found = I.ranking(rows, rules(EXACT, "reply"), rules(WORDS, "keyword"), ALIKE).withColumn("first", I.single(F.col("intents")))
    shown = F.array_join(F.transform("intents", lambda c: F.concat_ws(" ", c["intent"], F.format_number(c["confidence"], 4), c["matched_by"])), "; ")
    return found.select(F.col("message_id").alias("request_id"), shown.alias("intents"), "first.intent", "first.confidence")
