"""Queries on knowledge records, scopes, histories and negotiation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records as X
from ..operators import knowledge as K
from ..operators import reports as R
from ..operators import vectors as V
from ..sources import tables as T
from ..sources.tables import with_tables
from .matching import _NEAR, _asked
from .registry import query


@query("""WITH chunks AS (SELECT 'file_' || (p_partkey % 3) AS source_file, p_partkey AS id, p_name AS body FROM part),
embedded AS (SELECT 'file_' || (vec_id % 3) AS source_file, vec_id % 150 AS id, max(vec_id) AS position, arg_max(label, vec_id) AS label FROM embeddings GROUP BY 1, 2)
SELECT c.source_file, c.id, body, position, label FROM chunks c JOIN embedded e ON c.source_file = e.source_file AND c.id = e.id""")
def chunk_embedding_join(spark: SparkSession, d: str) -> DataFrame:
    chunks = T.table(spark, d, "part").select(F.concat(F.lit("file_"), F.col("p_partkey") % 3).alias("source_file"), F.col("p_partkey").alias("id"), F.col("p_name").alias("body"))
    rows = T.table(spark, d, "embeddings").select(F.concat(F.lit("file_"), F.col("vec_id") % 3).alias("source_file"), (F.col("vec_id") % 150).alias("id"), F.col("vec_id").alias("position"), "label")
    return K.joined_by_last(chunks, rows, ["source_file", "id"], "position")


@query("""WITH general AS (SELECT p_partkey % 60 AS id, 'general' AS origin, max(p_size) AS priority FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), shop AS (SELECT p_partkey % 60 AS id, 'shop' AS origin, max(p_size) + 100 AS priority FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
SELECT id, origin, priority, row_number() OVER (ORDER BY priority DESC, id) AS place FROM (SELECT * FROM shop UNION ALL SELECT * FROM general WHERE id NOT IN (SELECT id FROM shop))""")
def rule_layers(spark: SparkSession, d: str) -> DataFrame:
    part = T.table(spark, d, "part").select((F.col("p_partkey") % 60).alias("id"), "p_partkey", "p_size")
    layer = lambda rows, name, more: rows.groupBy("id").agg(F.lit(name).alias("origin"), (F.max("p_size") + more).alias("priority"))
    rules = K.layered([layer(part.where("p_partkey % 3 = 0"), "shop", 100), layer(part.where("p_partkey % 2 = 0"), "general", 0)], ["id"])
    return rules.withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), "id")).cast("long"))  # a rule book: at most 60 rows here


@query("""WITH records AS (SELECT p_brand || '-' || p_partkey AS id, p_name AS body FROM part)
SELECT * FROM records WHERE NOT starts_with(id, 'Brand#1') AND NOT starts_with(id, 'Brand#23') UNION ALL SELECT 'Brand#1-new-' || s_suppkey, s_name FROM supplier""")
def supplement_replace(spark: SparkSession, d: str) -> DataFrame:
    records = T.table(spark, d, "part").select(F.concat("p_brand", F.lit("-"), "p_partkey").alias("id"), F.col("p_name").alias("body"))
    fresh = T.table(spark, d, "supplier").select(F.concat(F.lit("Brand#1-new-"), "s_suppkey").alias("id"), F.col("s_name").alias("body"))
    return K.replaced_by_prefix(records, fresh, "id", ["Brand#1", "Brand#23"])


@query("""WITH have AS (SELECT DISTINCT 'tier' AS field, p_type AS value FROM part WHERE p_partkey % 3 = 0), more AS (SELECT 'tier' AS field, min(CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE p_type END) AS value, lower(p_type) AS low FROM part WHERE p_partkey % 3 <> 0 GROUP BY lower(p_type))
SELECT field, value, false AS added FROM have UNION ALL SELECT field, value, true FROM more WHERE low NOT IN (SELECT lower(value) FROM have)""", also="vocab_merge_all")
def vocab_merge(spark: SparkSession, d: str) -> DataFrame:
    """Every part is in the vocabulary or incoming."""
    return _merged_vocab(spark, d, "p_partkey % 3 <> 0")


def _merged_vocab(spark: SparkSession, d: str, incoming: str) -> DataFrame:
    part = T.table(spark, d, "part")
    have = part.where("p_partkey % 3 = 0").select(F.lit("tier").alias("field"), F.col("p_type").alias("value")).distinct()
    more = part.where(incoming).select(F.lit("tier").alias("field"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.col("p_type")).alias("value"))
    return K.merged_values(have, more, ["field"], "value")


_RECORDS = "records AS (SELECT p_partkey, [p_brand, 'GEN'] AS shops, [p_type] AS tiers, CASE WHEN p_size % 4 = 0 THEN [] ELSE ['step' || (p_size % 7)] END AS progress FROM part)"
_FIELDS = "each AS (SELECT p_partkey, 'shops' AS field, unnest(shops) AS value FROM records UNION ALL SELECT p_partkey, 'tiers', unnest(tiers) FROM records UNION ALL SELECT p_partkey, 'progress', unnest(progress) FROM records)"


def _records(spark: SparkSession, d: str) -> DataFrame:
    progress = F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("step"), F.col("p_size") % 7)))
    return T.table(spark, d, "part").select("p_partkey", F.array("p_brand", F.lit("GEN")).alias("shops"), F.array("p_type").alias("tiers"), progress.alias("progress"))


@query(f"WITH {_RECORDS}, {_FIELDS} SELECT field, value, count(*) AS n FROM each GROUP BY 1, 2")
def field_values(spark: SparkSession, d: str) -> DataFrame:
    return K.fields_of(_records(spark, d), "p_partkey", ["shops", "tiers", "progress"]).groupBy("field", "value").agg(F.count("*").alias("n"))


@query(f"""WITH {_RECORDS}, {_FIELDS}, allowed AS (SELECT 'progress' AS field, 'step' || i AS value FROM range(5) t(i) UNION ALL SELECT 'shops', 'GEN' UNION ALL SELECT DISTINCT 'shops', p_brand FROM part WHERE p_partkey % 7 = 1)
SELECT p_partkey, field, value FROM each WHERE field IN (SELECT field FROM allowed) AND NOT EXISTS (SELECT 1 FROM allowed a WHERE a.field = each.field AND a.value = each.value)""")
def record_errors(spark: SparkSession, d: str) -> DataFrame:
    fixed = spark.createDataFrame([("progress", f"step{i}") for i in range(5)] + [("shops", "GEN")], "field string, value string")
    allowed = fixed.union(T.table(spark, d, "part").where("p_partkey % 7 = 1").select(F.lit("shops"), "p_brand").distinct())
    return K.invalid_values(_records(spark, d), allowed, "p_partkey", ["shops", "tiers", "progress"])


_TREE = """tree AS (SELECT DISTINCT lower(CASE WHEN p_partkey % 9 = 0 THEN 'GEN' ELSE p_brand END) AS shop, lower(CASE WHEN p_partkey % 9 = 0 OR p_partkey % 4 = 0 THEN 'GEN' ELSE 'T' || (p_partkey % 3) END) AS tier,
  lower(CASE WHEN p_partkey % 9 = 0 OR p_partkey % 2 = 0 THEN 'GEN' ELSE 'step' || (p_size % 3) END) AS progress, 'intent ' || (p_partkey % 40) AS intent FROM part)"""


@query(f"""WITH {_TREE}, scopes AS (SELECT c_custkey AS scope_id, lower('Brand#' || (c_custkey % 45 + 10)) AS shop, lower('t' || (c_custkey % 3)) AS tier, lower('STEP' || (c_custkey % 3)) AS progress FROM customer),
asked AS (SELECT scope_id, 0 AS path, shop, tier, progress FROM scopes UNION ALL SELECT scope_id, 1, shop, tier, 'gen' FROM scopes UNION ALL SELECT scope_id, 2, shop, 'gen', progress FROM scopes
  UNION ALL SELECT scope_id, 3, shop, 'gen', 'gen' FROM scopes UNION ALL SELECT scope_id, 4, 'gen', 'gen', 'gen' FROM scopes WHERE shop IN (SELECT shop FROM tree))
SELECT scope_id, intent, min(path) AS path FROM asked JOIN tree USING (shop, tier, progress) GROUP BY 1, 2""")
def allowed_intents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    tree = T.table(spark, d, "part").select(
        F.when(k % 9 == 0, "GEN").otherwise(F.col("p_brand")).alias("shop"), F.when((k % 9 == 0) | (k % 4 == 0), "GEN").otherwise(F.concat(F.lit("T"), k % 3)).alias("tier"),
        F.when((k % 9 == 0) | (k % 2 == 0), "GEN").otherwise(F.concat(F.lit("step"), F.col("p_size") % 3)).alias("progress"), F.concat(F.lit("intent "), k % 40).alias("intent"),
    )
    c = F.col("c_custkey")
    scopes = T.table(spark, d, "customer").select(c.alias("scope_id"), F.concat(F.lit("Brand#"), c % 45 + 10).alias("shop"), F.concat(F.lit("t"), c % 3).alias("tier"), F.concat(F.lit("STEP"), c % 3).alias("progress"))
    return K.allowed_intents(tree, scopes)


@query("""WITH declared AS (SELECT DISTINCT 'f' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.txt.html' WHEN 1 THEN '.html.html' WHEN 2 THEN '.txt' ELSE '.docx' END AS name FROM part), known AS (SELECT 'f' || p_partkey || CASE WHEN p_partkey % 4 = 1 THEN '.html' ELSE '.txt' END AS name FROM part WHERE p_partkey % 5 <> 0)
SELECT name, CASE WHEN name IN (SELECT name FROM known) OR NOT regexp_matches(name, '\\.(txt|html)\\.html$') OR regexp_replace(name, '\\.html$', '') NOT IN (SELECT name FROM known) THEN name ELSE regexp_replace(name, '\\.html$', '') END AS resolved,
CASE WHEN name IN (SELECT name FROM known) THEN 'same' WHEN regexp_matches(name, '\\.(txt|html)\\.html$') AND regexp_replace(name, '\\.html$', '') IN (SELECT name FROM known) THEN 'repaired' ELSE 'unknown' END AS how FROM declared""")
def doubled_endings(spark: SparkSession, d: str) -> DataFrame:
    """Declared file names whose doubled ending is repaired if the catalog has the rest (STR-25); catalog_names mends any typing error."""
    part, k = T.table(spark, d, "part"), F.col("p_partkey")
    declared = part.select(F.concat(F.lit("f"), k, F.when(k % 4 == 0, ".txt.html").when(k % 4 == 1, ".html.html").when(k % 4 == 2, ".txt").otherwise(".docx")).alias("name"))
    return K.resolved_names(declared, part.where("p_partkey % 5 <> 0").select(F.concat(F.lit("f"), k, F.when(k % 4 == 1, ".html").otherwise(".txt")).alias("name")))


@query(r"""WITH found AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<(?:h[1-3]|p)[^>]*>.*?</(?:h[1-3]|p)>')) AS e, unnest(range(0, len(regexp_extract_all(html, '(?s)<(?:h[1-3]|p)[^>]*>.*?</(?:h[1-3]|p)>')))) AS pos FROM pages),
parts AS (SELECT page_id, pos, regexp_matches(e, '^<h') AS is_heading, regexp_replace(e, '<[^>]*>', '', 'g') AS body FROM found),
filled AS (SELECT *, last_value(CASE WHEN is_heading THEN body END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS heading FROM parts)
SELECT page_id, pos, heading, body FROM filled WHERE NOT is_heading""")
def heading_fill(spark: SparkSession, d: str) -> DataFrame:
    elements = F.regexp_extract_all("html", F.lit(r"(?s)<(?:h[1-3]|p)[^>]*>.*?</(?:h[1-3]|p)>"), 0)
    rows = T.table(spark, d, "pages").select("page_id", F.posexplode(elements).alias("pos", "e"))
    rows = rows.select("page_id", F.col("pos").cast("long").alias("pos"), F.col("e").rlike("^<h").alias("is_heading"), F.regexp_replace("e", "<[^>]*>", "").alias("body"))
    rows = K.filled_down(rows.withColumn("heading", F.when(F.col("is_heading"), F.col("body"))), ["page_id"], "pos", ["heading"])
    return rows.where("not is_heading").select("page_id", "pos", "heading", "body")


_SECTIONED = "concat('intro', chr(10), '===== ', p_brand, ' =====', chr(10), p_name, chr(10), p_type, chr(10), '===== rules =====', chr(10), ' ', p_type, chr(10))"


@query(r"WITH t AS (SELECT p_partkey, string_split(chr(10) || " + _SECTIONED + r", chr(10) || '===== ') AS parts FROM part), each AS (SELECT p_partkey, unnest(parts[2:]) AS p FROM t) SELECT p_partkey, trim(split_part(p, ' =====', 1)) AS name, regexp_replace(regexp_replace(p, '^[^\n]*', ''), '^\s+|\s+$', '', 'g') AS body FROM each")
def prompt_sections(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "part").select("p_partkey", F.inline(X.sections(F.expr(_SECTIONED))))


_NUMBERED = "CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE concat('Notes', chr(10), '1. ', p_name, chr(10), chr(10), '  2. ', p_type, ' ', chr(10), 'more', chr(10), '3.') END"


@query(r"WITH t AS (SELECT p_partkey, " + _NUMBERED + r""" AS body FROM part), parts AS (SELECT p_partkey, body, list_filter(string_split(regexp_replace(body, '(?m)^[ \t]*([0-9]+)\.', '§\1.', 'g'), '§'), lambda p: regexp_matches(p, '^[0-9]+\.')) AS ps FROM t),
items AS (SELECT p_partkey, unnest(CASE WHEN len(ps) = 0 THEN ['1. ' || body] ELSE ps END) AS p FROM parts),
made AS (SELECT p_partkey, regexp_extract(p, '^([0-9]+)\.', 1) AS number, array_to_string(list_filter(list_transform(string_split(regexp_replace(p, '^[0-9]+\.[ \t]*', ''), chr(10)), lambda x: regexp_replace(x, '\s+$', '')), lambda x: x <> ''), chr(10)) AS body FROM items)
SELECT p_partkey, number, trim(body) AS body FROM made WHERE trim(body) <> ''""")
def numbered_items(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "part").select("p_partkey", F.inline(X.numbered_items(F.expr(_NUMBERED))))


_LEVELED = "CASE p_partkey % 5 WHEN 0 THEN 'a-07 start' WHEN 1 THEN 'for the B-Level' WHEN 2 THEN 'S-level and a-level' WHEN 3 THEN 'S-1 short' ELSE p_name END"


@query(f"""WITH t AS (SELECT p_partkey, {_LEVELED} AS title FROM part) SELECT p_partkey, CASE WHEN regexp_matches(title, '^(?i)[sab]-[0-9][0-9]') THEN upper(substr(title, 1, 1)) WHEN contains(lower(title), 's-level') THEN 'S' WHEN contains(lower(title), 'a-level') THEN 'A'
WHEN contains(lower(title), 'b-level') THEN 'B' ELSE 'GEN' END AS level FROM t""")
def level_of(spark: SparkSession, d: str) -> DataFrame:
    title = F.expr(_LEVELED)
    return T.table(spark, d, "part").select("p_partkey", X.level(title, title).alias("level"))


_JSON = """CASE WHEN p_partkey % 3 = 0 THEN concat('{"10":" ', p_brand, '","2":"', p_type, '","x":"last","1":null,"3":"  "}') WHEN p_partkey % 3 = 1 THEN concat('plain ', p_name) ELSE '{broken}' END"""


@query(f"""WITH t AS (SELECT p_partkey, {_JSON} AS info FROM part) SELECT p_partkey, CASE WHEN json_valid(info) THEN array_to_string(list_filter([trim(json_extract_string(info, '$."2"')), trim(json_extract_string(info, '$."10"')), json_extract_string(info, '$.x')], lambda v: v IS NOT NULL), chr(10)) ELSE info END AS text FROM t""")
def message_json(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "part").select("p_partkey", X.message_text(F.expr(_JSON)).alias("text"))


_CREATOR = r"array_to_string(list_filter(list_transform(string_split(message_info, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: regexp_matches(x, '(?i)\[creator\s*\]')), chr(10))"


@query(with_tables("messages audit_log", rf"""said AS (SELECT id, source, creator_name, create_time, message_info, {_CREATOR} AS said FROM audit_log),
counted AS (SELECT *, len(regexp_extract_all(message_info, '\[creator\]')) AS c, len(regexp_extract_all(message_info, '\[seller\]')) AS s FROM said)
SELECT id, source, creator_name, said, coalesce(regexp_extract_all(said, '(?i)\[([^\[\]]+)\]\s*\[creator\s*\]', 1)[-1], '') AS last_time, c AS creator_lines, s AS seller_lines, printf('%.6f', CASE WHEN s = 0 THEN 0.0 ELSE CAST(c AS DOUBLE) / s END) AS ratio,
epoch_ms(create_time) AS created_ms, array_to_string(list_filter([CASE WHEN contains(lower(message_info), 'thank') THEN 'thanked' END, CASE WHEN contains(message_info, '?') THEN 'asked' END], lambda x: x IS NOT NULL), ',') AS tags FROM counted"""))
def record_fields(spark: SparkSession, d: str) -> DataFrame:
    history = F.col("message_info")
    count = lambda role: F.regexp_count(history, F.lit(rf"\[{role}\]")).cast("long")
    rows = T.audit_log(spark, d).withColumns({"said": X.creator_lines(history), "creator_lines": count("creator"), "seller_lines": count("seller")})
    ratio = F.when(F.col("seller_lines") == 0, 0.0).otherwise(F.try_divide(F.col("creator_lines").cast("double"), "seller_lines"))
    tags = F.array_compact(F.array(F.when(F.contains(F.lower(history), F.lit("thank")), "thanked"), F.when(F.contains(history, F.lit("?")), "asked")))
    return rows.select(
        "id", "source", "creator_name", "said", X.last_bracket(F.col("said")).alias("last_time"), "creator_lines", "seller_lines", F.format_string("%.6f", ratio).alias("ratio"),
        F.unix_millis("create_time").alias("created_ms"), F.array_join(tags, ",").alias("tags"),
    )


@query(with_tables("messages", r"""said AS (SELECT conv_id, turn, text, regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '[.!]+$', '') AS short FROM messages WHERE role = 'creator')
SELECT conv_id, turn, coalesce(short <> '' AND (short IN (""" + ", ".join(f"'{x}'" for x in X.SHORT_REFUSALS) + r""") OR regexp_matches(text, '(?i)\b(?:not interested|no thanks|no thank you|don''?t want|won''?t|can''?t do|pass)\b')), false) AS refuses FROM said"""))
def outreach_refusals(spark: SparkSession, d: str) -> DataFrame:
    return T.messages(spark, d).where("role = 'creator'").select("conv_id", "turn", X.refuses(F.col("text")).alias("refuses"))


_ACTION = "CASE p_partkey % 4 WHEN 0 THEN ' Send CPM offer + estimate' WHEN 1 THEN 'Mark-DNC' WHEN 2 THEN 'Add to DNC list, stop all outreach' ELSE p_brand END"


@query(f"WITH t AS (SELECT p_partkey, {_ACTION} AS raw FROM part) SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'send_cpm_offer' WHEN 1 THEN 'mark_dnc' WHEN 2 THEN 'mark_dnc' ELSE lower(replace(raw, '#', '')) END AS action FROM t")
def action_names(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "part").select("p_partkey", X.action(F.expr(_ACTION)).alias("action"))


_INTENT = "CASE p_partkey % 4 WHEN 0 THEN concat(p_type, '   Negotiation ') WHEN 1 THEN ' ' WHEN 2 THEN concat(p_name, '  ', p_type, ' ', p_name) ELSE p_name END"


@query(r"WITH t AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _INTENT + r", '^\s+|\s+$', '', 'g'), '(?i)\s+(?:Negotiation|Handling|Enrollment|Interest|Transfer|Support)\s*$', ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS s FROM part) SELECT p_partkey, nullif(CASE WHEN length(s) > 48 THEN regexp_replace(substr(s, 1, 48), ' [^ ]*$', '') ELSE s END, '') AS intent FROM t")
def intent_names(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "part").select("p_partkey", X.canonical_intent(F.expr(_INTENT)).alias("intent"))


_RULE_TOKENS = "CASE p_partkey % 5 WHEN 0 THEN {e} WHEN 1 THEN {a}'joined'{z} WHEN 2 THEN {a}'price_negotiation_rounds=2', 'joined'{z} WHEN 3 THEN {a}'stage=b'{z} ELSE {a}'stage'{z} END"
_CTX_TOKENS = "CASE p_size % 4 WHEN 0 THEN {a}'joined', 'negotiation_rounds=2'{z} WHEN 1 THEN {e} WHEN 2 THEN {a}'stage=b'{z} ELSE {a}'stage=c', 'joined'{z} END"
_DUCK, _SPARK = {"e": "CAST([] AS VARCHAR[])", "a": "[", "z": "]"}, {"e": "cast(array() as array<string>)", "a": "array(", "z": ")"}


@query(f"""WITH t AS (SELECT p_partkey, {_RULE_TOKENS.format(**_DUCK)} AS r, list_transform({_CTX_TOKENS.format(**_DUCK)}, lambda t: CASE WHEN starts_with(t, 'negotiation_rounds=') THEN 'price_' || t ELSE t END) AS c FROM part)
SELECT p_partkey, len(r) = 0 OR (len(c) > 0 AND len(list_filter(r, lambda t: NOT (list_contains(c, t) OR (NOT contains(t, '=') AND len(list_filter(c, lambda x: starts_with(x, t || '='))) > 0)))) = 0) AS fits,
TRY_CAST(nullif(regexp_extract(array_to_string(c, ' '), 'price_negotiation_rounds=([0-9]+)', 1), '') AS INTEGER) AS round FROM t""")
def progress_tokens(spark: SparkSession, d: str) -> DataFrame:
    rule, context = F.expr(_RULE_TOKENS.format(**_SPARK)), F.expr(_CTX_TOKENS.format(**_SPARK))
    return T.table(spark, d, "part").select("p_partkey", X.progress_matches(rule, context).alias("fits"), X.round_of(context).alias("round"))


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size % 6 AS INTEGER) END AS stored, CASE p_partkey % 4 WHEN 0 THEN 'a' || (p_size % 6) WHEN 1 THEN ' ' END AS node FROM part), g AS (SELECT p_partkey, stored, nullif(upper(trim(node)), '') AS given FROM t),
n AS (SELECT p_partkey, given, coalesce(stored, CASE WHEN p_partkey % 5 = 0 THEN 4 END, CASE WHEN given IN ('A1', 'A2', 'A3', 'A4') THEN CAST(substr(given, 2) AS INTEGER) END) AS round FROM g)
SELECT p_partkey, round, coalesce(given, CASE WHEN round BETWEEN 1 AND 4 THEN 'A' || round END) AS node, CASE WHEN round BETWEEN 2 AND 4 THEN 'A' || (round - 1) END AS before FROM n""")
def negotiation_state(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    given = F.when(k % 4 == 0, F.concat(F.lit("a"), size % 6)).when(k % 4 == 1, " ")
    tokens = F.when(k % 5 == 0, F.array(F.lit("negotiation_rounds=4"))).otherwise(F.array().cast("array<string>"))
    state = X.negotiation_state(F.when(k % 3 == 0, (size % 6).cast("int")), given, tokens)
    return T.table(spark, d, "part").select("p_partkey", state.alias("s")).select("p_partkey", "s.*")


@query("WITH " + _NEAR.format(where=" AND (v.label % 3 = 1 OR v.label = 2)", k=24).replace("SELECT query_id, vec_id, distance, rank FROM placed WHERE rank <= 24", """, strict AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM placed WHERE rank <= 24 AND vec_id % 4 <> 0)
SELECT query_id, vec_id, distance, place FROM strict WHERE place <= 3"""))
def retrieve_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Over-fetch min(max(8k, 20), 80) with the metadata filter, then the strict filter, then the k = 3 best."""
    found = V.nearest(T.table(spark, d, "embeddings").where("label % 3 = 1 or label = 2"), _asked(spark, d), min(max(8 * 3, 20), 80)).where("vec_id % 4 <> 0")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("place", place.cast("long")).where("place <= 3").select("query_id", "vec_id", "distance", "place")


def _shop_rows(show: DataFrame, creators: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    shown = show.groupBy(R.same_name("user_name").alias("k")).agg(F.max(F.when(F.col("status") == "A", 1).otherwise(0)).alias("is_open"), F.count("*").alias("n"), F.max("gmv").alias("shown_gmv"))
    people = creators.select(R.same_name("creators_name").alias("k"), "gmv")
    rows = T.audit_log(spark, d).where("source = 'shop_1'").withColumn("k", R.same_name("creator_name"))
    joined = rows.join(people, "k", "left").join(shown, "k", "left")
    return joined.select("id", "source", "creator_name", "gmv", F.coalesce("is_open", F.lit(0)).alias("is_open"), F.coalesce("n", F.lit(0)).alias("n"), "shown_gmv")


@query(with_tables("messages audit_log showcase all_creators", """shown AS (SELECT lower(trim(user_name)) AS k, max(CASE WHEN status = 'A' THEN 1 ELSE 0 END) AS is_open, count(*) AS n, max(gmv) AS shown_gmv FROM showcase GROUP BY 1)
SELECT a.id, a.source, a.creator_name, c.gmv, coalesce(s.is_open, 0) AS is_open, coalesce(s.n, 0) AS n, s.shown_gmv FROM audit_log a LEFT JOIN all_creators c ON lower(trim(c.creators_name)) = lower(trim(a.creator_name)) LEFT JOIN shown s ON s.k = lower(trim(a.creator_name)) WHERE a.source = 'shop_1'"""), also="shop_rows_all")
def shop_rows(spark: SparkSession, d: str) -> DataFrame:
    return _shop_rows(T.showcase(spark, d), T.all_creators(spark, d), spark, d)


@query("""SELECT 'f' || p_partkey AS stem FROM part WHERE p_partkey NOT IN (SELECT ps FROM (SELECT DISTINCT l_partkey AS ps FROM lineitem WHERE l_quantity > 40))""", also="orphan_files_all")
def orphan_files(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(T.table(spark, d, "part"), spark, d)


def _orphans(files: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    full = files.select(F.concat(F.lit("f"), "p_partkey").alias("stem"))
    chunked = T.table(spark, d, "lineitem").where("l_quantity > 40").select(F.concat(F.lit("f"), "l_partkey").alias("stem"))
    return full.join(chunked, "stem", "left_anti")


@query()
def slot_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Slots (parts) to values (suppliers) of an order, by the greatest quantity. Order lines are the scored pairs."""
    lines = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("shop"), (F.col("l_partkey") % 5).alias("slot"), (F.col("l_suppkey") % 5).alias("value"), F.col("l_quantity").cast("double").alias("score"))
    scores = lines.groupBy("shop", "slot", "value").agg(F.max("score").alias("score"))
    return K.assigned(scores, "shop", least=5.0)
