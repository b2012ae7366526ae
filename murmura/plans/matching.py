"""Rule matching, intents, retrieval, index maintenance, keyed state and vocabulary queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intents as I
from ..operators import pivots as P
from ..operators import rules as L
from ..operators import vectors as V
from ..session import checkpoint_dir
from ..sources import tables as T
from ..sources.tables import with_tables
from .registry import query

_INTENT_SQL = "CASE {x} % 5 WHEN 0 THEN 'price_reject' WHEN 1 THEN 'quote_too_low' WHEN 2 THEN 'ask_sample' WHEN 3 THEN 'sample_inquiry' ELSE 'greeting' END"
_EMOTION_SQL = "CASE {x} % 6 WHEN 0 THEN 'refusal' WHEN 1 THEN 'interested' WHEN 2 THEN 'not_interested' WHEN 3 THEN 'neutral' END"


def rules_of(spark: SparkSession, d: str) -> DataFrame:
    """Rules from parts: shops by brand (every fifth general, some for two shops), tiers, progress, intents, emotions, flags."""
    empty = F.array().cast("array<string>")
    return T.table(spark, d, "part").select(
        F.col("p_partkey").alias("rule_id"),
        F.when(F.col("p_partkey") % 5 == 0, empty).when(F.col("p_partkey") % 7 == 0, F.array("p_brand", F.lit("Brand#99"))).otherwise(F.array("p_brand")).alias("shops"),
        F.when(F.col("p_partkey") % 4 == 0, empty).otherwise(F.array(F.concat(F.lit("T"), F.col("p_partkey") % 3))).alias("tiers"),
        F.when(F.col("p_size") % 3 == 0, empty).otherwise(F.array(F.concat(F.lit("step"), F.col("p_size") % 3))).alias("progress"),
        F.when(F.col("p_partkey") % 6 == 0, empty).otherwise(F.array(F.expr(_INTENT_SQL.format(x="p_partkey")))).alias("intents"),
        F.expr(_EMOTION_SQL.format(x="p_partkey")).alias("emotion"),
        F.when(F.col("p_partkey") % 8 == 0, F.array(F.lit("vip"))).otherwise(empty).alias("flags"),
    )


def contexts_of(spark: SparkSession, d: str) -> DataFrame:
    """Contexts from customers."""
    empty = F.array().cast("array<string>")
    return T.table(spark, d, "customer").select(
        F.col("c_custkey").alias("context_id"), F.concat(F.lit("Brand#"), F.col("c_custkey") % 40 + 10).alias("shop"), F.array(F.concat(F.lit("T"), F.col("c_custkey") % 3)).alias("tiers"),
        F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("step1"), F.lit("step2"))).otherwise(F.array(F.lit("step1"))).alias("progress"),
        F.array(F.expr(_INTENT_SQL.format(x="c_custkey"))).alias("intents"), F.expr(_EMOTION_SQL.format(x="c_nationkey")).alias("emotion"),
        F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("vip"))).otherwise(empty).alias("flags"),
    )


_RULES = f"""rules AS (SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 5 = 0 THEN [] WHEN p_partkey % 7 = 0 THEN [p_brand, 'Brand#99'] ELSE [p_brand] END AS shops,
  CASE WHEN p_partkey % 4 = 0 THEN [] ELSE ['T' || (p_partkey % 3)] END AS tiers, CASE WHEN p_size % 3 = 0 THEN [] ELSE ['step' || (p_size % 3)] END AS progress,
  CASE WHEN p_partkey % 6 = 0 THEN [] ELSE [{_INTENT_SQL.format(x="p_partkey")}] END AS intents, {_EMOTION_SQL.format(x="p_partkey")} AS emotion, CASE WHEN p_partkey % 8 = 0 THEN ['vip'] ELSE [] END AS flags FROM part),
contexts AS (SELECT c_custkey AS context_id, 'Brand#' || (c_custkey % 40 + 10) AS shop, ['T' || (c_custkey % 3)] AS tiers, CASE WHEN c_custkey % 2 = 0 THEN ['step1', 'step2'] ELSE ['step1'] END AS progress,
  [{_INTENT_SQL.format(x="c_custkey")}] AS intents, {_EMOTION_SQL.format(x="c_nationkey")} AS emotion, CASE WHEN c_custkey % 3 = 0 THEN ['vip'] ELSE [] END AS flags FROM customer)"""
_MATCH = """matched AS (SELECT c.context_id, r.rule_id FROM contexts c JOIN rules r ON (len(r.shops) = 0 OR list_contains(r.shops, c.shop)) AND (len(r.tiers) = 0 OR list_has_any(r.tiers, c.tiers)) AND list_has_all(c.progress, r.progress)
  AND list_has_all(c.flags, r.flags) AND (len(r.intents) = 0 OR list_has_all(c.intents, r.intents) OR (list_has_all(['price_reject', 'quote_too_low'], r.intents) AND list_has_all(['price_reject', 'quote_too_low'], c.intents))
    OR (list_has_all(['ask_sample', 'sample_inquiry'], r.intents) AND list_has_all(['ask_sample', 'sample_inquiry'], c.intents)))
  AND CASE WHEN r.emotion IS NULL THEN true WHEN r.emotion IN ('refusal', 'not_interested', 'angry') THEN coalesce(r.emotion = c.emotion, false) ELSE NOT coalesce(c.emotion IN ('refusal', 'not_interested', 'angry'), false) END)"""


@query(f"WITH {_RULES}, {_MATCH} SELECT context_id, rule_id FROM matched")
def rule_match(spark: SparkSession, d: str) -> DataFrame:
    return L.match_rules(rules_of(spark, d), contexts_of(spark, d))


@query(f"WITH {_RULES}, {_MATCH}, placed AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY rule_id) AS place FROM matched) SELECT context_id, rule_id, place FROM placed WHERE place <= 3")
def rule_match_topk(spark: SparkSession, d: str) -> DataFrame:
    """The first three rules of each context, chosen among signatures."""
    return L.first_rules(rules_of(spark, d), contexts_of(spark, d), 3)


@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [] WHEN p_partkey % 3 = 1 THEN ['GEN'] ELSE [p_brand, 'GEN'] END AS shops, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '/a.txt' ELSE 'gen\\b.txt' END AS f FROM part)
SELECT p_partkey, CASE WHEN len(shops) > 0 THEN len(list_filter(shops, lambda s: upper(s) <> 'GEN')) = 0 OR list_contains(list_filter(shops, lambda s: upper(s) <> 'GEN'), 'Brand#13')
ELSE split_part(replace(f, '\\', '/'), '/', 1) IN ('GEN', 'gen') OR split_part(replace(f, '\\', '/'), '/', 1) = 'Brand#13' END AS in_scope FROM r""".replace("\\\\", "\\"))
def shop_scope(spark: SparkSession, d: str) -> DataFrame:
    shops = F.when(F.col("p_partkey") % 3 == 0, F.array().cast("array<string>")).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("GEN"))).otherwise(F.array("p_brand", F.lit("GEN")))
    file = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit("/a.txt"))).otherwise(F.lit("gen\\b.txt"))
    return T.table(spark, d, "part").select("p_partkey", L.shop_in_scope(shops, file, F.lit("Brand#13")).alias("in_scope"))


@query("""WITH r AS (SELECT o_orderkey, CAST(o_orderkey % 5 AS INTEGER) AS n, o_orderkey % 3 = 0 AS flat, o_orderkey % 4 = 0 AS reject, CASE o_orderkey % 7 WHEN 0 THEN 'price_reject' WHEN 1 THEN 'quote_too_low' WHEN 2 THEN 'final_offer' ELSE 'other' END AS intent FROM orders),
e AS (SELECT o_orderkey, greatest(CASE WHEN n = 0 AND flat THEN 2 WHEN reject THEN least(n + 1, 3) ELSE n END, CASE intent WHEN 'price_reject' THEN 1 WHEN 'quote_too_low' THEN 2 WHEN 'final_offer' THEN 3 ELSE 0 END) AS round FROM r)
SELECT o_orderkey, round, CASE WHEN round BETWEEN 1 AND 4 THEN 'A' || round END AS node FROM e""")
def negotiation_round(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    intent = F.when(k % 7 == 0, "price_reject").when(k % 7 == 1, "quote_too_low").when(k % 7 == 2, "final_offer").otherwise("other")
    now = L.effective_round((k % 5).cast("int"), k % 3 == 0, k % 4 == 0, intent)
    return T.table(spark, d, "orders").select("o_orderkey", now.alias("round")).withColumn("node", L.node_of_round(F.col("round")))


KEYWORDS = [("thanks", "thank"), ("thanks", "great"), ("question", "how"), ("question", "what"), ("question", "explain"), ("work", "code"), ("work", "function"), ("work", "write")]
PRIORITIES = {"question": 2, "work": 1}
_SCORES = with_tables("messages", "words(intent, w) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in KEYWORDS) + """), said AS (SELECT conv_id || '-' || turn AS message_id, text FROM messages WHERE role = 'creator'),
scores AS (SELECT message_id, intent, CAST(sum(CASE WHEN contains(lower(text), w) THEN CASE WHEN length(w) > 4 THEN 2 ELSE 1 END ELSE 0 END) AS INTEGER) AS score FROM said, words GROUP BY 1, 2 HAVING score > 0),
placed AS (SELECT *, max(score) OVER (PARTITION BY message_id) AS top, row_number() OVER (PARTITION BY message_id ORDER BY score DESC, CASE intent WHEN 'question' THEN 2 WHEN 'work' THEN 1 ELSE 0 END DESC, intent) AS rank FROM scores),
ranked AS (SELECT message_id, intent, score, rank, round(least(0.92, 0.45 + 0.45 * score / top), 6) AS confidence FROM placed WHERE rank <= 8) """)


def _said(spark: SparkSession, d: str) -> DataFrame:
    return T.messages(spark, d).where("role = 'creator'").select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), "text")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return I.ranked(I.keyword_scores(_said(spark, d), spark.createDataFrame(KEYWORDS, "intent string, keyword string")), PRIORITIES)


@query(_SCORES + "SELECT message_id, intent, score, rank, confidence FROM ranked")
def intent_keyword_rank(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d)


@query(_SCORES + """, boosted AS (SELECT message_id, intent, max(confidence) AS confidence FROM (SELECT message_id, intent, confidence FROM ranked UNION ALL SELECT message_id, 'follow_up', 0.9 FROM said WHERE contains(lower(text), 'please')) GROUP BY 1, 2),
tops AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY confidence DESC, intent) AS place FROM boosted WHERE confidence >= 0.5) SELECT message_id, intent, confidence, place FROM tops WHERE place <= 3""")
def intent_boost(spark: SparkSession, d: str) -> DataFrame:
    said = _said(spark, d)
    return I.top(I.boosted(_ranked(spark, d), said, F.contains(F.lower("text"), F.lit("please")), "follow_up", 0.9), 0.5, 3)


@query(with_tables("messages", """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'stop|unsubscribe|reject') THEN 'refusal' WHEN regexp_matches(lower(text), 'not interested|worthless|no thanks') THEN 'not_interested'
WHEN regexp_matches(lower(text), 'interested|thank|great') THEN 'interested' END AS emotion FROM messages"""))
def emotion(spark: SparkSession, d: str) -> DataFrame:
    return T.messages(spark, d).select("conv_id", "turn", I.emotion(F.col("text")).alias("emotion"))


_NEAR = """pairs AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(1 - list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) /
  (sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 6) + 0.0 AS distance
  FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0{where}), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
SELECT query_id, vec_id, distance, rank FROM placed WHERE rank <= {k}"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("WITH " + _NEAR.format(where="", k=24))
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return V.nearest(T.table(spark, d, "embeddings"), _asked(spark, d), 24)


@query("WITH " + _NEAR.format(where="", k=24))
def vector_topk_clustered(spark: SparkSession, d: str) -> DataFrame:
    """The same from an index clustered by pivots, where clusters and vectors out of reach are skipped (VEC-03, SRT-01)."""
    index = T.table(spark, d, "embeddings")
    centres = P.pivots(index, 64)
    found, _ = P.nearest(P.clustered(index, centres, f"{checkpoint_dir(spark).rstrip('/')}/murmura-pivots-{uuid.uuid4().hex}"), centres, _asked(spark, d), 24)
    return found


@query("WITH " + _NEAR.format(where=" AND (v.label % 3 = 1 OR v.label = 2)", k=3))
def vector_where(spark: SparkSession, d: str) -> DataFrame:
    return V.nearest(T.table(spark, d, "embeddings").where("label % 3 = 1 or label = 2"), _asked(spark, d), 3)


@query("""WITH idx AS (SELECT vec_id, 'file_' || (label % 20) AS source_file, 'old' AS version FROM embeddings), gone AS (SELECT 'file_3' AS source_file UNION SELECT 'file_5'), fresh AS (SELECT vec_id, source_file, 'new' AS version FROM idx WHERE source_file = 'file_5' OR source_file = 'file_7')
SELECT * FROM idx WHERE source_file NOT IN (SELECT source_file FROM gone UNION SELECT source_file FROM fresh) UNION ALL SELECT * FROM fresh""")
def index_refresh(spark: SparkSession, d: str) -> DataFrame:
    index = T.table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("file_"), F.col("label") % 20).alias("source_file"), F.lit("old").alias("version"))
    fresh = index.where("source_file in ('file_5', 'file_7')").withColumn("version", F.lit("new"))
    return V.refreshed(index, fresh, spark.createDataFrame([("file_3",), ("file_5",)], "source_file string"))


def _upserted(spark: SparkSession, d: str, changes: str) -> DataFrame:
    events = T.table(spark, d, "events").select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))
    state = events.where("event_id % 2 = 0").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max_by("value", "event_id").alias("value"))
    return V.upserted(state, events.where(changes), ["user_id"], "event_id")


@query("""WITH state AS (SELECT user_id, max_by(event_type, event_id) AS event_type, round(max_by(value, event_id), 4) AS value FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
changes AS (SELECT user_id, max_by(event_type, event_id) AS event_type, round(max_by(value, event_id), 4) AS value FROM events WHERE event_id % 2 <> 0 GROUP BY user_id)
SELECT coalesce(s.user_id, c.user_id) AS user_id, CASE WHEN c.user_id IS NULL THEN s.event_type ELSE c.event_type END AS event_type, CASE WHEN c.user_id IS NULL THEN s.value ELSE c.value END AS value FROM state s FULL JOIN changes c ON s.user_id = c.user_id""", also="state_upsert_all")
def state_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Every event is in the state (even ids) or a change (odd ids)."""
    return _upserted(spark, d, "event_id % 2 <> 0")


@query("""WITH records AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' ' || upper(p_brand) WHEN 1 THEN p_brand ELSE 'nickname ' || (p_partkey % 9) END AS raw FROM part),
aliases AS (SELECT DISTINCT lower(p_brand) AS alias, p_brand AS canonical, 1 AS layer FROM part UNION ALL SELECT 'nickname ' || i, 'Brand#' || (10 + i), 2 FROM range(5) t(i) UNION ALL SELECT 'nickname 1', 'Brand#77', 1)
SELECT p_partkey, (SELECT min_by(canonical, layer) FROM aliases WHERE alias = lower(trim(raw))) AS canonical, NOT EXISTS (SELECT 1 FROM aliases WHERE alias = lower(trim(raw))) AS unknown FROM records""")
def vocab_canon(spark: SparkSession, d: str) -> DataFrame:
    part = T.table(spark, d, "part")
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" "), F.upper("p_brand"))).when(F.col("p_partkey") % 4 == 1, F.col("p_brand")).otherwise(F.concat(F.lit("nickname "), F.col("p_partkey") % 9))
    nick = spark.createDataFrame([(f"nickname {i}", f"Brand#{10 + i}", 2) for i in range(5)] + [("nickname 1", "Brand#77", 1)], "alias string, canonical string, layer int")
    aliases = part.select(F.lower("p_brand").alias("alias"), F.col("p_brand").alias("canonical"), F.lit(1).alias("layer")).distinct().union(nick)
    chosen = aliases.groupBy("alias").agg(F.min_by("canonical", "layer").alias("canonical"))
    rows = part.select("p_partkey", F.lower(F.trim(raw)).alias("alias")).join(chosen, "alias", "left")
    return rows.select("p_partkey", "canonical", F.col("canonical").isNull().alias("unknown"))


@query("""WITH r AS (SELECT p_brand AS shop, p_type AS tier, p_size AS progress, p_name AS intent FROM part)
SELECT shop, tier, count(DISTINCT progress) AS steps, string_agg(DISTINCT intent, '|' ORDER BY intent) AS intents FROM r GROUP BY 1, 2""")
def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "part").groupBy(F.col("p_brand").alias("shop"), F.col("p_type").alias("tier")).agg(F.countDistinct("p_size").alias("steps"), F.array_join(F.array_sort(F.collect_set("p_name")), "|").alias("intents"))


@query(r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
kept AS (SELECT doc_id, pos, trim(line) AS body FROM lines WHERE trim(line) <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS item, CASE WHEN length(body) > 72 THEN substr(body, 1, 71) || '…' ELSE body END AS title, length(body) AS n_chars FROM kept""")
def policy_chunks(spark: SparkSession, d: str) -> DataFrame:
    """One record for each line of a document that is not blank; the numbering stays within a document, so no window is needed."""
    bodies = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = T.table(spark, d, "documents").select("doc_id", F.posexplode(bodies).alias("p", "body"))
    title = F.when(F.length("body") > 72, F.concat(F.substring("body", 1, 71), F.lit("…"))).otherwise(F.col("body"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("item"), title.alias("title"), F.length("body").cast("long").alias("n_chars"))


@query(r"""SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g') AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages""")
def html_outline(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1), "<[^>]*>", "").alias("title"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


@query("""WITH manifest AS (SELECT 'f' || p_partkey AS source_file, md5(p_name) AS checksum, 1 AS run FROM part WHERE p_partkey % 4 <> 0), found AS (SELECT 'f' || p_partkey AS source_file, CASE WHEN p_partkey % 6 = 0 THEN md5(p_type) ELSE md5(p_name) END AS checksum, 2 AS run FROM part WHERE p_partkey % 5 <> 0)
SELECT coalesce(f.source_file, m.source_file) AS source_file, CASE WHEN m.source_file IS NULL THEN 'added' WHEN f.source_file IS NULL THEN 'deleted' WHEN m.checksum <> f.checksum THEN 'modified' ELSE 'same' END AS op FROM manifest m FULL JOIN found f ON m.source_file = f.source_file""")
def incremental_plan(spark: SparkSession, d: str) -> DataFrame:
    part = T.table(spark, d, "part").select("p_partkey", F.concat(F.lit("f"), "p_partkey").alias("source_file"), "p_name", "p_type")
    manifest = part.where("p_partkey % 4 <> 0").select("source_file", F.md5(F.col("p_name").cast("binary")).alias("old"))
    found = part.where("p_partkey % 5 <> 0").select("source_file", F.md5(F.when(F.col("p_partkey") % 6 == 0, F.col("p_type")).otherwise(F.col("p_name")).cast("binary")).alias("new"))
    op = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("same")
    return manifest.join(found, "source_file", "full").select("source_file", op.alias("op"))


@query("""WITH changes AS (SELECT 'p' || (l_partkey % 97) AS path, CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'deleted' ELSE 'modified' END AS op FROM lineitem)
SELECT path, count(DISTINCT op) AS ops FROM changes GROUP BY path HAVING count(DISTINCT op) > 1""", also="overlapping_changes_all")
def overlapping_changes(spark: SparkSession, d: str) -> DataFrame:
    return _overlapping(T.table(spark, d, "lineitem"))


def _overlapping(lines: DataFrame) -> DataFrame:
    op = F.when(F.col("l_returnflag") == "A", "added").when(F.col("l_returnflag") == "R", "deleted").otherwise("modified")
    rows = lines.select(F.concat(F.lit("p"), F.col("l_partkey") % 97).alias("path"), op.alias("op"))
    return rows.groupBy("path").agg(F.countDistinct("op").alias("ops")).where("ops > 1")


@query("""WITH req AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'GEN' ELSE c_mktsegment END AS creator_type, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS gmv FROM customer),
state AS (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS creator_type, round(sum(o_totalprice), 2) AS gmv FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN upper(trim(req.creator_type)) IN ('', 'GEN') THEN coalesce(state.creator_type, 'GEN') ELSE req.creator_type END AS creator_type, round(coalesce(req.gmv, state.gmv), 2) AS gmv FROM req LEFT JOIN state ON o_custkey = c_custkey""")
def state_merge(spark: SparkSession, d: str) -> DataFrame:
    req = T.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "GEN").otherwise(F.col("c_mktsegment")).alias("asked"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("asked_gmv"))
    state = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("stored"), F.round(F.sum("o_totalprice"), 2).alias("stored_gmv"))
    default = F.upper(F.trim("asked")).isin("", "GEN")
    return req.join(state, "c_custkey", "left").select("c_custkey", F.when(default, F.coalesce("stored", F.lit("GEN"))).otherwise(F.col("asked")).alias("creator_type"), F.round(F.coalesce("asked_gmv", "stored_gmv"), 2).alias("gmv"))
