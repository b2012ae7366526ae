"""Contexts before rules are matched and states after a reply; catalog names; projections that bear missing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as X
from ..functions import text as S
from ..functions import values as V
from ..operators import providers as P
from ..sources import files
from ..sources import tables as T
from ..sources.requests import SQL, requests, said_sql
from .registry import query

ALLOWED = ("vip", "new", "reply_ok")
CHAIN = ("A1", "A2", "A3", "A4")


@query("""WITH t AS (SELECT c_custkey, list_filter([' VIP', CASE WHEN c_custkey % 2 = 0 THEN 'new' END, 'other', CASE WHEN c_custkey % 3 = 0 THEN 'new' END, 'vip'], lambda x: x IS NOT NULL) AS raw, CASE c_custkey % 4 WHEN 0 THEN 'Top ' WHEN 1 THEN 'gen' WHEN 2 THEN NULL ELSE 'B-level' END AS tier FROM customer),
f AS (SELECT *, list_filter(list_transform(raw, lambda x: lower(trim(x))), lambda x: list_contains(['vip', 'new', 'reply_ok'], x)) AS kept FROM t)
SELECT c_custkey, 'vip' || CASE WHEN list_contains(kept, 'new') THEN ',new' ELSE '' END AS flags, CASE WHEN tier IS NULL OR upper(trim(tier)) = 'GEN' THEN 'GEN' WHEN lower(trim(tier)) = 'top' THEN 'A-level' ELSE trim(tier) END AS tier FROM f""")
def context_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    """Contexts with tiers by their usual names and only the flags that are allowed, each once (RUL-12)."""
    k = F.col("c_custkey")
    raw = F.array_compact(F.array(F.lit(" VIP"), F.when(k % 2 == 0, "new"), F.lit("other"), F.when(k % 3 == 0, "new"), F.lit("vip")))
    flags = F.array_intersect(F.array_distinct(F.transform(raw, lambda x: F.lower(F.trim(x)))), F.array(*map(F.lit, ALLOWED)))
    tier = F.trim(F.when(k % 4 == 0, "Top ").when(k % 4 == 1, "gen").when(k % 4 == 3, "B-level"))
    usual = F.when(tier.isNull() | (F.upper(tier) == "GEN"), "GEN").when(F.lower(tier) == "top", "A-level").otherwise(tier)
    return T.table(spark, d, "customer").select(k, F.array_join(flags, ",").alias("flags"), usual.alias("tier"))


_ROUND = "CASE WHEN k % 3 = 0 THEN CAST(k % 6 AS INTEGER) WHEN k % 3 = 1 AND k % 2 = 0 THEN 2 WHEN k % 4 = 3 THEN 3 END"


@query(f"""WITH t AS (SELECT o_orderkey AS k, o_orderkey % 5 <> 0 AS head FROM orders), r AS (SELECT *, {_ROUND} AS round FROM t)
SELECT k, CASE WHEN head AND round IS NOT NULL THEN 'joined,price_negotiation_rounds=' || round WHEN k % 3 = 1 AND k % 2 = 0 THEN 'joined,negotiation_rounds=2' ELSE 'joined' END AS progress,
  CASE WHEN NOT head THEN 'vip' WHEN k % 4 = 3 AND NOT (k % 3 = 0 OR (k % 3 = 1 AND k % 2 = 0)) THEN 'vip,priority_node:A3,prev_node:A2' WHEN k % 4 = 3 THEN 'vip,priority_node:A3' || CASE WHEN round BETWEEN 2 AND 4 THEN ',prev_node:A' || (round - 1) ELSE '' END
  WHEN round BETWEEN 1 AND 4 THEN 'vip,priority_node:A' || round || CASE WHEN round > 1 THEN ',prev_node:A' || (round - 1) ELSE '' END ELSE 'vip' END AS flags FROM r""")
def negotiation_applied(spark: SparkSession, d: str) -> DataFrame:
    """Rounds and nodes of a negotiation put into progress and flags, where prices are negotiated (RUL-16, RUL-18, RUL-20)."""
    k = F.col("o_orderkey")
    tokens = F.when((k % 3 == 1) & (k % 2 == 0), F.array(F.lit("joined"), F.lit("negotiation_rounds=2"))).otherwise(F.array(F.lit("joined")))
    node = F.when(k % 4 == 3, "a3")
    state = X.negotiation_state(F.when(k % 3 == 0, (k % 6).cast("int")), node, tokens, CHAIN)
    rows = T.table(spark, d, "orders").select(k.alias("k"), (k % 5 != 0).alias("head"), tokens.alias("tokens"), state.alias("s"))
    kept = F.filter("tokens", lambda t: ~t.rlike(r"^(?:price_)?negotiation_rounds="))
    progress = F.when(F.col("head") & F.col("s.round").isNotNull(), F.array_append(kept, F.concat(F.lit(f"{X.ROUND}="), "s.round"))).otherwise(F.col("tokens"))
    nodes = F.array_compact(F.array(F.concat(F.lit("priority_node:"), "s.node"), F.concat(F.lit("prev_node:"), "s.before")))
    flags = V.merged(F.array(F.lit("vip")), F.when(F.col("head"), nodes))
    return rows.select("k", F.array_join(progress, ",").alias("progress"), F.array_join(flags, ",").alias("flags"))


@query("""WITH c AS (SELECT DISTINCT p_brand || '/' || p_name || ' of the long catalog ' || (p_size % 7) || '.xlsx' AS name FROM part), d AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN name WHEN 1 THEN replace(name, 'catalog', 'catalgo') ELSE 'none ' || p_partkey END AS declared FROM (SELECT p_partkey, p_brand || '/' || p_name || ' of the long catalog ' || (p_size % 7) || '.xlsx' AS name FROM part)),
n AS (SELECT declared, min(name) AS near FROM (SELECT declared, name FROM d JOIN c ON abs(length(declared) - length(name)) <= 4 AND 1 - CAST(levenshtein(declared, name) AS DOUBLE) / greatest(length(declared), length(name)) >= 0.95 WHERE declared NOT IN (SELECT name FROM c)) GROUP BY 1 HAVING count(*) = 1)
SELECT d.declared, coalesce(c.name, near) AS name FROM d LEFT JOIN c ON c.name = d.declared LEFT JOIN n ON n.declared = d.declared""")
def catalog_names(spark: SparkSession, d: str) -> DataFrame:
    """Declared files under the names of the catalog, typing errors too if only one name is near (JOIN-12, KB-21, UDF-06)."""
    name = F.concat("p_brand", F.lit("/"), "p_name", F.lit(" of the long catalog "), F.col("p_size") % 7, F.lit(".xlsx"))
    part = T.table(spark, d, "part").select("p_partkey", name.alias("name"))
    k = F.col("p_partkey") % 3
    said = F.when(k == 0, F.col("name")).when(k == 1, F.replace("name", F.lit("catalog"), F.lit("catalgo"))).otherwise(F.concat(F.lit("none "), "p_partkey"))
    return P.aligned_names(part.select(said.alias("declared")), part, 0.95)


@query("SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS BIGINT) AS campaign_id FROM supplier")
def missing_columns(spark: SparkSession, d: str) -> DataFrame:
    """A projection whose absent columns are null of their type (FLT-10, SRC-19)."""
    return files.with_columns(T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "id long, name string, note string, campaign_id long")


@query()
def embedding_build(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of chunks by a provider that executors call in batches (VEC-02, UDF-04); the one without a model here."""
    rows = T.table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), S.stripped(F.coalesce("text", F.lit(""))).alias("text"))
    return P.embedded(rows, P.hashed_embedder()).select("id", "embedding")


@query("SELECT request_id, CASE WHEN lower(trim(intent)) = 'ok' THEN 'interest' ELSE trim(intent) END AS intent FROM (WITH " + SQL + " SELECT * FROM said)")
def intent_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """Labels of intents with a synonym by its usual name (INT-16)."""
    low = F.lower(F.trim("intent"))
    return requests(spark, d).select("request_id", F.when(low == "ok", "interest").otherwise(F.trim("intent")).alias("intent"))


