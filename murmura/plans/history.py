"""Whole histories of creators from seven sources, and what they are joined from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import reports as R
from ..sources import tables as T
from ..sources.tables import with_tables
from .registry import query

#: Portal events of a creator that a history shows, the oldest.
PORTAL_EVENTS = 10

_TABLES = """replies AS (SELECT 'user_' || conv_id AS creator, TIMESTAMP '2024-01-01' + to_hours(conv_id) AS dt, 'reply ' || conv_id AS text, 1 AS source_no FROM (SELECT DISTINCT conv_id FROM conversations)),
keywords AS (SELECT 'user_' || user_id AS creator, ts AS dt, 'keyword ' || event_type || ' ' || event_id AS text, 2 AS source_no FROM events),
signups AS (SELECT 'USER_' || s_suppkey AS handle, CASE WHEN s_suppkey % 7 <> 0 THEN TIMESTAMP '2023-06-01' + to_days(CAST(s_suppkey % 300 AS INTEGER)) END AS since FROM supplier),
terms AS (SELECT 'User_' || c_custkey AS handle, TIMESTAMP '2023-01-01' + to_hours(c_custkey) AS starts, CASE WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '2025-01-01' END AS ends FROM customer),
shown AS (SELECT 'user_' || o_custkey AS creator, o_orderdate AS dt, l_suppkey AS campaign, l_partkey AS product, l_returnflag AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ids AS (SELECT handle, min(id) AS id FROM (SELECT 'user_' || (c_custkey % 100) AS handle, c_custkey AS id FROM customer) GROUP BY 1),
videos AS (SELECT o_custkey AS owner, o_orderdate AS dt, 'video ' || o_orderpriority AS text FROM orders WHERE o_orderstatus = 'F'),
portal AS (SELECT 'user_' || user_id AS creator, ts AS dt, 'portal ' || event_type AS text, event_id FROM events WHERE event_type <> 'click')"""


def _name(column: str, word: str = "user_") -> Column:
    return F.concat(F.lit(word), F.col(column))


def events(spark: SparkSession, d: str) -> list[DataFrame]:
    """(creator, dt, text, source_no) of replies, keywords, two kinds of signup, showcases, videos and portal events."""
    row = lambda df, creator, dt, text, n: df.select(creator.alias("creator"), dt.alias("dt"), text.alias("text"), F.lit(n).alias("source_no"))
    talks = T.table(spark, d, "conversations").select("conv_id").distinct()
    keys = T.table(spark, d, "events")
    base = lambda day, n: F.expr(f"timestamp '{day}' + make_dt_interval({n})")
    signed = T.table(spark, d, "supplier").where("s_suppkey % 7 <> 0").select(_name("s_suppkey", "USER_").alias("handle"), base("2023-06-01", "cast(s_suppkey % 300 as int)").alias("at"))
    terms = T.table(spark, d, "customer").select(_name("c_custkey", "User_").alias("handle"), F.expr("timestamp '2023-01-01' + c_custkey * interval 1 hour").alias("starts"), F.when(F.col("c_custkey") % 3 != 0, F.lit("2025-01-01 00:00:00")).alias("ends"))
    lines, orders = T.table(spark, d, "lineitem"), T.table(spark, d, "orders")
    # the first event of a key counts; all columns that are shown are in the key, and text is made last, as it is longer
    shown = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("o_custkey", "l_suppkey", "l_partkey", "l_returnflag").agg(F.min("o_orderdate").alias("dt"))
    shown = shown.select(_name("o_custkey").alias("creator"), "dt", F.concat_ws(" ", F.lit("showcase"), "l_suppkey", "l_partkey", "l_returnflag").alias("text"))
    ids = T.table(spark, d, "customer").groupBy(F.concat(F.lit("user_"), F.col("c_custkey") % 100).alias("handle")).agg(F.min("c_custkey").alias("id"))
    videos = orders.where("o_orderstatus = 'F'").join(ids, F.col("o_custkey") == F.col("id")).select("handle", F.col("o_orderdate").alias("dt"), F.concat(F.lit("video "), "o_orderpriority").alias("text")).distinct()
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    portal = keys.where("event_type <> 'click'").withColumn("place", place).where(F.col("place") <= PORTAL_EVENTS)
    return [
        row(talks, _name("conv_id"), F.expr("timestamp '2024-01-01' + conv_id * interval 1 hour"), F.concat(F.lit("reply "), "conv_id"), 1),
        row(keys, _name("user_id"), F.col("ts"), F.concat(F.lit("keyword "), "event_type", F.lit(" "), "event_id"), 2),
        row(signed, F.lower("handle"), F.col("at"), F.lit("signed"), 3),
        row(terms, F.lower("handle"), F.col("starts"), F.concat(F.lit("terms"), F.coalesce(F.concat(F.lit(" until "), "ends"), F.lit(""))), 4),
        row(shown, F.col("creator"), F.col("dt"), F.col("text"), 5),
        row(videos, F.col("handle"), F.col("dt"), F.col("text"), 6),
        row(portal, _name("user_id"), F.col("ts"), F.concat(F.lit("portal "), "event_type"), 7),
    ]


_ALL = "WITH " + _TABLES + """, all_events AS (
  SELECT creator, dt, text, source_no FROM replies UNION ALL SELECT creator, dt, text, source_no FROM keywords
  UNION ALL SELECT lower(handle), since, 'signed', 3 FROM signups WHERE since IS NOT NULL
  UNION ALL SELECT lower(handle), starts, 'terms' || CASE WHEN ends IS NULL THEN '' ELSE ' until 2025-01-01 00:00:00' END, 4 FROM terms
  UNION ALL SELECT creator, min(dt), 'showcase ' || campaign || ' ' || product || ' ' || status, 5 FROM shown GROUP BY creator, campaign, product, status
  UNION ALL (SELECT DISTINCT handle, dt, text, 6 FROM videos JOIN ids ON id = owner)
  UNION ALL SELECT creator, dt, text, 7 FROM (SELECT *, row_number() OVER (PARTITION BY creator ORDER BY dt, event_id) AS p FROM portal) WHERE p <= 10) """


@query(_ALL + "SELECT creator, dt, text, source_no, row_number() OVER (PARTITION BY creator ORDER BY dt NULLS LAST, source_no, text) AS position FROM all_events")
def history_seven_sources(spark: SparkSession, d: str) -> DataFrame:
    """Every event of every creator in order (SET-01, RPT-03, JOIN-05, JOIN-06, FLT-04, FLT-16, WIN-03, WIN-04)."""
    return R.timeline(*events(spark, d)).withColumn("position", F.col("position").cast("long"))


@query(_ALL + ", sums AS (SELECT creator, count(*) AS n, count(DISTINCT source_no) AS sources, min(dt) AS first, max(dt) AS last FROM all_events GROUP BY creator) SELECT *, n >= 100 AS long FROM sums")
def history_summary(spark: SparkSession, d: str) -> DataFrame:
    """How much is known of each creator, and from how many sources (AGG-17)."""
    first, *others = events(spark, d)
    for o in others:
        first = first.unionByName(o)
    return first.groupBy("creator").agg(F.count("*").alias("n"), F.countDistinct("source_no").alias("sources"), F.min("dt").alias("first"), F.max("dt").alias("last")).withColumn("long", F.col("n") >= 100)


@query(with_tables("messages audit_log keyword_log", """a AS (SELECT source, count(*) AS replies, count(DISTINCT creator_name) AS creators, count(*) FILTER (WHERE id % 4 = 0) AS handed FROM audit_log GROUP BY 1), k AS (SELECT source, count(*) AS keywords FROM keyword_log GROUP BY 1),
u AS (SELECT source, count(DISTINCT creator_name) AS people FROM (SELECT source, creator_name FROM audit_log UNION SELECT source, creator_name FROM keyword_log) GROUP BY 1)
SELECT source, '## ' || source || chr(10) || '- creators: ' || people || chr(10) || '- replies: ' || coalesce(replies, 0) || ' (' || coalesce(handed, 0) || ' handed over)' || chr(10) || '- keywords: ' || coalesce(keywords, 0) AS markdown FROM u LEFT JOIN a USING (source) LEFT JOIN k USING (source)"""))
def shop_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The summary of each shop as Markdown (RPT-07, AGG-07)."""
    audit, keys = T.audit_log(spark, d).select("source", "creator_name", (F.col("id") % 4 == 0).alias("handed"), F.lit(True).alias("reply")), T.keyword_log(spark, d).select("source", "creator_name", F.lit(False).alias("handed"), F.lit(False).alias("reply"))
    sums = audit.unionByName(keys).groupBy("source").agg(F.countDistinct("creator_name").alias("people"), F.count_if("reply").alias("replies"), F.count_if("handed").alias("handed"), F.count_if(~F.col("reply")).alias("keywords"))
    return sums.select("source", F.format_string("## %s\n- creators: %d\n- replies: %d (%d handed over)\n- keywords: %d", "source", "people", "replies", "handed", "keywords").alias("markdown"))
