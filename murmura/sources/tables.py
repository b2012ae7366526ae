"""Domain tables derived from the driver's tables. Each is a plain projection or aggregation, so filters reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "timestamp '2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, text): users are creators, assistants are sellers."""
    role = F.when(F.col("role") == "user", "creator").when(F.col("role") == "assistant", "seller").otherwise("system")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", role.alias("role"), "text")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, create_time, source, creator_name, message_info): a row for each conversation, with its lines in order."""
    line = F.format_string("[%d][%s] %s", "turn", "role", F.coalesce("text", F.lit("")))
    lines = messages(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return lines.select(
        F.col("conv_id").alias("id"),
        F.expr(f"{BASE} + conv_id * interval 1 hour").alias("create_time"),
        F.concat(F.lit("shop_"), F.pmod("conv_id", F.lit(5))).alias("source"),
        F.concat(F.lit("creator_"), F.pmod("conv_id", F.lit(37))).alias("creator_name"),
        F.array_join("lines.line", "\n").alias("message_info"),
    )


def keyword_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, create_time, source, creator_name, key_words)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("create_time"), F.concat(F.lit("shop_"), F.pmod("user_id", F.lit(5))).alias("source"),
        F.concat(F.lit("creator_"), F.pmod("user_id", F.lit(37))).alias("creator_name"), F.col("event_type").alias("key_words"),
    )


def all_creators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(creator_name, gmv text, tier_hint): names with spaces and capitals, as joins must normalise."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit(" Creator_"), F.col("c_custkey"), F.lit(" ")).alias("creators_name"), F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("gmv"), F.col("c_mktsegment").alias("segment"),
    )


def showcase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_name, campaign_id, product_id, status, gmv text, start_time, sample_status): order lines as showcased products."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.concat(F.lit("creator_"), F.pmod("o_custkey", F.lit(37))).alias("user_name"), F.col("l_suppkey").alias("campaign_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_returnflag").alias("status"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("gmv"), F.col("o_orderdate").alias("start_time"), F.col("l_linestatus").alias("sample_status"),
    )


def all_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(campaign_id, short_name), one row for each campaign."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("campaign_id"), F.col("p_name").alias("short_name"))


#: The same tables for DuckDB.
SQL = {
    "messages": "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'creator' WHEN 'assistant' THEN 'seller' ELSE 'system' END AS role, text FROM conversations",
    "audit_log": """SELECT conv_id AS id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) AS create_time, 'shop_' || (conv_id % 5) AS source, 'creator_' || (conv_id % 37) AS creator_name,
        string_agg('[' || turn || '][' || role || '] ' || coalesce(text, ''), chr(10) ORDER BY turn) AS message_info FROM messages GROUP BY conv_id""",
    "keyword_log": "SELECT event_id AS id, ts AS create_time, 'shop_' || (user_id % 5) AS source, 'creator_' || (user_id % 37) AS creator_name, event_type AS key_words FROM events",
    "all_creators": "SELECT ' Creator_' || c_custkey || ' ' AS creators_name, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS gmv, c_mktsegment AS segment FROM customer",
    "showcase": """SELECT 'creator_' || (o_custkey % 37) AS user_name, l_suppkey AS campaign_id, l_partkey AS product_id, l_returnflag AS status,
        CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS gmv, o_orderdate AS start_time, l_linestatus AS sample_status FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "all_products": "SELECT p_partkey AS campaign_id, p_name AS short_name FROM part",
}


def with_tables(names: str, body: str) -> str:
    """SQL with the named tables (in order of need) before a body, which may begin with further ones: `x AS (...) SELECT ...`."""
    made = [f"{n} AS ({SQL[n]})" for n in names.split()]
    body = body.strip()
    return "WITH " + ", ".join(made) + (" " if body.upper().startswith("SELECT") else ", ") + body
