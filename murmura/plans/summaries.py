"""Composite reports and requests with their stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators import summaries as S
from ..sources import tables as T
from ..sources.requests import SQL, requests
from ..sources.tables import with_tables
from .registry import query
from .reports import _EVENTS, _events

START, END = "2024-01-01 00:00:00", "2024-02-15 12:00:00"


@query(with_tables("messages audit_log keyword_log", f"""a AS (SELECT * FROM audit_log WHERE create_time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'), k AS (SELECT * FROM keyword_log WHERE create_time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'),
s AS (SELECT source, count(*) AS n FROM (SELECT trim(source) AS source FROM a UNION ALL SELECT trim(source) FROM k) WHERE source <> '' GROUP BY 1), w AS (SELECT key_words, count(*) AS n FROM k GROUP BY 1),
x AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS people, (SELECT coalesce(string_agg(source || '：' || n || '人', '，' ORDER BY n DESC, source), '无') FROM s) AS sources, (SELECT count(*) FROM a WHERE trim(creator_name) <> '' AND trim(message_info) <> '') AS replies,
  (SELECT count(*) FROM k) AS hits, (SELECT coalesce(string_agg('【' || key_words || '】触发：' || n || '人', '； ' ORDER BY n DESC, key_words), '无') FROM w) AS words)
SELECT '统计区间：2024-01-01 00:00 ~ 2024-02-15 12:00' || chr(10) || '达人问询数：' || people || '个人（' || sources || '）' || chr(10) || 'AI回复次数：' || replies || '次；' || chr(10) || '关键词回复次数：' || hits || '次（其中 ' || words || '）' || chr(10) AS plain,
  '**统计区间：** 2024-01-01 00:00 ~ 2024-02-15 12:00' || chr(10) || '**达人问询数：** ' || people || '个人（' || sources || '）' || chr(10) || '**AI回复次数：** ' || replies || '次；' || chr(10) || '**关键词回复次数：** ' || hits || '次（其中 ' || words || '）' AS markdown FROM x"""))
def daily_summary(spark: SparkSession, d: str) -> DataFrame:
    """The report of a window in one row (RPT-01, AGG-01 to AGG-04)."""
    return S.daily(T.audit_log(spark, d), T.keyword_log(spark, d), START, END)


_LINES = """said AS (SELECT trim(creator_name) AS creator, create_time, id, unnest(string_split(message_info, chr(10))) AS raw, unnest(range(0, len(string_split(message_info, chr(10))))) AS pos FROM audit_log),
cleaned AS (SELECT creator, create_time, id, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM said), once AS (SELECT creator, line, min((create_time, id, pos)) AS first_at FROM cleaned WHERE line <> '' AND NOT contains(lower(line), '[system]') GROUP BY 1, 2),
chat AS (SELECT creator, line, row_number() OVER (PARTITION BY creator ORDER BY first_at) AS position FROM once)"""


@query(with_tables("messages audit_log", _LINES + " SELECT creator, position, line FROM chat"))
def chat_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of chats in order, each once a creator (RPT-04, WIN-02, FLT-17)."""
    return S.transcripts(T.audit_log(spark, d)).withColumn("position", F.col("position").cast("long"))


@query(with_tables("messages audit_log keyword_log showcase", _EVENTS + ", " + _LINES + f""", placed AS (SELECT creator, text, row_number() OVER (PARTITION BY creator ORDER BY dt NULLS LAST, source_no, text) AS position FROM events_of),
parts AS (SELECT creator, 'history' AS part, (position - 1) // 100 AS chunk, string_agg(text, chr(10) ORDER BY position) AS text FROM placed GROUP BY 1, 3 UNION ALL SELECT creator, 'chat', (position - 1) // 100, string_agg(line, chr(10) ORDER BY position) FROM chat GROUP BY 1, 3)
SELECT a.id, p.creator, p.part, p.chunk, md5(p.text) AS text_md5 FROM audit_log a JOIN parts p ON p.creator = trim(a.creator_name) WHERE a.create_time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"""))
def audit_histories(spark: SparkSession, d: str) -> DataFrame:
    """Audit rows of a window with their creators' whole histories and chats, in chunks (RPT-02, RPT-04, JOIN-18)."""
    audit = T.audit_log(spark, d)
    found = S.with_histories(R.within(audit, START, END), R.timeline(*_events(spark, d)), S.transcripts(audit))
    return found.select("id", "creator", "part", "chunk", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_STATE = "state AS (SELECT 'creator_' || c_custkey AS creator_id, CASE c_custkey % 3 WHEN 0 THEN 'north' WHEN 1 THEN ' south ' ELSE ' ' END AS shop, CASE c_custkey % 4 WHEN 0 THEN 'GEN' ELSE 'S-level' END AS tier, CASE WHEN c_custkey % 5 = 0 THEN ['GEN'] ELSE ['joined', 'x=' || c_custkey % 7] END AS progress, CASE WHEN c_custkey % 2 = 0 THEN 'calm' END AS emotion, CAST(c_acctbal AS DOUBLE) AS sales, ['vip'] AS conditions, c_custkey % 11 = 0 AS rejected FROM customer)"


@query(f"""WITH {SQL}, {_STATE} SELECT r.request_id, r.creator_id, r.shop, CASE WHEN r.tier <> 'GEN' THEN r.tier WHEN s.tier <> 'GEN' THEN s.tier ELSE 'GEN' END AS tier, CASE WHEN r.request_id % 9 = 0 THEN 'calm2' ELSE coalesce(s.emotion, 'GEN') END AS emotion,
  array_to_string(CASE WHEN len(r.progress) > 0 THEN r.progress WHEN s.progress IS NOT NULL AND s.progress <> ['GEN'] THEN s.progress ELSE CAST([] AS VARCHAR[]) END, ',') AS progress, coalesce(r.sales, s.sales) AS sales, CASE WHEN r.request_id % 4 = 0 THEN 'given' ELSE coalesce(array_to_string(s.conditions, ','), '') END AS conditions, coalesce(s.rejected, false) AS rejected
FROM requests r LEFT JOIN state s ON s.creator_id = r.creator_id AND trim(s.shop) = r.shop""")
def request_states(spark: SparkSession, d: str) -> DataFrame:
    """Requests with stored fields where they leave them open (JOIN-08, RUL-13, SRC-21)."""
    c, k = F.col("c_custkey"), F.col("request_id")
    state = T.table(spark, d, "customer").select(
        F.concat(F.lit("creator_"), c).alias("creator_id"), F.when(c % 3 == 0, "north").when(c % 3 == 1, " south ").otherwise(" ").alias("shop"), F.when(c % 4 == 0, "GEN").otherwise("S-level").alias("tier"),
        F.when(c % 5 == 0, F.array(F.lit("GEN"))).otherwise(F.array(F.lit("joined"), F.concat(F.lit("x="), c % 7))).alias("progress"), F.when(c % 2 == 0, "calm").alias("emotion"), F.col("c_acctbal").cast("double").alias("sales"),
        F.array(F.lit("vip")).alias("conditions"), (c % 11 == 0).alias("rejected"),
    )
    asked = requests(spark, d).select("request_id", "creator_id", "shop", "tier", "progress", F.when(k % 9 == 0, "calm2").otherwise("GEN").alias("emotion"), "sales", F.when(k % 4 == 0, F.array(F.lit("given"))).alias("conditions"))
    made = S.with_state(asked, state)
    return made.select("request_id", "creator_id", "shop", "tier", "emotion", F.array_join("progress", ",").alias("progress"), "sales", F.array_join("conditions", ",").alias("conditions"), "rejected")
