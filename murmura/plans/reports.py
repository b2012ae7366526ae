"""Report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import reports as R
from ..sources import tables as T
from ..sources.tables import with_tables
from .registry import query

START, END = "2024-01-02 16:30:00", "2024-01-06 12:00:00"
LOG_START, LOG_END = "2024-01-01 00:00:00", "2024-01-15 00:00:00"
_WINDOW = f"create_time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"
_LOG_WINDOW = f"create_time BETWEEN TIMESTAMP '{LOG_START}' AND TIMESTAMP '{LOG_END}'"


@query(with_tables("messages audit_log", f"SELECT count(*) AS n FROM audit_log WHERE {_WINDOW} AND trim(creator_name) <> '' AND trim(message_info) <> ''"))
def count_in_window(spark: SparkSession, d: str) -> DataFrame:
    rows = R.within(T.audit_log(spark, d), START, END)
    return rows.where(R.present("creator_name") & R.present("message_info")).agg(F.count("*").alias("n"))


@query(with_tables("messages audit_log", f"SELECT coalesce(nullif(trim(source), ''), '(none)') AS source, count(*) AS n FROM audit_log WHERE {_WINDOW} GROUP BY 1"))
def count_by_source(spark: SparkSession, d: str) -> DataFrame:
    return R.counts_by(R.within(T.audit_log(spark, d), START, END), "source", "(none)")


@query(with_tables("keyword_log", f"SELECT key_words, count(*) AS n FROM keyword_log WHERE {_LOG_WINDOW} GROUP BY 1"))
def count_by_keyword(spark: SparkSession, d: str) -> DataFrame:
    return R.counts_by(R.within(T.keyword_log(spark, d), LOG_START, LOG_END), "key_words")


@query(with_tables("messages audit_log keyword_log", """both_logs AS (
  SELECT source, count(*) AS n FROM audit_log GROUP BY 1 UNION ALL SELECT source, count(*) FROM keyword_log GROUP BY 1
), sums AS (SELECT source, CAST(sum(n) AS BIGINT) AS n FROM both_logs GROUP BY 1)
SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS place FROM sums"""))
def merge_source_counts(spark: SparkSession, d: str) -> DataFrame:
    sums = R.merged_counts(R.counts_by(T.audit_log(spark, d), "source"), R.counts_by(T.keyword_log(spark, d), "source"))
    # one row for each source: small enough for a single window
    return sums.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "source")).cast("long"))


@query(with_tables("keyword_log", "SELECT key_words, count(*) AS n, count(DISTINCT creator_name) AS creators FROM keyword_log GROUP BY 1"))
def keyword_distinct(spark: SparkSession, d: str) -> DataFrame:
    return T.keyword_log(spark, d).groupBy("key_words").agg(F.count("*").alias("n"), F.countDistinct("creator_name").alias("creators"))


_SHOWCASE = """shown AS (
  SELECT lower(trim(user_name)) AS user_name, campaign_id, max(CASE WHEN status = 'A' THEN 1 ELSE 0 END) AS is_open, count(*) AS n, max(gmv) AS gmv,
    string_agg(DISTINCT CAST(product_id AS VARCHAR), ',' ORDER BY CAST(product_id AS VARCHAR)) AS products FROM showcase GROUP BY 1, 2
)"""


@query(with_tables("showcase all_creators", _SHOWCASE + " SELECT s.user_name, s.campaign_id, s.is_open, s.n, s.gmv, s.products, c.gmv AS creator_gmv, c.segment FROM shown s LEFT JOIN all_creators c ON lower(trim(c.creators_name)) = s.user_name"), also="showcase_enrich_all")
def showcase_enrich(spark: SparkSession, d: str) -> DataFrame:
    return _showcase_enrich(spark, d, T.all_creators(spark, d))


def _showcase_enrich(spark: SparkSession, d: str, creators: DataFrame) -> DataFrame:
    shown = R.enriched_showcase(T.showcase(spark, d))
    dim = creators.select(R.same_name("creators_name").alias("user_name"), F.col("gmv").alias("creator_gmv"), "segment")
    return shown.join(dim, "user_name", "left").select("user_name", "campaign_id", "is_open", "n", "gmv", "products", "creator_gmv", "segment")


@query(with_tables("messages audit_log keyword_log", "SELECT creator_name FROM audit_log UNION SELECT creator_name FROM keyword_log"))
def creator_union(spark: SparkSession, d: str) -> DataFrame:
    return T.audit_log(spark, d).select("creator_name").union(T.keyword_log(spark, d).select("creator_name")).distinct()


@query(with_tables("messages audit_log all_creators", """SELECT a.creator_name, count(*) AS n, max(create_time) AS latest FROM audit_log a
WHERE NOT EXISTS (SELECT 1 FROM all_creators c WHERE lower(trim(c.creators_name)) = lower(trim(a.creator_name))) GROUP BY 1"""), also="missing_dim_all")
def missing_dim(spark: SparkSession, d: str) -> DataFrame:
    return _missing_dim(spark, d, T.all_creators(spark, d))


def _missing_dim(spark: SparkSession, d: str, creators: DataFrame) -> DataFrame:
    dim = creators.select(R.same_name("creators_name").alias("k"))
    rows = T.audit_log(spark, d).withColumn("k", R.same_name("creator_name"))
    return rows.join(dim, "k", "left_anti").groupBy("creator_name").agg(F.count("*").alias("n"), F.max("create_time").alias("latest"))


_EVENTS = """events_of AS (
  SELECT creator_name AS creator, create_time AS dt, 'reply ' || id AS text, 1 AS source_no FROM audit_log
  UNION ALL SELECT creator_name, create_time, 'keyword ' || key_words || ' ' || id, 2 FROM keyword_log
  UNION ALL SELECT user_name, start_time, 'showcase ' || campaign_id || '/' || product_id, 3 FROM (SELECT DISTINCT user_name, start_time, campaign_id, product_id FROM showcase WHERE status = 'R')
  UNION ALL SELECT user_name, NULL, 'sample ' || campaign_id, 4 FROM (SELECT DISTINCT user_name, campaign_id FROM showcase WHERE sample_status = 'F')
)"""


def _events(spark: SparkSession, d: str) -> list[DataFrame]:
    """Events of four sources: replies, keywords, showcases, samples."""
    audit, keys, show = T.audit_log(spark, d), T.keyword_log(spark, d), T.showcase(spark, d)
    samples = show.where("sample_status = 'F'")
    return [
        audit.select(F.col("creator_name").alias("creator"), F.col("create_time").alias("dt"), F.concat(F.lit("reply "), "id").alias("text"), F.lit(1).alias("source_no")),
        keys.select(F.col("creator_name").alias("creator"), F.col("create_time").alias("dt"), F.concat(F.lit("keyword "), "key_words", F.lit(" "), "id").alias("text"), F.lit(2).alias("source_no")),
        show.where("status = 'R'").select("user_name", "start_time", "campaign_id", "product_id").distinct().select(F.col("user_name").alias("creator"), F.col("start_time").alias("dt"), F.concat(F.lit("showcase "), "campaign_id", F.lit("/"), "product_id").alias("text"), F.lit(3).alias("source_no")),
        samples.select("user_name", "campaign_id").distinct().select(F.col("user_name").alias("creator"), F.lit(None).cast("timestamp").alias("dt"), F.concat(F.lit("sample "), "campaign_id").alias("text"), F.lit(4).alias("source_no")),
    ]


@query(with_tables("messages audit_log keyword_log showcase", _EVENTS + " SELECT creator, dt, text, source_no, row_number() OVER (PARTITION BY creator ORDER BY dt NULLS LAST, source_no, text) AS position FROM events_of"), also="history_timeline_all")
def history_timeline(spark: SparkSession, d: str) -> DataFrame:
    return R.timeline(*_events(spark, d)).withColumn("position", F.col("position").cast("long"))


@query(with_tables("messages audit_log keyword_log showcase", _EVENTS + """, placed AS (
  SELECT creator, text, row_number() OVER (PARTITION BY creator ORDER BY dt NULLS LAST, source_no, text) AS position FROM events_of
) SELECT creator, string_agg(text, chr(10) ORDER BY position) AS history FROM placed GROUP BY creator"""), also="history_text_all")
def history_text(spark: SparkSession, d: str) -> DataFrame:
    return R.joined_lines(R.timeline(*_events(spark, d)), ["creator"], "position", F.col("text"), "history")


@query(with_tables("messages audit_log keyword_log showcase", _EVENTS + """, placed AS (
  SELECT creator, text, row_number() OVER (PARTITION BY creator ORDER BY dt NULLS LAST, source_no, text) AS position FROM events_of
) SELECT creator, (position - 1) // 100 AS chunk, string_agg(text, chr(10) ORDER BY position) AS history FROM placed GROUP BY 1, 2"""))
def history_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The whole histories in rows of 100 events, as a creator's may be too long for one row."""
    return R.chunked_lines(R.timeline(*_events(spark, d)), ["creator"], "position", F.col("text"), 100, "history")


@query(with_tables("showcase all_products", """videos AS (SELECT DISTINCT user_name, campaign_id FROM showcase WHERE status = 'N'), seen AS (SELECT user_name, campaign_id, product_id, start_time FROM showcase WHERE status = 'A')
SELECT v.user_name, v.campaign_id, s.product_id, min(s.start_time) AS first_time, count(*) AS n, min(coalesce(m.short_name, CAST(s.product_id AS VARCHAR))) AS product
FROM videos v JOIN seen s ON v.user_name = s.user_name AND v.campaign_id = s.campaign_id LEFT JOIN all_products m ON m.campaign_id = s.product_id GROUP BY 1, 2, 3"""), also="tap_video_join_all")
def tap_video_join(spark: SparkSession, d: str) -> DataFrame:
    return _tap_video_join(spark, d, T.all_products(spark, d))


def _tap_video_join(spark: SparkSession, d: str, product_map: DataFrame) -> DataFrame:
    show = T.showcase(spark, d)
    videos = show.where("status = 'N'").select("user_name", "campaign_id").distinct()
    seen = show.where("status = 'A'").select("user_name", "campaign_id", "product_id", "start_time")
    names = product_map.select(F.col("campaign_id").alias("product_id"), "short_name")
    rows = videos.join(seen, ["user_name", "campaign_id"]).join(names, "product_id", "left")
    return rows.groupBy("user_name", "campaign_id", "product_id").agg(F.min("start_time").alias("first_time"), F.count("*").alias("n"), F.min(F.coalesce("short_name", F.col("product_id").cast("string"))).alias("product"))


@query(with_tables("showcase all_products", """SELECT s.user_name, s.campaign_id, coalesce(m.short_name, 'campaign ' || s.campaign_id) AS product, count(*) AS n
FROM showcase s LEFT JOIN all_products m ON m.campaign_id = s.campaign_id GROUP BY 1, 2, 3"""), also="product_map_left_all")
def product_map_left(spark: SparkSession, d: str) -> DataFrame:
    return _product_map_left(spark, d, T.all_products(spark, d))


def _product_map_left(spark: SparkSession, d: str, product_map: DataFrame) -> DataFrame:
    rows = T.showcase(spark, d).groupBy("user_name", "campaign_id").agg(F.count("*").alias("n"))  # fewer rows before the join
    return rows.join(product_map, "campaign_id", "left").select("user_name", "campaign_id", F.coalesce("short_name", F.concat(F.lit("campaign "), "campaign_id")).alias("product"), "n")


@query(with_tables("messages audit_log", r"""keyed AS (
  SELECT id, source, creator_name, create_time, len(regexp_extract_all(message_info, '\[creator')) AS lines FROM audit_log
), placed AS (SELECT *, row_number() OVER (PARTITION BY trim(source), trim(creator_name), lines ORDER BY create_time, id) AS k FROM keyed)
SELECT id, source, creator_name, CAST(lines AS BIGINT) AS lines, create_time FROM placed WHERE k = 1"""))
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    lines = F.regexp_count("message_info", F.lit(r"\[creator")).cast("long")
    rows = T.audit_log(spark, d).select("id", "source", "creator_name", lines.alias("lines"), "create_time")
    return R.keep_first(rows, [F.trim("source"), F.trim("creator_name"), "lines"], ["create_time", "id"])


@query(with_tables("messages audit_log", r"""keyed AS (
  SELECT id, row_number() OVER (PARTITION BY trim(source), trim(creator_name), len(regexp_extract_all(message_info, '\[creator')) ORDER BY create_time, id) AS k FROM audit_log
) SELECT count(*) AS scanned, count(*) FILTER (WHERE k = 1) AS kept, count(*) FILTER (WHERE k > 1) AS to_delete FROM keyed"""))
def dedup_dry_run(spark: SparkSession, d: str) -> DataFrame:
    groups = T.audit_log(spark, d).groupBy(F.trim("source"), F.trim("creator_name"), F.regexp_count("message_info", F.lit(r"\[creator"))).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("scanned"), F.count("*").alias("kept"), (F.sum("n") - F.count("*")).alias("to_delete"))


@query(with_tables("messages audit_log", """lines AS (
  SELECT creator_name, create_time, id, unnest(string_split(message_info, chr(10))) AS line, unnest(range(0, len(string_split(message_info, chr(10))))) AS pos FROM audit_log
), firsts AS (SELECT *, row_number() OVER (PARTITION BY creator_name, line ORDER BY create_time, id, pos) AS k FROM lines WHERE trim(line) <> '' AND NOT contains(line, '[system]'))
SELECT creator_name, id, pos, line FROM firsts WHERE k = 1"""))
def line_dedup(spark: SparkSession, d: str) -> DataFrame:
    lines = T.audit_log(spark, d).select("creator_name", "create_time", "id", F.posexplode(F.split("message_info", "\n")).alias("pos", "line"))
    lines = lines.where(R.present("line") & ~F.contains("line", F.lit("[system]")))
    first = lines.groupBy("creator_name", "line").agg(F.min(F.struct("create_time", "id", "pos")).alias("f"))  # combined before the shuffle
    return first.select("creator_name", F.col("f.id").alias("id"), F.col("f.pos").cast("long").alias("pos"), "line")


@query(with_tables("messages", "SELECT conv_id, arg_max(text, turn) AS text FROM messages WHERE role = 'creator' AND trim(text) <> '' GROUP BY conv_id"))
def latest_creator_msg(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(T.messages(spark, d).where((F.col("role") == "creator") & R.present("text")), ["conv_id"], "turn", "text")


@query(with_tables("messages", """placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM messages),
texts AS (SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn) AS t FROM placed WHERE n <= 3 GROUP BY conv_id)
SELECT conv_id, CASE WHEN length(t) > 500 THEN right(t, 500) ELSE t END AS text FROM texts"""))
def tail_context(spark: SparkSession, d: str) -> DataFrame:
    return R.tail_text(T.messages(spark, d), 3, 500)


@query(with_tables("messages", """SELECT conv_id, count(*) FILTER (WHERE role = 'creator') AS creator_lines, count(*) FILTER (WHERE role = 'seller') AS seller_lines,
CASE WHEN count(*) FILTER (WHERE role = 'seller') = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE role = 'creator') / count(*) FILTER (WHERE role = 'seller'), 6) END AS ratio FROM messages GROUP BY conv_id"""))
def reply_frequency(spark: SparkSession, d: str) -> DataFrame:
    counts = T.messages(spark, d).groupBy("conv_id").agg(F.count_if(F.col("role") == "creator").alias("creator_lines"), F.count_if(F.col("role") == "seller").alias("seller_lines"))
    return counts.withColumn("ratio", F.when(F.col("seller_lines") == 0, 0.0).otherwise(F.round(F.try_divide("creator_lines", "seller_lines"), 6)))


@query(with_tables("messages", """firsts AS (SELECT conv_id, role, min(turn) AS t FROM messages GROUP BY 1, 2)
SELECT conv_id, string_agg(role, ',' ORDER BY t, role) AS participants FROM firsts GROUP BY 1"""))
def participants(spark: SparkSession, d: str) -> DataFrame:
    return R.participants(T.messages(spark, d))


@query(with_tables("keyword_log", "SELECT source, id, (row_number() OVER (PARTITION BY source ORDER BY create_time DESC, id) - 1) // 500 AS part FROM keyword_log"))
def part_paging(spark: SparkSession, d: str) -> DataFrame:
    return R.paged(T.keyword_log(spark, d), ["source"], [F.desc("create_time"), F.col("id")], 500).select("source", "id", "part")


@query(with_tables("messages audit_log", "SELECT id, source, creator_name, create_time FROM audit_log ORDER BY create_time DESC, id LIMIT 50"))
def newest_first(spark: SparkSession, d: str) -> DataFrame:
    return T.audit_log(spark, d).select("id", "source", "creator_name", "create_time").orderBy(F.desc("create_time"), "id").limit(50)


_WEEK = """CAST(date_trunc('day', create_time) AS TIMESTAMP) - to_days(CAST(dayofweek(create_time) AS INTEGER)) + INTERVAL '16 hours 30 minutes'"""


@query(with_tables("keyword_log", f"""starts AS (SELECT create_time, {_WEEK} AS s FROM keyword_log)
SELECT CASE WHEN create_time < s THEN s - INTERVAL 7 DAY ELSE s END AS week, count(*) AS n FROM starts GROUP BY 1"""))
def week_bucket(spark: SparkSession, d: str) -> DataFrame:
    return T.keyword_log(spark, d).groupBy(R.week_start(F.col("create_time")).alias("week")).agg(F.count("*").alias("n"))


@query(with_tables("keyword_log", f"""starts AS (SELECT create_time, {_WEEK} AS s FROM keyword_log)
SELECT CASE WHEN dayofweek(create_time) = 0 THEN s - INTERVAL 7 DAY ELSE s END AS week, count(*) AS n FROM starts GROUP BY 1"""))
def week_bucket_b(spark: SparkSession, d: str) -> DataFrame:
    return T.keyword_log(spark, d).groupBy(R.week_start(F.col("create_time"), sunday_belongs_back=True).alias("week")).agg(F.count("*").alias("n"))


@query(with_tables("messages audit_log keyword_log", f"""a AS (SELECT count(*) AS n FROM audit_log WHERE {_WINDOW}), k AS (SELECT key_words, count(*) AS n FROM keyword_log WHERE {_LOG_WINDOW} GROUP BY 1)
SELECT 'replies: ' || (SELECT n FROM a) AS line, 0 AS place UNION ALL SELECT '- ' || key_words || ': ' || n, CAST(row_number() OVER (ORDER BY n DESC, key_words) AS INTEGER) FROM k"""))
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    total = R.within(T.audit_log(spark, d), START, END).agg(F.concat(F.lit("replies: "), F.count("*")).alias("line"), F.lit(0).alias("place"))
    keys = R.counts_by(R.within(T.keyword_log(spark, d), LOG_START, LOG_END), "key_words")  # one row for each keyword
    placed = R.numbered(keys, [], [F.desc("n"), F.col("key_words").asc()], "place")
    return total.union(placed.select(F.concat(F.lit("- "), "key_words", F.lit(": "), "n"), F.col("place").cast("int")))


@query(with_tables("messages audit_log", r"""SELECT id, source, substr(creator_name, 1, 128) AS creator_name, substr(message_info, 1, 512) AS message_input,
CASE WHEN length(message_info) > 255 THEN substr(message_info, 1, 254) || '…' ELSE message_info END AS preview, epoch_ms(create_time) AS created_ms, strftime(create_time, '%Y-%m-%d %H:%M:%S') AS created FROM audit_log"""))
def audit_projection(spark: SparkSession, d: str) -> DataFrame:
    preview = F.when(F.length("message_info") > 255, F.concat(F.substring("message_info", 1, 254), F.lit("…"))).otherwise(F.col("message_info"))
    return T.audit_log(spark, d).select(
        "id", "source", F.substring("creator_name", 1, 128).alias("creator_name"), F.substring("message_info", 1, 512).alias("message_input"),
        preview.alias("preview"), F.unix_millis("create_time").alias("created_ms"), F.date_format("create_time", "yyyy-MM-dd HH:mm:ss").alias("created"),
    )
