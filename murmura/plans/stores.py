"""Queries over readers and sinks: tables are written to the session's checkpoint folder, read back, and returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as X
from ..functions import text as S
from ..session import checkpoint_dir
from ..sources import files, sinks
from ..sources import tables as T
from ..sources.tables import with_tables
from .registry import query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/murmura-{name}-{uuid.uuid4().hex}"


@query("""WITH old AS (SELECT 'f' || p_partkey AS source_file, md5(p_name) AS checksum, CAST(p_size AS BIGINT) AS chunks, TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 9 AS INTEGER)) AS built_at FROM part),
new AS (SELECT 'f' || (p_partkey + 1) AS source_file, md5(p_type) AS checksum, CAST(p_size + 1 AS BIGINT) AS chunks, TIMESTAMP '2024-01-01' + to_days(CAST((p_partkey + 1) % 9 + p_partkey % 3 - 1 AS INTEGER)) AS built_at FROM part),
either AS (SELECT *, 0 AS n FROM old UNION ALL SELECT *, 1 FROM new), best AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY built_at DESC, n DESC) AS place FROM either)
SELECT source_file, checksum, chunks, built_at FROM best WHERE place = 1 AND source_file NOT IN (SELECT 'f' || p_partkey FROM part WHERE p_size > 45)""")
def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Entries merged into a manifest, the latest of a file, then entries removed (SNK-04, SRC-11)."""
    part, day = T.table(spark, d, "part"), lambda n: F.expr(f"timestamp '2024-01-01' + make_dt_interval(cast({n} as int))")
    entry = lambda key, text, n, at: part.select(F.concat(F.lit("f"), key).alias("source_file"), F.md5(F.col(text).cast("binary")).alias("checksum"), n.cast("long").alias("chunks"), day(at).alias("built_at"))
    table = sinks.Table(spark, _folder(spark, "manifest"), files.MANIFEST)
    table.replace(entry(F.col("p_partkey"), "p_name", F.col("p_size"), "p_partkey % 9"))
    sinks.upsert(table, entry(F.col("p_partkey") + 1, "p_type", F.col("p_size") + 1, "(p_partkey + 1) % 9 + p_partkey % 3 - 1"), ["source_file"], "built_at")
    sinks.delete(table, part.where("p_size > 45").select(F.concat(F.lit("f"), "p_partkey").alias("source_file")), "source_file")
    return table.read()


@query("""WITH v AS (SELECT 'v' || vec_id AS id, 'file' || (vec_id % 7) AS source_file, label FROM embeddings)
SELECT id, source_file, CAST(label AS VARCHAR) || CASE WHEN id IN (SELECT 'v' || vec_id FROM embeddings WHERE label % 2 = 0) THEN '*' ELSE '' END AS document, 64 AS n FROM v WHERE source_file <> 'file3'""".replace("64 AS n", "CAST((SELECT max(len(embedding)) FROM embeddings) AS INTEGER) AS n"))
def vector_store(spark: SparkSession, d: str) -> DataFrame:
    """Vectors added, added again under the same ids, and removed by source (SNK-05, SNK-06, SNK-07, VEC-06, VEC-07)."""
    rows = T.table(spark, d, "embeddings").select(
        F.concat(F.lit("v"), "vec_id").alias("id"), F.concat(F.lit("file"), F.col("vec_id") % 7).alias("source_file"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("document"), (F.col("label") % 2 == 0).alias("even"),
    )
    table = sinks.Table(spark, _folder(spark, "vectors"), files.VECTOR)
    sinks.add_vectors(table, rows)
    sinks.reset(table)
    sinks.add_vectors(table, rows)
    sinks.add_vectors(table, rows.where("even").withColumn("document", F.concat("document", F.lit("*"))))
    sinks.delete(table, spark.createDataFrame([("file3",)], "source_file string"), "source_file")
    table.drop_old(1)
    return table.read().select("id", "source_file", "document", F.size("embedding").alias("n"))


@query("""SELECT DISTINCT trim(CASE vec_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' a ' WHEN 2 THEN 'a' WHEN 3 THEN 'b' || label END) AS source_file FROM embeddings WHERE trim(CASE vec_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' a ' WHEN 2 THEN 'a' WHEN 3 THEN 'b' || label END) <> ''""")
def vector_sources(spark: SparkSession, d: str) -> DataFrame:
    """Source files that an index names (SRC-16)."""
    name = F.trim(F.expr("CASE vec_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' a ' WHEN 2 THEN 'a' WHEN 3 THEN concat('b', label) END"))
    return T.table(spark, d, "embeddings").select(name.alias("source_file")).where("source_file <> ''").distinct()


@query("SELECT vec_id, label, (SELECT count(*) FROM embeddings) AS total FROM embeddings WHERE vec_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def vector_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of given ids, with the size of the index (SRC-17)."""
    rows, asked = T.table(spark, d, "embeddings"), T.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("vec_id"))
    return rows.join(asked, "vec_id", "left_semi").select("vec_id", "label").crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


@query("""WITH u AS (SELECT o_custkey AS k, max(CAST(o_totalprice AS DECIMAL(18,2))) AS q, max(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS s FROM orders GROUP BY 1)
SELECT c_custkey, CAST(coalesce(q, CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS quote, coalesce(s, c_mktsegment) AS segment, c_name FROM customer LEFT JOIN u ON k = c_custkey""")
def column_update(spark: SparkSession, d: str) -> DataFrame:
    """Columns of creators set where an update has a value (SNK-11, RPL-16, RUL-19)."""
    rows = T.table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(18,2)").alias("quote"), F.col("c_mktsegment").alias("segment"), "c_name")
    new = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_totalprice").cast("decimal(18,2)")).alias("quote"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("segment"))
    return sinks.column_updates(rows, new, "c_custkey").withColumn("quote", F.col("quote").cast("double"))


@query(with_tables("messages audit_log", """SELECT id, date_trunc('second', create_time + INTERVAL 250 MILLISECOND) AS create_time, substr(message_info, 1, 40) AS message_info, substr(trim(concat_ws(' ', CASE WHEN id % 2 = 0 THEN source END, CASE WHEN id % 3 <> 0 THEN '[campaign_id=' || id || ']' END)), 1, 30) AS comment FROM audit_log"""))
def audit_insert(spark: SparkSession, d: str) -> DataFrame:
    """Audit rows as they are stored, appended and read back (SNK-12)."""
    rows = T.audit_log(spark, d).select(
        "id", (F.col("create_time") + F.expr("interval 0.25 second")).alias("create_time"), "message_info", F.when(F.col("id") % 2 == 0, F.col("source")).alias("comment"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("campaign_id"),
    )
    made, at = sinks.audit_rows(rows, {"message_info": 40, "comment": 30}), _folder(spark, "audit")
    for half in (0, 1):
        made.where(F.col("id") % 2 == half).write.mode("append").parquet(at)
    return spark.read.schema(made.schema).parquet(at)


_REQUEST_SQL = "CASE o_orderkey % 4 WHEN 0 THEN '{\"shop\": \" north \", \"creatorId\": \"c' || o_custkey || '\"}' WHEN 1 THEN '{\"applicable_shops\": \"south\", \"creator_id\": \"' || o_custkey || '\", \"intentCategory\": \"\", \"intent_category\": \"ask\"}' WHEN 2 THEN 'no json' END"


@query(f"WITH t AS (SELECT o_orderkey, {_REQUEST_SQL} AS raw FROM orders), j AS (SELECT o_orderkey, CASE WHEN json_valid(raw) THEN raw END AS j FROM t) SELECT o_orderkey, coalesce(nullif(trim(j->>'shop'), ''), nullif(trim(j->>'applicable_shops'), '')) AS shop, coalesce(nullif(trim(j->>'creatorId'), ''), nullif(trim(j->>'creator_id'), '')) AS creator_id, coalesce(nullif(trim(j->>'intentCategory'), ''), nullif(trim(j->>'intent_category'), '')) AS intent FROM j")
def request_fields(spark: SparkSession, d: str) -> DataFrame:
    """Requests from JSON under several names (SRC-23)."""
    rows = T.table(spark, d, "orders").select("o_orderkey", files.request(F.expr(_REQUEST_SQL.replace("||", "||"))).alias("r"))
    return rows.select("o_orderkey", "r.shop", "r.creator_id", "r.intent")


_PATH = "CASE p_partkey % 4 WHEN 0 THEN '/data/in/' || p_brand || '/a.html' WHEN 1 THEN 'file:/data/in/' || p_type || '.xlsx' WHEN 2 THEN 'C:\\other\\' || p_brand || '.docx' ELSE 'plain.txt' END"


@query(f"WITH t AS (SELECT p_partkey, {_PATH} AS path FROM part), p AS (SELECT p_partkey, replace(regexp_replace(path, '^[a-z]+:(?://[^/]*)?', ''), '\\', '/') AS p FROM t) SELECT p_partkey, CASE WHEN starts_with(p, '/data/in/') THEN substr(p, 10) ELSE regexp_extract(p, '([^/]*)$', 1) END AS source_file FROM p")
def source_keys(spark: SparkSession, d: str) -> DataFrame:
    """Names of files below a folder (SRC-06, STR-24)."""
    path = F.expr(_PATH.replace("\\", "\\\\"))
    return T.table(spark, d, "part").select("p_partkey", files.source_key(path, "/data/in").alias("source_file"))


_DOC = "CASE WHEN p_partkey % 3 = 0 THEN '[{\"id\": \"r' || p_partkey || '\", \"title\": \"' || p_brand || '\"}]' WHEN p_partkey % 3 = 1 THEN '{\"records\": [{\"id\": \"a\", \"title\": \"' || p_type || '\", \"content\": \"x\"}, {\"id\": \"b\"}]}' ELSE '{}' END"


@query(f"WITH t AS (SELECT p_partkey, {_DOC} AS raw FROM part), j AS (SELECT p_partkey, unnest(CASE WHEN starts_with(raw, '[') THEN from_json(raw, '[{{\"id\": \"VARCHAR\", \"title\": \"VARCHAR\", \"content\": \"VARCHAR\"}}]') ELSE from_json(json_extract(raw, '$.records'), '[{{\"id\": \"VARCHAR\", \"title\": \"VARCHAR\", \"content\": \"VARCHAR\"}}]') END) AS r FROM t) SELECT p_partkey, r.id AS id, r.title AS title, r.content AS content FROM j")
def structured_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Records of structured documents as rows (SRC-08, KB-05)."""
    rows = T.table(spark, d, "part").select("p_partkey", F.explode(files.records(F.expr(_DOC), "id string, title string, content string")).alias("r"))
    return rows.select("p_partkey", "r.id", "r.title", "r.content")


@query("SELECT conv_id AS document, string_agg('# ' || coalesce(role, '') || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def document_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents put together from their parts (SRC-24)."""
    return files.document_text(T.table(spark, d, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("place"), F.col("role").alias("header"), F.col("text").alias("body")))


@query("""WITH scope AS (SELECT ps_c, unnest(string_split(regexp_replace(ids, '[()'' ]', '', 'g'), ',')) AS id FROM (SELECT c_custkey AS ps_c, '(''' || c_custkey || ''', ''' || (c_custkey + 1) || ''',)' AS ids FROM customer WHERE c_mktsegment = 'BUILDING') WHERE id <> '')
SELECT l_orderkey, l_linenumber FROM lineitem SEMI JOIN (SELECT * FROM scope WHERE id <> '') s ON s.ps_c = l_suppkey AND TRY_CAST(s.id AS BIGINT) = l_partkey""".replace(" WHERE id <> '')\nSELECT", ")\nSELECT"))
def campaign_scope(spark: SparkSession, d: str) -> DataFrame:
    """Showcased products within the campaigns' scopes of products (SRC-22, FLT-09, JOIN-16)."""
    ids = F.filter(F.split(F.regexp_replace(F.concat(F.lit("('"), "c_custkey", F.lit("', '"), F.col("c_custkey") + 1, F.lit("',)")), "[()' ]", ""), ","), lambda x: x != "")
    scope = T.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("l_suppkey"), F.explode(F.transform(ids, lambda x: x.try_cast("bigint"))).alias("l_partkey"))
    return T.table(spark, d, "lineitem").join(scope, ["l_suppkey", "l_partkey"], "left_semi").select("l_orderkey", "l_linenumber")


@query(r"""WITH t AS (SELECT page_id, '1. ' || coalesce(url, '') || chr(10) || '  more of it ' || page_id || chr(10) || chr(10) || ' 2.  ' || repeat('word ', CAST(page_id % 30 AS INTEGER)) || CASE WHEN page_id % 2 = 0 THEN chr(10) || '3. last' ELSE '' END AS body FROM pages),
b AS (SELECT page_id, 1 AS n, trim(coalesce(url, '') || chr(10) || '  more of it ' || page_id) AS item FROM t JOIN pages USING (page_id) UNION ALL SELECT page_id, 2, trim(repeat('word ', CAST(page_id % 30 AS INTEGER))) FROM pages UNION ALL SELECT page_id, 3, 'last' FROM pages WHERE page_id % 2 = 0),
s AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n) AS seq, trim(split_part(item, chr(10), 1)) AS first FROM b WHERE item <> '')
SELECT page_id, 'GEN-' || page_id || '-' || seq AS id, CAST(n AS VARCHAR) AS number, CASE WHEN length(first) <= 72 THEN first ELSE rtrim(substr(first, 1, 71)) || '…' END AS title, item AS content, 'GEN' AS applicable_shops, 'Global seller policy #' || n || ' (all shops).' AS purpose FROM s""")
def policy_records(spark: SparkSession, d: str) -> DataFrame:
    """A record for each numbered item of a policy text (CHK-04, STR-07, STR-08, SRC-04)."""
    url, k = F.coalesce("url", F.lit("")), F.col("page_id")
    body = F.concat(F.lit("1. "), url, F.lit("\n  more of it "), k, F.lit("\n\n 2.  "), F.expr("repeat('word ', cast(page_id % 30 as int))"), F.when(k % 2 == 0, "\n3. last").otherwise(""))
    rows = T.table(spark, d, "pages").select("page_id", F.posexplode(X.numbered_items(body)).alias("pos", "item"))
    first = F.trim(F.split_part("item.body", F.lit("\n"), F.lit(1)))
    title = F.when(F.length(first) <= 72, first).otherwise(F.concat(F.rtrim(F.substring(first, 1, 71)), F.lit("…")))
    purpose = F.format_string("Global seller policy #%s (all shops).", "item.number")
    return rows.select("page_id", F.format_string("GEN-%d-%d", k, F.col("pos") + 1).alias("id"), "item.number", title.alias("title"), F.col("item.body").alias("content"), F.lit("GEN").alias("applicable_shops"), purpose.alias("purpose"))


@query(r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'A-0' || (doc_id % 9) || ' rule' WHEN doc_id % 5 = 1 THEN '' ELSE source || ' ' || doc_id END AS title, trim(substr(coalesce(text, ''), 1, 80)) AS content, source AS section, CASE WHEN doc_id % 2 = 0 THEN lang ELSE ' ' END AS sub FROM documents),
u AS (SELECT *, coalesce(nullif(title, ''), 'Untitled') AS ft, CASE WHEN content <> '' THEN content ELSE coalesce(nullif(title, ''), 'Untitled') END AS probe, lower(coalesce(section, '') || chr(10) || coalesce(sub, '') || chr(10) || title || chr(10) || content) AS whole FROM t),
v AS (SELECT *, CASE WHEN length(regexp_replace(probe, '[^A-Za-z]', '', 'g')) > length(regexp_replace(probe, '[\x00-\x7F]', '', 'g')) THEN 'en' ELSE 'zh' END AS language FROM u)
SELECT doc_id, CASE WHEN regexp_matches(title, '^(?i)[SAB]-[0-9]{2}') THEN upper(regexp_extract(title, '^((?i)[SAB]-[0-9]{2})', 1)) ELSE coalesce(nullif(upper(array_to_string(regexp_extract_all(title, '[A-Za-z0-9]+'), '-')), ''), 'KNOWLEDGE') END AS id,
  CASE WHEN regexp_matches(title, '^(?i)[SAB]-[0-9]{2}') THEN upper(substr(title, 1, 1)) WHEN contains(whole, 's-level') OR contains(whole, 's 级') THEN 'S' WHEN contains(whole, 'a-level') OR contains(whole, 'a 级') THEN 'A' WHEN contains(whole, 'b-level') OR contains(whole, 'b 级') THEN 'B' ELSE 'GEN' END AS creator_type,
  coalesce(nullif(trim(coalesce(sub, '')), ''), nullif(trim(coalesce(section, '')), ''), 'General') AS intent_category, ft AS title, language, CASE WHEN language = 'en' THEN ft ELSE '' END AS entitle, CASE WHEN language = 'en' THEN content ELSE '' END AS encontent FROM v""")
def chunk_records(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with id, tier, language and English mirror (CHK-05)."""
    k = F.col("doc_id")
    title = F.when(k % 5 == 0, F.concat(F.lit("A-0"), k % 9, F.lit(" rule"))).when(k % 5 == 1, "").otherwise(F.concat("source", F.lit(" "), k))
    rows = T.table(spark, d, "documents").select(k, title.alias("t"), F.trim(F.substring(F.coalesce("text", F.lit("")), 1, 80)).alias("content"), F.coalesce("source", F.lit("")).alias("section"), F.coalesce(F.when(k % 2 == 0, F.col("lang")).otherwise(" "), F.lit("")).alias("sub"))
    whole = F.concat_ws("\n", "section", "sub", "t", "content")
    numbered = F.upper(F.regexp_extract("t", r"(?i)^([SAB]-[0-9]{2})", 1))
    slug = F.upper(F.array_join(F.regexp_extract_all("t", F.lit("[A-Za-z0-9]+"), 0), "-"))
    final = F.coalesce(F.nullif("t", F.lit("")), F.lit("Untitled"))
    language = S.language_guess(F.when(F.col("content") != "", F.col("content")).otherwise(final))
    intent = F.coalesce(F.nullif(F.trim("sub"), F.lit("")), F.nullif(F.trim("section"), F.lit("")), F.lit("General"))
    mirror = lambda c: F.when(language == "en", c).otherwise("")
    return rows.select(
        "doc_id", F.when(numbered != "", numbered).when(slug != "", slug).otherwise("KNOWLEDGE").alias("id"), X.level(F.col("t"), whole).alias("creator_type"), intent.alias("intent_category"), final.alias("title"),
        language.alias("language"), mirror(final).alias("entitle"), mirror(F.col("content")).alias("encontent"),
    )
