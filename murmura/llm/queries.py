"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, importance, language, licenses, mixing, transport_stream
from . import quality as quality_rules
from .jaccard import jaccard_components
from .packing import pack_documents
from .substring_dedup import remove_repeats
from .token_counts import token_counts
from .url_filter import filter_urls
from .whitening import whiten

#: Rules of the URL filter: host and path in one, and what they decide.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out() -> Column:
    """Whether a document is kept from training: the CRC-32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    media = transport_stream.store(docs, keep=("doc_id", "n_bytes"))
    # digests of the stored form are taken before it is read back, so that it need not be carried on
    media = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    read = transport_stream.read(media, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    entries = F.expr("filter(units, u -> u.random_access)")
    feature = F.format_string(
        "packets=%d streams=%d units=%d complete=%d entries=%d last_pts=%d index=%s gaps=%d repeats=%d errors=%d",
        "packets", F.size("streams"), F.size("units"), F.size(F.expr("filter(units, u -> u.complete)")), F.size(entries),
        F.expr("array_max(transform(units, u -> u.pts))"), F.md5(F.expr("array_join(transform(filter(units, u -> u.random_access), u -> concat(u.pts, '@', u.packet)), ' ')").cast("binary")),
        "gaps", "repeats", "errors",
    )
    return read.select(
        "doc_id", "n_bytes", F.octet_length("data").cast("long").alias("payload_bytes"), F.sha2("data", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(data, -64, 64)")).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode(documents(spark, sf_dir), path)
    ids = ids.withColumns({"n_tokens": (F.octet_length("ids") / 4).cast("long"), "ids_sha256": F.sha2("ids", 256)})
    decoded = bpe.decode(ids, path, keep=("doc_id", "n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    crf = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), sample_docs=2_000)
    return quality_rules.quality(docs, crf, least_words=50, repeat_percent=50, share=0.5)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), n=5, percent=75)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(docs.where(~held_out()), sample_docs=4_000)
    return language.identify(docs, model, penalty=16.0).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir), span=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end=1)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES, threshold=0.5, damping=0.85, rounds=20)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=16)


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = mixing.mix(documents(spark, sf_dir), weights=(3, 1, 2), percent=150, most=2, block_words=1024)
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance.resample(documents(spark, sf_dir), benchmark, n=1, buckets=10_000, least_words=20, percent=10, seed="2024")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_transport_stream": op2_transport_stream,
    "op3_bpe": op3_bpe,
    "op4_license_scan": op4_license_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_language_id": op7_language_id,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_url_filter": op10_url_filter,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_source_mix": op12_source_mix,
    "op13_importance_resampling": op13_importance_resampling,
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _license_sql() -> str:
    """Normal forms and digests of documents, their lines and the known texts."""

    def digest(x: str) -> str:
        x = rf"chr(10) || lower(regexp_replace({x}, '\r\n?', chr(10), 'g'))"
        x = f"regexp_replace({x}, {_text(licenses.COPYRIGHT)}, '', 'g')"
        x = f"regexp_replace({x}, {_text(licenses.RESERVED)}, chr(10), 'g')"
        x = f"regexp_replace(' ' || {x} || ' ', {_text(licenses.APART)}, '  ', 'g')"
        for one, other in licenses.EQUIVALENT:
            x = f"replace({x}, ' {one} ', ' {other} ')"
        return f"sha256({x})"

    rows = lambda texts: ", ".join(f"({_text(k)}, {_text(v)})" for k, v in texts.items())
    return f"""
WITH texts AS (SELECT {digest("t")} AS digest, min(i) AS license_id FROM (VALUES {rows(licenses.TEXTS)}) v(i, t) GROUP BY 1
), notes AS (SELECT {digest("t")} AS d, min(i) AS i FROM (VALUES {rows(licenses.NOTICES)}) v(i, t) GROUP BY 1
), lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
), hits AS (
  SELECT doc_id, string_agg(DISTINCT i, ',' ORDER BY i) AS notices FROM (SELECT doc_id, {digest("line")} AS d FROM lines) JOIN notes USING (d) GROUP BY doc_id
), docs AS (SELECT doc_id, {digest("text")} AS digest FROM documents)
SELECT docs.doc_id, docs.digest, license_id, coalesce(notices, '') AS notices
FROM docs LEFT JOIN texts ON texts.digest = docs.digest LEFT JOIN hits ON hits.doc_id = docs.doc_id
"""


def _url_filter_sql(rounds: int = 20) -> str:
    """Both propagations, unrolled: trust along the links between hosts, distrust against them."""
    steps = ["s0 AS MATERIALIZED (SELECT * FROM seeds)"]
    for n in range(1, rounds + 1):
        steps.append(f"""s{n} AS MATERIALIZED (
  SELECT kind, host, sum(seed) AS seed FROM (
    SELECT kind, host, seed FROM seeds UNION ALL
    SELECT e.kind, e.target, 0.85 * s.seed * e.share FROM s{n - 1} s JOIN edges e ON e.kind = s.kind AND e.source = s.host
  ) GROUP BY kind, host)""")
    return r"""
WITH rules(h, p, rule, rv) AS (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'), ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')
), cut AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT page_id, html, host, path,
    (SELECT {'rule': r.rule, 'rv': r.rv} FROM rules r WHERE (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) ORDER BY length(r.rule) DESC, r.rule LIMIT 1) AS r FROM split
), own AS (
  SELECT host, avg(CASE WHEN r.rv = 'allow' THEN 1.0 ELSE 0.0 END) AS allow, avg(CASE WHEN r.rv = 'block' THEN 1.0 ELSE 0.0 END) AS block FROM ruled WHERE host <> '' GROUP BY host
), seeds AS MATERIALIZED (
  SELECT 'trust' AS kind, host, allow AS seed FROM own WHERE allow > 0 UNION ALL SELECT 'distrust', host, block FROM own WHERE block > 0
), found AS (
  SELECT host AS a, translate(unnest(regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']?(?:https?:)?//([^/?#"''\s<>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS b FROM ruled WHERE host <> ''
), links AS MATERIALIZED (
  SELECT a, b, count(*) AS n FROM found WHERE a <> b GROUP BY a, b
), edges AS MATERIALIZED (
  SELECT 'trust' AS kind, a AS source, b AS target, n / sum(n) OVER (PARTITION BY a) AS share FROM links
  UNION ALL SELECT 'distrust', b, a, n / sum(n) OVER (PARTITION BY b) FROM links
), """ + ",\n".join(steps) + f"""
, scores AS (
  SELECT host, sum(CASE WHEN kind = 'distrust' THEN seed ELSE -seed END) AS bad FROM s{rounds} GROUP BY host
)
SELECT page_id, ruled.host, path, r.rule AS rule, coalesce(r.rv, CASE WHEN round(coalesce(bad, 0), 9) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN scores ON scores.host = ruled.host
"""


#: Targets by the highest level at which no source is above its limit; what is taken are whole passes over a source's line and a part.
_MIX_SQL = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(concat_ws(':', doc_id, md5(text))) AS key FROM documents
), sources AS MATERIALIZED (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM rows GROUP BY source
), levels(round, level) AS (
  SELECT 0, CAST(0 AS DOUBLE)
  UNION ALL
  SELECT round + 1, (SELECT (150 * sum(source_size) / 100 - coalesce(sum(CASE WHEN l.level * weight > 2 * source_size THEN 2 * source_size END), 0))
    / sum(CASE WHEN l.level * weight > 2 * source_size THEN 0 ELSE weight END) FROM sources) FROM levels l WHERE round < 30
), plan AS (
  SELECT source, source_size, least(2.0 * source_size, level * weight) AS target FROM sources, (SELECT level FROM levels ORDER BY round DESC LIMIT 1)
), lines AS (
  SELECT r.doc_id, r.size, source_size, target, sum(size) OVER (PARTITION BY r.source ORDER BY key, r.doc_id ROWS UNBOUNDED PRECEDING) - size AS start,
    CAST(floor(target + 0.5) AS BIGINT) AS goal FROM rows r JOIN plan p ON p.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE goal // source_size * size + greatest(0, least(size, goal % source_size - start)) END AS BIGINT) AS taken FROM lines
"""

#: Words are lower-cased and cut out; a word's bucket is its CRC-32, computed byte by byte with the table of the polynomial.
_IMPORTANCE_SQL = r"""
WITH RECURSIVE steps(b, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM steps WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8
), docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), target AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), each AS MATERIALIZED (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(w) AS w FROM docs) GROUP BY doc_id, w
), spelt AS (
  SELECT w, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)) AS bytes FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM each UNION SELECT w FROM target))
), buckets AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256])), 4294967295) % 10000 AS bucket FROM spelt, crc_table
), source_counts AS (SELECT bucket, sum(c) AS s FROM each JOIN buckets USING (w) GROUP BY bucket
), target_counts AS (SELECT bucket, count(*) AS t FROM target JOIN buckets USING (w) GROUP BY bucket
), sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM source_counts) AS s_all, (SELECT coalesce(sum(t), 0) FROM target_counts) AS t_all
), gains AS (
  SELECT bucket, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS gain
  FROM source_counts LEFT JOIN target_counts USING (bucket), sums
), weights AS (SELECT doc_id, CAST(sum(c * gain) AS BIGINT) AS weight FROM each JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (doc_id)
), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


ORACLE_SQL: dict[str, str] = {
    "op12_source_mix": _MIX_SQL,
    "op13_importance_resampling": _IMPORTANCE_SQL,
    "op6_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words
), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
""",
    "op8_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), hashed AS (
  SELECT doc_id, w, list_transform(w, lambda x: hash(x)) AS h FROM words
), wins AS (
  SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, h FROM hashed WHERE len(w) >= 35
), keyed AS (
  SELECT doc_id, i, hash(h[i:i+34]) AS k FROM wins
), twice AS (
  SELECT k FROM keyed GROUP BY k HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM keyed JOIN twice USING (k))
), listed AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), each AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words
), kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS t FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p WHERE g.p IS NULL GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(l.ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN listed l ON l.doc_id = w.doc_id LEFT JOIN kept k ON k.doc_id = w.doc_id
""",
    "op10_url_filter": _url_filter_sql(),
    "op4_license_scan": _license_sql(),
    "op1_token_counts": rf"""
WITH RECURSIVE vocab AS MATERIALIZED (
  SELECT DISTINCT hex(from_base64(split_part(l, ' ', 1))) AS h FROM (SELECT unnest(string_split(content, chr(10))) AS l FROM read_text('{public_tokenizers.path("byte_bpe_50k.tiktoken")}')) WHERE l <> ''
), each AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM documents
), walk(w, rest, n) AS (
  SELECT w, hex(encode(' ' || w)), 0 FROM (SELECT DISTINCT w FROM each)
  UNION ALL
  SELECT w, substr(rest, max(k) + 1), n + 1 FROM (SELECT w, rest, n, unnest(range(2, least(length(rest), 256) + 1, 2)) AS k FROM walk WHERE rest <> '') JOIN vocab ON h = substr(rest, 1, k)
  GROUP BY w, rest, n
), sizes AS (SELECT w, n FROM walk WHERE rest = ''
), sums AS (SELECT doc_id, count(*) AS n_words, CAST(sum(n) AS BIGINT) AS n_tokens FROM each JOIN sizes USING (w) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_tokens, 0) AS n_tokens FROM documents d LEFT JOIN sums USING (doc_id)
""",
}
