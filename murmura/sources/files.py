"""Readers: documents as files, JSON of chunks, records, vectors and requests, manifests, change lists, database tables.

Every reader is a DataFrame of Spark's own sources with a given schema, so paths may be in any store that Spark reads. Missing
files give an empty table where that is said; nothing is read on the driver but lists of changes, which are parameters.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK = "id string, title string, content string, entitle string, encontent string, language string, intent_category string, creator_type string, creator_progress string, source_file string"
VECTOR = "id string, source_file string, embedding array<double>, document string, metadata map<string,string>"
MANIFEST = "source_file string, checksum string, chunks long, built_at timestamp"


def source_key(path: Column, root: str) -> Column:
    """A file's path below root, with slashes; the name alone if it is not below it."""
    p = F.replace(F.regexp_replace(path, "^[a-z]+:(?://[^/]*)?", ""), F.lit("\\"), F.lit("/"))
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(p, F.lit(base)), F.substring(p, len(base) + 1, 1 << 30)).otherwise(F.regexp_extract(p, r"([^/]*)$", 1))


def documents(spark: SparkSession, folder: str, suffixes: Iterable[str], recursive: bool = True, only: Iterable[str] | None = None) -> DataFrame:
    """(source_file, sha256, size, content) of files with the suffixes, lock files (~$) left out; only: names or keys to keep.

    Each file is a row, read where the task is. A folder without such files gives an empty table.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    keep = F.lower(name).rlike("(?:" + "|".join(s.lower().replace(".", r"\.") for s in suffixes) + ")$") & ~F.startswith(name, F.lit("~$"))
    key = source_key(F.col("path"), folder.split("://", 1)[-1] if "://" in folder else folder)
    out = files.where(keep).select(key.alias("source_file"), name.alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "content")
    return out.where(F.col("name").isin(*only) | F.col("source_file").isin(*only)) if only is not None else out


def text_document(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text) of one text file as a whole."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1).alias("source_file"), F.col("value").alias("text"))


def optional(spark: SparkSession, read: callable, schema: str | StructType) -> DataFrame:
    """A table that may be missing: what read() gives with the columns of schema, absent columns null; empty only if it does not
    exist. Any other failure rises."""
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    try:
        found = read()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
            raise
        return spark.createDataFrame([], wanted)
    return with_columns(found, wanted)


def with_columns(df: DataFrame, schema: str | StructType) -> DataFrame:
    """The columns of schema, those that df lacks as null of their type."""
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all `*.chunks.json` (arrays) in a folder, with the file's name and the chunk's place in it."""
    rows = spark.read.schema(CHUNK).option("multiLine", "true").option("pathGlobFilter", "*.chunks.json").json(folder)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.chunks\.json$", 1).alias("stem"))


def written_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks that sinks.write_chunks has written, with their stem; empty if there are none."""
    schema = f"{CHUNK}, stem string"
    return optional(spark, lambda: spark.read.schema(schema).json(path), schema)


def vectors_json(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(id, embedding) of JSON files: arrays of objects or an object a line. Rows without an id or a vector are left out."""
    rows = spark.read.schema("id string, embedding array<double>").option("multiLine", "false").option("pathGlobFilter", pattern).json(path)
    return rows.where("id is not null and embedding is not null")


def records(text: Column, schema: str) -> Column:
    """array of a structured document's records: an object with `records`, or a bare list; null for anything else."""
    whole = F.from_json(text, f"struct<records:array<struct<{schema}>>>")
    return F.when(F.startswith(F.trim(text), F.lit("[")), F.from_json(text, f"array<struct<{schema}>>")).otherwise(whole["records"])


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """A vector table; empty if it does not exist yet."""
    return optional(spark, lambda: spark.read.parquet(folder), VECTOR)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """What was built from which file; empty if it does not exist yet."""
    return optional(spark, lambda: spark.read.parquet(folder), MANIFEST)


def changes(spark: SparkSession, listed: dict[str, list[str]]) -> DataFrame:
    """(operation, source_file, place) of a change list: added, modified, deleted; each path once for an operation, in order.

    Unknown operations, an empty list and a path under two operations are errors.
    """
    if unknown := set(listed) - {"added", "modified", "deleted"}:
        raise ValueError(f"unknown operations: {sorted(unknown)}")
    rows = [(op, p.strip().replace("\\", "/")) for op, paths in listed.items() for p in dict.fromkeys(paths) if p.strip()]
    if not rows:
        raise ValueError("no changes are listed")
    several = {p for _, p in rows if len({op for op, q in rows if q == p}) > 1}
    if several:
        raise ValueError(f"listed under several operations: {sorted(several)}")
    return spark.createDataFrame([(op, p, i) for i, (op, p) in enumerate(dict.fromkeys(rows))], "operation string, source_file string, place int")


def database(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32, **options: str) -> DataFrame:
    """A database table by JDBC; with a numeric key and its bounds, read in parts side by side. Filters are pushed down."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


#: Request fields and the names they come under, the first present one counts.
REQUEST = {
    "shop": ("shop", "applicable_shops"), "creator_id": ("creatorId", "creator_id"), "creator_name": ("creatorName", "creator_name"), "context_text": ("contextText", "context_text", "context"),
    "intent": ("intentCategory", "intent_category"), "product_id": ("productId", "product_id"), "language": ("language",),
}


def request(text: Column, fields: dict[str, tuple[str, ...]] = REQUEST) -> Column:
    """struct of a request's fields from JSON: aliases in order, blanks as null; all null for text that is no object."""
    parsed = F.from_json(text, "map<string,string>")
    return F.struct(*[F.coalesce(*[F.nullif(F.trim(F.try_element_at(parsed, F.lit(n))), F.lit("")) for n in names]).alias(f) for f, names in fields.items()])


def document_text(parts: DataFrame) -> DataFrame:
    """(document, text) of parts (document, place, header, body): bodies in order, each under its header. A document must fit in a row."""
    one = F.concat(F.lit("# "), F.coalesce("header", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    return parts.groupBy("document").agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", one.alias("t"))))["t"], "\n\n").alias("text"))
