"""Files to the chunker of their suffix in one plan, and rows of registered fetchers as a table."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions import records as X
from ..operators.outline import html_chunks
from . import files

#: What every chunker gives.
PIECE = "source_file string, seq int, intent_category string, title string, content string"
Chunker = Callable[[DataFrame], DataFrame]
CHUNKERS: dict[str, Chunker] = {}


def chunker(*suffixes: str) -> Callable[[Chunker], Chunker]:
    """Register a function of (source_file, text) to PIECE rows for files with these suffixes, each once."""

    def add(f: Chunker) -> Chunker:
        for s in suffixes:
            if s.lower() in CHUNKERS:
                raise ValueError(f"already registered: {s}")
            CHUNKERS[s.lower()] = f
        return f

    return add


@chunker(".html", ".htm")
def pages(rows: DataFrame) -> DataFrame:
    """Chunks under headings; a page without any is named by its file."""
    named = rows.withColumn("__file", F.regexp_replace(F.regexp_extract("source_file", r"([^/]*)$", 1), r"\.[^.]*$", ""))
    return html_chunks(named, "source_file", "text", "__file")


@chunker(".txt", ".md")
def numbered(rows: DataFrame) -> DataFrame:
    """Numbered items; the first line is the title."""
    items = rows.select("source_file", F.posexplode(X.numbered_items(F.col("text"))).alias("pos", "item"))
    title = X.shortened(F.split_part("item.body", F.lit("\n"), F.lit(1)), 72)
    return items.select("source_file", (F.col("pos") + 1).alias("seq"), F.lit("GEN").alias("intent_category"), title.alias("title"), F.col("item.body").alias("content"))


@chunker(".json")
def structured(rows: DataFrame) -> DataFrame:
    """Records of a structured document, in order."""
    each = rows.select("source_file", F.posexplode(files.records(F.col("text"), "intent_category string, title string, content string")).alias("pos", "r"))
    return each.select("source_file", (F.col("pos") + 1).alias("seq"), "r.intent_category", "r.title", "r.content")


def chunked(found: DataFrame, chunkers: dict[str, Chunker] | None = None) -> DataFrame:
    """PIECE rows of files (source_file, text), each file by the chunker of its suffix, the longest that fits; others have none.

    The branches are one plan, and each reads only its files' rows. Null texts and names give nothing.
    """
    chunkers = CHUNKERS if chunkers is None else chunkers
    rest, parts = F.lower("source_file"), []
    for suffix in sorted(chunkers, key=lambda s: (-len(s), s)):
        longer = [s for s in chunkers if len(s) > len(suffix) and s.endswith(suffix)]
        own = F.endswith(rest, F.lit(suffix))
        for s in longer:
            own = own & ~F.endswith(rest, F.lit(s))
        parts.append(files.with_columns(chunkers[suffix](found.where(own & F.col("text").isNotNull()).select("source_file", "text")), PIECE))
    return reduce(DataFrame.unionAll, parts)


def unknown(found: DataFrame, chunkers: dict[str, Chunker] | None = None) -> DataFrame:
    """Files (source_file) that no chunker takes."""
    known = F.lit(False)
    for s in CHUNKERS if chunkers is None else chunkers:
        known = known | F.endswith(F.lower("source_file"), F.lit(s))
    return found.where(~F.coalesce(known, F.lit(False))).select("source_file")


def folder(spark: SparkSession, path: str, chunkers: dict[str, Chunker] | None = None) -> DataFrame:
    """PIECE rows of all files of a folder that have a chunker, read as UTF-8."""
    found = files.documents(spark, path, list(CHUNKERS if chunkers is None else chunkers))
    return chunked(found.select("source_file", F.decode("content", "UTF-8").alias("text")), chunkers)


class _Rows(DataSourceReader):
    """Calls a fetcher in each task with what must hold: column to the values that it may have."""

    def __init__(self, name: str, parts: int, options: dict[str, str]) -> None:
        self.name, self.parts, self.options, self.wanted = name, parts, options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            yield f  # Spark tests every row again, so a fetcher may give more

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, function = self.name.partition(":")
        yield from getattr(importlib.import_module(module), function)(self.wanted, partition.value, self.parts, **self.options)


class FetchedRows(DataSource):
    """Rows of a fetcher: options fetcher (`module:function`), parts, and what else the fetcher takes as texts."""

    @classmethod
    def name(cls) -> str:
        return "murmura_rows"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        given = dict(self.options)
        return _Rows(given.pop("fetcher"), int(given.pop("parts", "1")), given)


def fetched(spark: SparkSession, fetcher: str, schema: str, parts: int = 1, **options: str) -> DataFrame:
    """A table of rows that a function gives: fetcher names it as `module:function`, so that executors can import it.

    It is called as function(wanted, part, parts, **options) in each of `parts` tasks and yields tuples of the schema; wanted has the
    values that equality filters leave for a column, and leaving out other rows is up to it. Filters are pushed down for this session.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FetchedRows)
    return spark.read.format("murmura_rows").schema(schema).option("fetcher", fetcher).option("parts", parts).options(**options).load()
