"""Chunks of HTML pages by their headings: h1 sections, h2 intents, h3 titles, carried down the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import html_text

#: A heading that ends is no chunk of its own if it only repeats its title in fewer letters than this; and an untitled one needs more.
ECHO, UNTITLED = 40, 150


def split_by_headings(html: Column) -> Column:
    """array<struct<level, heading, body>> of a page in order: what stands before the first heading has level 0."""
    marked = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?i)(<h[1-3][\s>])", "\u0001$1")

    def part(p: Column) -> Column:
        level = F.coalesce(F.regexp_extract(p, r"(?i)^<h([1-3])[\s>]", 1).try_cast("int"), F.lit(0))
        heading = html_text(F.regexp_extract(p, r"(?is)^<h[1-3][^>]*>(.*?)</h[1-3]>", 1))
        body = html_text(F.when(level > 0, F.regexp_replace(p, r"(?is)^<h[1-3][^>]*>(?:.*?</h[1-3]>)?", "")).otherwise(p))
        return F.struct(level.alias("level"), heading.alias("heading"), body.alias("body"))

    return F.transform(F.split(F.coalesce(marked, F.lit("")), "\u0001"), part)


def html_chunks(pages: DataFrame, page: str, html: str, name: str) -> DataFrame:
    """(page, seq, intent_category, title, content) of pages (page, html, name): a chunk for each heading, under the last h2 and h1
    above it. Chunks that only echo a short title go, and untitled general ones under 150 letters; a page without chunks is one
    as a whole, under its h1 or name, unless it has no text. Null pages give nothing."""
    rows = pages.where(F.col(html).isNotNull()).select(page, F.col(name).alias("__name"), html_text(F.col(html)).alias("__all"), F.posexplode(split_by_headings(F.col(html))).alias("pos", "p"))
    rows = rows.select(page, "__name", "__all", "pos", "p.level", F.nullif("p.heading", F.lit("")).alias("heading"), "p.body")
    above = Window.partitionBy(page).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    down = lambda level: F.last(F.when(F.col("level") == level, F.col("heading")), ignorenulls=True).over(above)
    rows = rows.withColumns({"section": down(1), "carried": down(2), "h1_at": F.coalesce(F.last(F.when(F.col("level") == 1, F.col("pos")), ignorenulls=True).over(above), F.lit(-1)), "h2_at": F.coalesce(F.last(F.when((F.col("level") == 2) & F.col("heading").isNotNull(), F.col("pos")), ignorenulls=True).over(above), F.lit(-1))})
    own = F.when(F.col("h2_at") > F.col("h1_at"), F.col("carried"))
    rows = rows.withColumns({"intent": F.coalesce("carried", "section", F.lit("General")), "titled": F.coalesce(F.when(F.col("level") == 3, F.col("heading")), own, F.col("section"))})
    rows = rows.withColumn("content", F.when(F.col("body") != "", F.col("body")).otherwise(F.coalesce("titled", F.lit(""))))
    echo = (F.col("content") == F.coalesce("titled", F.lit(""))) & (F.length("content") < ECHO)
    kept = rows.withColumn("keeps", ~echo & ~(F.col("titled").isNull() & (F.length("content") < UNTITLED)))
    seq = F.sum(F.when(F.col("keeps"), 1).otherwise(0)).over(above).cast("int")
    kept = kept.withColumns({"seq": seq, "any": F.max("keeps").over(Window.partitionBy(page))})
    chunks = kept.where("keeps").select(page, "seq", F.col("intent").alias("intent_category"), F.coalesce("titled", F.concat(F.lit("HTML-"), "seq")).alias("title"), "content")
    bare = kept.where("not any and __all <> ''").groupBy(page).agg(F.max_by(F.struct(F.coalesce("section", "__name").alias("title"), F.col("__all").alias("content")), "pos").alias("w"))
    return chunks.unionByName(bare.select(page, F.lit(1).alias("seq"), F.col("w.title").alias("intent_category"), "w.title", "w.content"))
