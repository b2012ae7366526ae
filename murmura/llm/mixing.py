"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents stand on a line of words in an order shuffled by their digests, which is cut into blocks of equally many
words. The points of the golden ratio's sequence, mapped through the sources' cumulative shares of slots, say whose turn each slot
is; a source's slots, ranked, take its blocks one after another, and begin again where they end. So every stretch of the schedule
holds the sources in nearly their shares, and the whole holds exactly the rounded targets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import if_small, materialize, numbered, prepare

#: Words, which are counted and mixed.
WORD = r"[^\x20\x09-\x0D]+"
#: 2**64 over the golden ratio, odd: multiples of it modulo 2**64 are spread evenly.
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Slots that are ranked in one group, rows that share one group of sources, and widths of the cells in which slots find sources.
_CHUNK, _CELL = 8192, 32


def along(rows: DataFrame, group: str, part: str, order: list[Column], value: str, name: str) -> DataFrame:
    """rows with column `name`: the sum of value over the rows of the group that come before, by part and then by order.

    Only the sums of parts meet in one window of a group, so a group may hold most of the rows.
    """
    sums = rows.groupBy(group, part).agg(F.sum(value).alias("__sum"))
    sums = sums.withColumn("__before", F.sum("__sum").over(Window.partitionBy(group).orderBy(part)) - F.col("__sum")).drop("__sum")
    own = F.sum(value).over(Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value)
    return rows.withColumn(name, own).join(sums, [group, part]).withColumn(name, F.col(name) + F.col("__before")).drop("__before")


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """(sid, source, source_size, weight, target) of every source of sizes (source, size); sid numbers them by code point, null last.

    Weights repeat in that order. Targets share percent / 100 of all sizes by weight, stop at `most` times a source's size, and what
    is over goes to the others by weight, until none is above: target = min(most * size, level * weight). Only sums reach the driver.
    """
    if percent > 100 * most:
        raise ValueError("the sources can't hold so much")
    found = numbered(materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources"), [F.asc_nulls_last("source")], "source_ids")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int")).cast("long")
    found = found.select(F.col("position").alias("sid"), "source", "source_size", weight.alias("weight"))
    level, stopped, limit = 0.0, -1, F.col("source_size") * most
    while True:  # a higher level stops more sources; it is found when no more stop
        above = F.lit(level) * F.col("weight") > limit
        sums = found.agg(
            F.sum("source_size"), F.coalesce(F.sum(F.when(above, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)), F.count(F.when(above, 1))
        ).first()
        if sums[3] == stopped or not sums[2]:
            break
        level, stopped = (percent * sums[0] / 100 - sums[1]) / sums[2], sums[3]
    above = F.lit(level) * F.col("weight") > limit
    return found.withColumn("target", F.when(above, limit.cast("double")).otherwise(F.lit(level) * F.col("weight")))


def _points(total: int):
    """Slot numbers to places in 0 .. total - 1 by the golden ratio's sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch["slot"].to_numpy().astype(np.uint64)
            place = np.minimum((i * _GOLDEN).astype(np.float64) / 2.0**64 * total, total - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["slot"], pa.array(place)], ["slot", "place"])

    return run


def schedule(plan: DataFrame, block_words: int = 1024) -> DataFrame:
    """(slot, sid, rank, block, words) of every slot of the mix, in order of (slot, sid); plan as targets gives it.

    A slot takes `words` words from the beginning of a source's block: all of it, but for the last slot of a source, which takes what
    is left of its rounded target. Turns of a source beyond its number of slots are passed over; the few that the sequence leaves a
    source short come after all others.
    """
    spark = plan.sparkSession
    goal, size = F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size")
    some = plan.where((size > 0) & (goal > 0)).select("sid", "source_size", goal.alias("goal"))
    some = some.withColumns({"blocks": F.ceil(size / block_words).cast("long"), "whole": F.floor(F.col("goal") / size).cast("long")})
    some = some.withColumn("slots", F.col("whole") * F.col("blocks") + F.ceil((F.col("goal") - F.col("whole") * size) / block_words).cast("long"))
    some = some.withColumns({"all": F.lit(0), "part": F.floor(F.col("sid") / _CHUNK)})
    some = materialize(along(some, "all", "part", [F.col("sid")], "slots", "low").drop("all", "part"), "slots")
    total = some.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    turns = spark.range(total).withColumnRenamed("id", "slot").mapInArrow(_points(total), "slot long, place long")
    cell = F.floor(F.col("place") / _CELL)
    reach = F.sequence(F.floor(F.col("low") / _CELL), F.floor((F.col("low") + F.col("slots") - 1) / _CELL))
    cells = some.select("sid", "low", "slots", F.explode(reach).alias("cell"))
    turns = turns.withColumn("cell", cell).join(if_small(cells), "cell").where("place >= low and place < low + slots")
    turns = turns.select("sid", "slot", F.floor(F.col("slot") / _CHUNK).alias("part"), F.lit(1).alias("one"))
    turns = materialize(along(turns, "sid", "part", [F.col("slot")], "one", "rank").select("sid", "slot", "rank"), "turns")
    given = turns.groupBy("sid").agg(F.count("*").alias("given"))
    short = some.join(if_small(given), "sid", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < slots")
    late = short.select("sid", F.explode(F.sequence("given", F.col("slots") - 1)).alias("rank"), "given").select("sid", (F.col("rank") - F.col("given") + total).alias("slot"), "rank")
    found = turns.union(late).join(if_small(some), "sid").where("rank < slots")
    block = F.pmod("rank", "blocks")
    full = F.least(F.lit(block_words), size - block * block_words)
    left = F.col("goal") - F.col("whole") * size - block * block_words
    words = F.when(F.col("rank") < F.col("whole") * F.col("blocks"), full).otherwise(F.least(full, left))
    return found.select("slot", "sid", "rank", block.alias("block"), words.cast("long").alias("words"))


def places(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs (source, key string, size, further columns) with sid and start: where each begins on its source's shuffled line.

    Rows are in order of key. Equal rows are counted together, so that copies of a row are not in one group.
    """
    columns = [c for c in docs.columns if c != "source"]
    own = docs.join(if_small(plan.select("sid", F.col("source").alias("__source"))), F.col("source").eqNullSafe(F.col("__source")))
    equal = own.groupBy("sid", *columns).agg(F.count("*").alias("copies")).withColumns({"part": F.substring("key", 1, 3), "width": F.col("size") * F.col("copies")})
    order = [F.col(c) for c in ["key", *(c for c in columns if c != "key")]]
    placed = along(equal, "sid", "part", order, "width", "start")
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return each.withColumn("start", F.col("start") + F.col("copy") * F.col("size")).select("sid", *columns, "start")


def taken(placed: DataFrame, slots: DataFrame, block_words: int = 1024) -> DataFrame:
    """placed (sid, start, size, further columns) with taken: how many of its words all slots take, repeats counted."""
    uses = slots.groupBy("sid", "block", "words").agg(F.count("*").alias("uses"))
    some = placed.where("size > 0")
    reach = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))
    parts = some.withColumn("block", F.explode(reach)).join(if_small(uses), ["sid", "block"], "left")
    low = F.col("block") * block_words
    overlap = F.greatest(F.least(F.col("start") + F.col("size"), low + F.col("words")) - F.greatest(F.col("start"), low), F.lit(0))
    found = parts.groupBy(*placed.columns).agg(F.coalesce(F.sum(overlap * F.col("uses")), F.lit(0)).alias("taken"))
    return found.union(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")))


def mix(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2, block_words: int = 1024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> tuple[DataFrame, DataFrame]:
    """(documents, schedule). Documents: doc_id, source, size, source_size, target, taken, sid, start of every row of docs; schedule: the slots.

    Slot (sid, block, words) is the words block * block_words up to `words` more on the line of source sid, on which documents
    stand at start .. start + size. A null text has size 0; nulls in source are a source, the last; the order on a line is that of the
    digest of id and text, the same in every run. Repeated rows are rows of their own. A document is taken at most `most` times.
    An empty table, or one without words, takes nothing. Other columns are not read.
    """
    prepare(docs.sparkSession)
    key = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("binary"))))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key")), "sizes")
    plan = targets(rows.select("source", "size"), weights, percent, most)  # read from a table of sources
    slots = schedule(plan, block_words)  # read from a table of turns
    found = taken(places(rows, plan), slots, block_words)
    found = found.join(if_small(plan), "sid")
    return found.select("doc_id", "source", "size", "source_size", "target", "taken", "sid", "start"), slots
