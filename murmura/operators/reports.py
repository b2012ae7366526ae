"""Report aggregations, history timelines and deduplication."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def present(c: str | Column) -> Column:
    """Not null and not blank."""
    return F.trim(c) != ""


def same_name(c: str | Column) -> Column:
    """The form in which names are compared: trimmed, any case."""
    return F.lower(F.trim(c))


def within(df: DataFrame, start: str, end: str, time_col: str = "create_time") -> DataFrame:
    """Rows from start to end, both included (so rows on a boundary count in both neighbouring windows)."""
    return df.where(F.col(time_col).between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))


def counts_by(df: DataFrame, column: str, blank: str | None = None) -> DataFrame:
    """(column, n), blanks under a label of their own if one is given."""
    value = F.col(column) if blank is None else F.when(present(column), F.trim(column)).otherwise(F.lit(blank))
    return df.groupBy(value.alias(column)).agg(F.count("*").alias("n"))


def merged_counts(*parts: DataFrame) -> DataFrame:
    """Sums of (source, n) tables, with a rank by (-n, source)."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("source").agg(F.sum("n").alias("n"))


def enriched_showcase(showcase: DataFrame) -> DataFrame:
    """By user and campaign: whether any is open, how many, the greatest gmv as text, and the products in order."""
    return showcase.groupBy(same_name("user_name").alias("user_name"), "campaign_id").agg(
        F.max(F.when(F.col("status") == "A", 1).otherwise(0)).alias("is_open"), F.count("*").alias("n"), F.max("gmv").alias("gmv"),
        F.array_join(F.array_sort(F.collect_set(F.col("product_id").cast("string"))), ",").alias("products"),
    )


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key, by ascending order, which must decide ties; rows are combined before they are shuffled."""
    named = [(F.col(k) if isinstance(k, str) else k).alias(f"__{i}") for i, k in enumerate(keys)]
    first = F.min_by(F.struct(*df.columns), F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*named).agg(first.alias("__row")).select("__row.*")


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """The place of each row in its key from 1; order must decide ties.

    Rows are dealt and sorted by range of (keys, order), so that a hot key takes as many tasks as its rows need. A part numbers its
    own rows of a key as they come; what the parts before it hold of that key is added to the few keys that go over a part's end. The parts are
    cut in the checkpoint folder, the only time that whole rows are moved after they were dealt.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/murmura-numbered-{uuid.uuid4().hex}"
    place = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    parts = df.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("__part", F.spark_partition_id()).withColumn("__own", F.lit(0).cast("long"))
    parts = parts.mapInArrow(lambda batches: _numbers(batches, keys), parts.schema)
    parts.write.parquet(path)
    parts = spark.read.schema(parts.schema).parquet(path)
    sizes = parts.groupBy("__part", *keys).agg(F.count("*").alias("__n"))  # few rows: a key is in neighbouring parts
    by_part = Window.partitionBy(*keys).orderBy("__part")
    before = F.sum("__n").over(by_part.rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], before.alias("__before"), F.row_number().over(by_part).alias("__turn"))
    sizes = sizes.where("__turn > 1").drop("__turn")  # at most one key a part goes on from another
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__{i}"))
    return parts.join(F.broadcast(sizes), same, "left").select(*df.columns, (F.col("__own") + F.coalesce("__before", F.lit(0))).alias(name))


def _numbers(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of a sorted part with __own: each row's place among the rows of its keys, from 1."""
    last, done = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            c, valid = batch[k], batch[k].is_valid()
            differs = pc.or_(pc.fill_null(pc.not_equal(c[1:], c[:-1]), False), pc.not_equal(valid[1:], valid[:-1]))
            new[1:] |= differs.to_numpy(zero_copy_only=False)
        first = tuple(batch[k][0].as_py() for k in keys)
        done = done if first == last else 0
        at = np.arange(batch.num_rows)
        starts = np.maximum.accumulate(np.where(new, at, 0))
        own = at - starts + 1 + np.where(starts == 0, done, 0)
        last, done = tuple(batch[k][batch.num_rows - 1].as_py() for k in keys), int(own[-1])
        yield batch.set_column(batch.schema.get_field_index("__own"), "__own", pa.array(own, pa.int64()))


def timeline(*events: DataFrame) -> DataFrame:
    """(creator, dt, text, position) of events (creator, dt, text, source_no), by time with unknown times last, stable by source."""
    rows = events[0]
    for e in events[1:]:
        rows = rows.unionByName(e)
    return numbered(rows, ["creator"], [F.col("dt").asc_nulls_last(), F.col("source_no").asc(), F.col("text").asc()], "position")


def chunked_lines(df: DataFrame, keys: list[str], position: str, line: Column, size: int, name: str = "text") -> DataFrame:
    """Lines of each key in chunks of so many, from 0: (keys, chunk, name). However long a key is, a row is not."""
    return joined_lines(df.withColumn("chunk", F.floor((F.col(position) - 1) / size).cast("long")), [*keys, "chunk"], position, line, name)


def joined_lines(df: DataFrame, keys: list[str], order: str, line: Column, name: str = "text") -> DataFrame:
    """Lines of each key, in order, as one text. A key's lines must fit in a row."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return df.groupBy(*keys).agg(F.array_join(lines["line"], "\n").alias(name))


def participants(messages: DataFrame) -> DataFrame:
    """(conv_id, participants): roles in order of first appearance."""
    first = messages.groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    return first.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("t", "role")))["role"], ",").alias("participants"))


def paged(df: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """part from 0 of so many rows each within every key."""
    return numbered(df, keys, order, "part").withColumn("part", F.floor((F.col("part") - 1) / size).cast("long"))


def latest(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The value at the greatest order of each key, combined before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def tail_text(messages: DataFrame, last: int, chars: int) -> DataFrame:
    """(conv_id, text): the last messages of each conversation, cut to so many last characters."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = messages.withColumn("n", n).where(F.col("n") <= last)
    text = joined_lines(rows, ["conv_id"], "turn", F.concat(F.lit("["), "role", F.lit("] "), "text"))
    return text.select("conv_id", F.when(F.length("text") > chars, F.expr(f"right(text, {chars})")).otherwise(F.col("text")).alias("text"))


def week_start(ts: Column, sunday_belongs_back: bool = False) -> Column:
    """The Sunday 16:30 that begins a time's reporting week. Before 16:30 a Sunday belongs to the week before; with
    sunday_belongs_back it does all day."""
    day = F.date_trunc("day", ts)
    sunday = day - F.make_dt_interval(F.dayofweek(ts) - 1)
    start = sunday + F.expr("interval '16:30' hour to minute")
    back = (F.dayofweek(ts) == 1) if sunday_belongs_back else ((F.dayofweek(ts) == 1) & (ts < start))
    return F.when(back, start - F.expr("interval 7 days")).otherwise(start)
