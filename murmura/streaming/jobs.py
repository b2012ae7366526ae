"""Streaming forms: windowed counts with late rows, first-seen rows, and keyed state by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.vectors import refreshed, upserted
from ..sources.sinks import Table


def weekly_counts(events: DataFrame, key: str, time_col: str = "ts", late: str = "1 day") -> DataFrame:
    """(week, key, n) of weeks that begin on Sunday 16:30; rows later than `late` are left out."""
    window = F.window(time_col, "7 days", "7 days", "3 days 16 hours 30 minutes")
    return events.withWatermark(time_col, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("week"), key, "n")


def first_seen(events: DataFrame, keys: list[str], time_col: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each key within the time that late rows are waited for."""
    return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def state_writer(path: str, keys: list[str], order: str, keep: int = 3, buckets: int = 64, run: str = "state") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: state under path, of each key the latest row. A batch rewrites only the buckets that its keys fall in.

    A batch that is run again changes nothing: the table's log names the last one of a run. Give a new run with a new checkpoint. The last
    `keep` versions stay, what only older ones name goes.
    """

    def write(batch: DataFrame, number: int) -> None:
        table = Table(batch.sparkSession, path, batch.schema.toDDL(), keys, buckets)
        batch = batch.persist()  # read for its buckets and for its rows
        try:
            table.change(lambda old: upserted(old, batch, keys, order), batch, (run, number))
        finally:
            batch.unpersist()
        table.drop_old(keep)

    return write


def index_writer(path: str, key: str = "source_file", operation: str = "operation", keep: int = 3, buckets: int = 64, run: str = "index") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: an index by source, from change rows (index columns, operation): sources of a batch are removed, and its
    rows that are not `deleted` put in, bucket by bucket. A batch that is run again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            fresh = batch.where(F.col(operation) != "deleted").drop(operation)
            table = Table(batch.sparkSession, path, fresh.schema.toDDL(), [key], buckets)
            table.change(lambda old: refreshed(old, fresh, batch.select(key), key).select(*fresh.columns), batch, (run, number))
        finally:
            batch.unpersist()
        table.drop_old(keep)

    return write
