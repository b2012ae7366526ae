"""Writers: tables with a commit log, chunk and vector files, manifests, audit rows, column updates, reports.

A table that changes is a log of commits: an entry names the folders that make up a version, one for each bucket of keys. Rows are
written beside what is there; then the next entry is put in place, which only one writer can do, so another that began from the same
version fails and begins again. Readers see whole versions. A change rewrites only the buckets that its keys fall in.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import VECTOR, with_columns


class Stale(RuntimeError):
    """Another writer has committed since the version that a change began from."""


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in place as a whole unless there is one; whether it was put. The store's rename must refuse a name that is
    taken, as HDFS does; on local disks, a hard link does."""
    files, place = _at(spark, path)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    files.mkdirs(place.getParent())
    stream = files.create(_at(spark, temporary)[1], True)
    stream.write(text.encode())
    stream.close()
    try:
        if files.getUri().getScheme() != "file":
            return files.rename(_at(spark, temporary)[1], place)
        local = lambda p: p.removeprefix("file:")
        os.link(local(temporary), local(path))
        return True
    except FileExistsError:
        return False
    finally:
        files.delete(_at(spark, temporary)[1], False)


class Table:
    """A table in any store that Spark reads and whose rename refuses a name that is taken. Writers and readers may be many.

    With keys and buckets, rows are dealt by the hash of their keys, and a change reads and writes the buckets of its keys only.
    form is the rows' file format: parquet or json.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] | list[str] = (), buckets: int = 1, form: str = "parquet") -> None:
        if buckets > 1 and not keys:
            raise ValueError("buckets need keys")
        self.spark, self.path, self.schema, self.keys, self.buckets, self.form = spark, path.rstrip("/"), schema, tuple(keys), buckets, form

    def versions(self) -> list[int]:
        """Numbers of the versions that are left, oldest first."""
        files, place = _at(self.spark, f"{self.path}/_log")
        names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
        return sorted(int(n[:8]) for n in names if n.endswith(".json") and n[:8].isdigit() and len(n) == 13)

    def entry(self, version: int | None = None) -> dict:
        """What a version's log entry says: version, parts (bucket to folder) and the batches that it has taken in."""
        version = (self.versions() or [0])[-1] if version is None else version
        if not version:
            return {"version": 0, "parts": {}, "batches": {}, "buckets": self.buckets}
        files, place = _at(self.spark, f"{self.path}/_log/{version:08d}.json")
        stream = files.open(place)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _rows(self, entry: dict, only: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{f}" for k, f in entry["parts"].items() if only is None or int(k) in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.format(self.form)
        return with_columns((found.schema(self.schema) if self.form == "json" else found).load(folders), self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """A version, by default the last; empty before the first."""
        return self._rows(self.entry(version))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def write(self, rows: DataFrame) -> dict[str, str]:
        """Put rows beside what is there and return bucket to folder; they count once they are committed."""
        rows, folder = with_columns(rows, self.schema), f"data/{uuid.uuid4().hex}"
        if self.buckets == 1:
            rows.write.format(self.form).save(f"{self.path}/{folder}")
            return {"0": folder}
        rows.withColumn("__bucket", self.bucket()).repartition("__bucket").write.partitionBy("__bucket").format(self.form).save(f"{self.path}/{folder}")
        files, place = _at(self.spark, f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()]
        return {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith("__bucket=")}

    def commit(self, base: dict, parts: dict[str, str], gone: list[int] = (), batch: tuple[str, int] | None = None) -> dict:
        """Make a version of base's parts without the buckets `gone`, and new ones over them. Stale if base is not the last any more."""
        kept = {k: f for k, f in base["parts"].items() if int(k) not in set(gone)}
        entry = {"version": base["version"] + 1, "parts": kept | parts, "batches": base["batches"] | ({batch[0]: batch[1]} if batch else {}), "buckets": self.buckets}
        if not _put_once(self.spark, f"{self.path}/_log/{entry['version']:08d}.json", json.dumps(entry)):
            raise Stale(f"{self.path}: version {entry['version']} is another writer's")
        return entry

    def change(self, make: Callable[[DataFrame], DataFrame], touched: DataFrame | None = None, batch: tuple[str, int] | None = None, tries: int = 5) -> dict:
        """Replace rows by make(rows): those in the buckets of touched (with the key columns), or all. The new log entry.

        make gives rows of the same buckets only. If another writer commits meanwhile, the change is made again from its version. A batch
        (name of the run, number) that the table has taken in already changes nothing.
        """
        for _ in range(tries):
            base = self.entry()
            if base["buckets"] != self.buckets and base["version"]:
                raise ValueError(f"{self.path} has {base['buckets']} buckets")
            if batch and base["batches"].get(batch[0], -1) >= batch[1]:
                return base
            some = list(range(self.buckets)) if touched is None or self.buckets == 1 else [r.b for r in touched.select(self.bucket().alias("b")).distinct().collect()]
            parts = self.write(make(self._rows(base, some)))
            try:
                return self.commit(base, parts, some, batch)
            except Stale:
                self._delete({f.split("/__bucket=")[0] for f in parts.values()})
        raise Stale(f"{self.path}: {tries} other commits")

    def replace(self, rows: DataFrame) -> int:
        """Make rows the next version and return its number of rows."""
        self.change(lambda _: rows)
        return self.read().count()

    def _delete(self, folders: set[str]) -> None:
        for name in folders:
            files, place = _at(self.spark, f"{self.path}/{name}")
            files.delete(place, True)

    def drop_old(self, keep: int = 2) -> None:
        """Forget all but the last versions, and delete the folders that only they named."""
        numbers = self.versions()
        entries = {n: self.entry(n) for n in numbers}
        used = {f for n in numbers[-keep:] for f in entries[n]["parts"].values()}
        old = {f for n in numbers[:-keep] for f in entries[n]["parts"].values()} - used
        whole = {f.split("/__bucket=")[0] for f in used}
        for n in numbers[:-keep]:
            self._delete({f"_log/{n:08d}.json"})
        self._delete(old | {f.split("/__bucket=")[0] for f in old} - whole)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], latest: str) -> DataFrame:
    """Old and new rows, of each key the latest one (by that column; of equal ones the new). The rest of a row comes with it."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    row = F.struct(*[c for c in both.columns if c not in keys])
    best = both.groupBy(*keys).agg(F.max_by(row, F.struct(F.col(latest), F.col("__new"))).alias("__row"))
    return best.select(*keys, "__row.*").drop("__new").select(*old.columns)


def without(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those that go."""
    return old.join(gone.select(key).distinct(), key, "left_anti").select(*old.columns)


def upsert(table: Table, new: DataFrame, keys: list[str], latest: str) -> int:
    """Put new rows in, of each key the latest; the number of rows then. Of a bucketed table only their buckets are rewritten."""
    new = with_columns(new, table.schema)
    table.change(lambda old: upserted(old, new, keys, latest), new)
    return table.read().count()


def delete(table: Table, gone: DataFrame, key: str) -> int:
    """Remove rows by key and return how many went."""
    before = table.read().count()
    table.change(lambda old: without(old, gone, key), gone if table.keys == (key,) else None)
    return before - table.read().count()


def add_vectors(table: Table, new: DataFrame) -> int:
    """Add vectors; of an id that is there already, the new row counts."""
    rows = with_columns(new, VECTOR)
    table.change(lambda old: without(old, rows, "id").unionByName(rows), rows if table.keys == ("id",) else None)
    return table.read().count()


def drop_duplicates(table: Table, keys: list[str], order: str) -> int:
    """Keep of each key the row with the least order, and return how many rows went."""
    before = table.read().count()

    def least(old: DataFrame) -> DataFrame:
        row = F.struct(*[c for c in old.columns if c not in keys])
        return old.groupBy(*keys).agg(F.min_by(row, order).alias("__row")).select(*keys, "__row.*").select(*old.columns)

    table.change(least)
    return before - table.read().count()


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON, a folder for each source document (stem); files.written_chunks reads them."""
    chunks.repartition("stem").write.partitionBy("stem").mode("overwrite").json(path)


def write_vectors_json(vectors: DataFrame, path: str) -> None:
    """Ids and vectors as JSON, a line each; files.vectors_json reads them."""
    vectors.select("id", "embedding").write.mode("overwrite").json(path)


def hierarchy_json(tree: DataFrame) -> DataFrame:
    """(shop, value): the nested JSON of each shop's tree (shop, tier, progress, intent): tiers, their progress, their intents in order."""
    by = lambda key: lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0)
    intents = tree.groupBy("shop", "tier", "progress").agg(F.array_sort(F.collect_set("intent")).alias("intents"))
    steps = intents.groupBy("shop", "tier").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("progress", "intents")))).alias("steps"))
    return steps.groupBy("shop").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier", "steps")), by("tier")))).alias("value"))


def reset(table: Table) -> int:
    """Empty a table."""
    return table.replace(table.read().limit(0))


def column_updates(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """rows with the columns that updates names: its value where it is not null. Updates have a key once; unknown columns are an error."""
    columns = [c for c in updates.columns if c != key]
    if unknown := set(columns) - set(rows.columns):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    renamed = updates.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def audit_rows(rows: DataFrame, limits: dict[str, int], campaign: str = "campaign_id", note: str = "comment") -> DataFrame:
    """Rows as the audit log stores them: texts cut to their limits, times to seconds, the campaign at the end of the note."""
    out = rows.withColumn("create_time", F.date_trunc("second", "create_time"))
    mark = F.when(F.trim(F.col(campaign).cast("string")) != "", F.concat(F.lit("[campaign_id="), F.col(campaign).cast("string"), F.lit("]")))
    out = out.withColumn(note, F.trim(F.concat_ws(" ", F.col(note), mark)))
    return out.withColumns({c: F.substring(c, 1, n) for c, n in limits.items()}).drop(campaign)


def preview(chunks: DataFrame) -> DataFrame:
    """(source_file, value): Markdown of each chunk, for people to read; write it as text, by file."""
    text = F.format_string("## %s: %s\n\n- language: %s\n\n%s\n", F.coalesce("id", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("language", F.lit("")), F.coalesce("content", F.lit("")))
    return chunks.select("source_file", text.alias("value"))


def csv_with_mark(rows: DataFrame, path: str, order: list[Column]) -> None:
    """A CSV with header that spreadsheets open as UTF-8 (byte order mark in its first column's name), sorted as a whole."""
    first, *others = rows.columns
    rows.orderBy(*order).select(F.col(first).alias("﻿" + first), *others).write.option("header", "true").csv(path)
