"""Plug points: makers of records, fetchers of rows, embedders, by name; and fuzzy names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import if_small

Maker = Callable[[DataFrame], DataFrame]
#: What turns a batch of texts into vectors; it is sent to executors and called there, a batch at a time.
Embedder = Callable[[list[str]], list[list[float]]]

MAKERS: dict[str, Maker] = {}


def maker(name: str) -> Callable[[Maker], Maker]:
    """Register a function of records to records under a name."""

    def add(f: Maker) -> Maker:
        if name in MAKERS:
            raise ValueError(f"already registered: {name}")
        MAKERS[name] = f
        return f

    return add


def made(records: DataFrame, name: str) -> DataFrame:
    """records by the maker of that name; an unknown name is an error that lists those known."""
    if name not in MAKERS:
        raise KeyError(f"{name} is none of {sorted(MAKERS)}")
    return MAKERS[name](records)


def hashed_embedder(size: int = 64) -> Embedder:
    """Vectors of length 1 from hashes of words: the same everywhere, without a model. A text without words is all zeros."""

    def embed(texts: list[str]) -> list[list[float]]:
        import xxhash

        out = []
        for text in texts:
            v = np.zeros(size)
            for word in text.lower().split():
                h = xxhash.xxh3_64_intdigest(word)
                v[h % size] += 1 if h >> 63 else -1
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return out

    return embed


def embedded(chunks: DataFrame, embed: Embedder, batch: int = 64) -> DataFrame:
    """chunks (id, text, ...) with embedding array<double>, in batches of texts; rows without id or text are left out."""
    if not 1 <= batch <= 2048:
        raise ValueError("batch must be from 1 to 2048")
    rows = chunks.where((F.trim("id") != "") & (F.trim("text") != ""))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = embed(part["text"].tolist())
                if len(vectors) != len(part):
                    raise ValueError(f"{len(part)} texts, {len(vectors)} vectors")
                yield part.assign(embedding=vectors)

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("embedding", ArrayType(DoubleType()))]))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def aligned_names(declared: DataFrame, catalog: DataFrame, least: float = 0.96) -> DataFrame:
    """(declared, name) of each declared name: the catalog's name if it is there, else the only one that is at least so similar,
    else null.

    A name of n letters that is as similar differs by at most e = n (1 - least) / least edits, so one of its e + 1 pieces of equal
    length stands unchanged in the other, moved by at most e letters: names meet by (n, piece, letters), and no others are compared.
    Only declared names that the catalog lacks ask.
    """
    d, c = declared.select("declared").distinct(), catalog.select("name").distinct()
    exact = d.join(c, d["declared"] == c["name"], "left").select("declared", F.col("name").alias("same"))
    edits = lambda n: F.floor(n * ((1 - least) / least) + 1e-9).cast("int")
    begin = lambda n, i, e: F.floor(n * i / (e + 1)).cast("int")
    key = lambda n, i, text: F.concat_ws("|", n, i, text)

    n = F.length("name")
    own = F.transform(F.sequence(F.lit(0), edits(n)), lambda i: key(n, i, F.substring(F.col("name"), begin(n, i, edits(n)) + 1, begin(n, i + 1, edits(n)) - begin(n, i, edits(n)))))
    right = c.where(n > 0).select("name", F.explode(own).alias("key"))
    left = exact.where("same is null").select("declared", F.length("declared").alias("l"))
    most = edits(F.col("l") + F.ceil(F.col("l") * (1 - least) / least).cast("int") + 1)
    left = left.where("l > 0").select("declared", F.explode(F.sequence(F.greatest(F.col("l") - most, F.lit(1)), F.col("l") + most)).alias("n"))
    left = left.select("declared", "n", edits(F.col("n")).alias("e")).select("declared", "n", "e", F.explode(F.sequence(F.lit(0), F.col("e"))).alias("i"))
    left = left.select("declared", "n", "i", begin(F.col("n"), F.col("i"), F.col("e")).alias("b"), begin(F.col("n"), F.col("i") + 1, F.col("e")).alias("to"), F.explode(F.sequence(-F.col("e"), F.col("e"))).alias("move"))
    left = left.where("b + move >= 0").select("declared", key(F.col("n"), F.col("i"), F.substring(F.col("declared"), F.col("b") + F.col("move") + 1, F.col("to") - F.col("b"))).alias("key")).distinct()
    near = left.join(if_small(right), "key").select("declared", "name").distinct().where(similarity(F.col("declared"), F.col("name")) >= least)
    only = near.groupBy("declared").agg(F.count("*").alias("n"), F.min("name").alias("near")).where("n = 1").select("declared", "near")
    return exact.join(only, "declared", "left").select("declared", F.coalesce("same", "near").alias("name"))
