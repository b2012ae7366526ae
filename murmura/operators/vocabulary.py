"""Vocabularies: values and aliases merged with a change log, and classes of names that stand for each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: A change's columns. kind is value or alias (canon: what it stands for); action is kept, inserted or rejected.
CHANGE = "field string, kind string, canon string, item string, action string, reason string"


def merged(values: DataFrame, aliases: DataFrame, new_values: DataFrame, new_aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, log) of values (field, value) and aliases (field, canon, alias), and new ones of each: two outputs of one pass.

    Names are compared in lower case and without white space at their ends. What was there stays as it was spelled; a new name comes in
    once, in the least spelling. Rejected are blank names (blank), fields that the vocabulary lacks (unknown_field), aliases that
    equal what they stand for (same_as_canon), and names that are there already (known). vocabulary has (field, kind, canon, item)
    of kept and inserted rows; log has CHANGE of inserted and rejected ones. Null fields are unknown ones.
    """
    checkpoint_dir(values.sparkSession)

    def rows(df: DataFrame, kind: str, old: bool) -> DataFrame:
        canon = F.trim("canon") if kind == "alias" else F.lit(None).cast("string")
        return df.select("field", F.lit(kind).alias("kind"), canon.alias("canon"), F.trim("value" if kind == "value" else "alias").alias("item"), F.lit(old).alias("old"))

    every = rows(values, "value", True).union(rows(aliases, "alias", True)).union(rows(new_values, "value", False)).union(rows(new_aliases, "alias", False))
    fold = lambda c: F.lower(F.coalesce(c, F.lit("")))
    grouped = every.groupBy("field", "kind", fold("canon").alias("__canon"), fold("item").alias("__item")).agg(
        F.min(F.when(F.col("old"), F.col("item"))).alias("there"), F.min(F.when(~F.col("old"), F.col("item"))).alias("new"), F.count(F.when(~F.col("old"), 1)).alias("asked"),
        F.min_by("canon", F.struct(~F.col("old"), "canon")).alias("canon"),
    )
    fields = grouped.where("there is not null").select("field", F.lit(True).alias("__known")).distinct()
    marked = grouped.join(fields, "field", "left")
    bad = (
        F.when(F.col("there").isNotNull(), F.when(F.col("asked") > 0, "known")).when(F.col("__item") == "", "blank").when(F.col("__known").isNull(), "unknown_field")
        .when((F.col("kind") == "alias") & (F.col("__item") == F.col("__canon")), "same_as_canon")
    )
    # each group is one decision: there and asked for again is kept in the vocabulary and rejected in the log
    action = F.when(F.col("there").isNotNull(), "kept").when(bad.isNotNull(), "rejected").otherwise("inserted")
    decided = marked.select("field", "kind", "canon", F.coalesce("there", "new").alias("item"), action.alias("action"), bad.alias("reason"), F.col("new").alias("asked_as")).checkpoint()
    vocabulary = decided.where("action in ('kept', 'inserted')").select("field", "kind", "canon", "item")
    again = (F.col("action") == "kept") & F.col("reason").isNotNull()
    log = decided.where((F.col("action") != "kept") | again).select("field", "kind", "canon", F.coalesce("asked_as", "item").alias("item"), F.when(again, "rejected").otherwise(F.col("action")).alias("action"), "reason")
    return vocabulary, log


def classes(aliases: DataFrame) -> DataFrame:
    """(field, name, head) of every name in aliases (field, canon, alias): names that chains of aliases connect are one class, whose
    head is its least name. Names are in lower case; nulls and blanks are left out.

    Heads are lowered to those of neighbours and then to the heads of heads until nothing changes; each round is two joins by
    (field, name), checkpointed.
    """
    checkpoint_dir(aliases.sparkSession)
    low = lambda c: F.lower(F.trim(c))
    edges = aliases.select("field", low("canon").alias("a"), low("alias").alias("b")).where("field is not null and a <> '' and b <> ''").distinct()
    both = edges.union(edges.select("field", "b", "a")).distinct().checkpoint()
    heads = both.groupBy("field", F.col("a").alias("name")).agg(F.least(F.min("b"), F.first("a")).alias("head")).checkpoint()
    while True:
        near = both.join(heads.select("field", F.col("name").alias("b"), "head"), ["field", "b"]).groupBy("field", F.col("a").alias("name")).agg(F.min("head").alias("near"))
        lower = heads.join(near, ["field", "name"]).select("field", "name", F.least("head", "near").alias("head"), F.col("head").alias("was")).checkpoint()
        of_head = lower.select("field", F.col("name").alias("head"), F.col("head").alias("top"))
        new = lower.join(of_head, ["field", "head"]).select("field", "name", F.least("head", "top").alias("head"), "was").checkpoint()
        heads = new.select("field", "name", "head")
        if new.where("head <> was").isEmpty():
            return heads
