"""Knowledge records: layers, overlays, vocabularies, validation, scopes, headings and one-to-one assignment."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import dealt, if_small

GENERAL = "GEN"


def joined_by_last(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Inner join with the last row of right for each key; rows without a partner are left out."""
    columns = [c for c in right.columns if c not in keys]
    last = right.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("last"))
    return left.join(last, keys).select(*left.columns, "last.*")


def layered(layers: Iterable[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several layers, an earlier layer's row over a later one's with the same keys. A layer has a key once."""
    rows = None
    for n, layer in enumerate(layers):
        layer = layer.withColumn("__layer", F.lit(n))
        rows = layer if rows is None else rows.unionByName(layer)
    columns = [c for c in rows.columns if c not in (*keys, "__layer")]
    chosen = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), "__layer").alias("row"))
    return chosen.select(*keys, "row.*")


def replaced_by_prefix(records: DataFrame, fresh: DataFrame, column: str, prefixes: Iterable[str]) -> DataFrame:
    """Records without those whose column begins with a prefix, and the fresh ones."""
    stays = F.lit(True)
    for p in prefixes:
        stays = stays & ~F.coalesce(F.startswith(F.col(column), F.lit(p)), F.lit(False))
    return records.where(stays).unionByName(fresh)


def merged_values(existing: DataFrame, incoming: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, added): existing values, and incoming ones that no existing one equals in any case, each once."""
    folded = lambda df: df.withColumn("__low", F.lower(value))
    fresh = folded(incoming).groupBy(*keys, "__low").agg(F.min(value).alias(value))
    fresh = fresh.join(folded(existing).select(*keys, "__low").distinct(), [*keys, "__low"], "left_anti")
    return existing.select(*keys, value, F.lit(False).alias("added")).unionByName(fresh.select(*keys, value, F.lit(True).alias("added")))


def fields_of(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value) of every value in array columns: one row for each, read in one pass."""

    def entries(f: str) -> Column:
        return F.transform(F.coalesce(f, F.array().cast("array<string>")), lambda v: F.struct(F.lit(f).alias("field"), v.alias("value")))

    return records.select(key, F.inline(F.concat(*map(entries, fields))))


def invalid_values(records: DataFrame, allowed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value) of values outside allowed (field, value); a field without allowed values takes any."""
    rows = fields_of(records, key, fields).join(if_small(allowed.groupBy("field").agg(F.lit(True).alias("known"))), "field", "left_semi")
    return rows.join(allowed, ["field", "value"], "left_anti").select(key, "field", "value")


def allowed_intents(hierarchy: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope_id, intent, path) of scopes (scope_id, shop, tier, progress) in hierarchy (shop, tier, progress, intent): the union
    of the scope's own path, its tier at any progress, any tier at its progress, any tier and progress, and what holds for
    all shops (for shops that are known). path is the first of these, from 0; names are compared in any case.

    Scopes that are alike ask once, by hash: five rows for each different (shop, tier, progress), no theta join. What they find is put in the place of
    all of them, without grouping rows of scopes; only a scope_id that stands for several is grouped.
    """
    low = [F.lower(c).alias(c) for c in ("shop", "tier", "progress")]
    tree = hierarchy.select(*low, "intent").distinct()
    general = F.lit(GENERAL.lower())
    shop, tier, progress = (F.col(c) for c in ("shop", "tier", "progress"))
    paths = [(shop, tier, progress), (shop, tier, general), (shop, general, progress), (shop, general, general), (general, general, general)]
    made = F.array(*[F.struct(F.lit(n).alias("path"), s.alias("shop"), t.alias("tier"), p.alias("progress")) for n, (s, t, p) in enumerate(paths)])
    known = tree.select("shop").distinct()
    scope = F.struct(*low).alias("scope")
    alike = scopes.select(scope).distinct().select("scope.*").join(known, "shop", "left_semi").withColumn("scope", F.struct("shop", "tier", "progress"))
    found = alike.select("scope", F.inline(made)).join(tree, ["shop", "tier", "progress"]).groupBy("scope", "intent").agg(F.min("path").alias("path"))
    found = found.groupBy(F.md5(F.to_json("scope")).alias("alike")).agg(F.collect_list(F.struct("intent", "path")).alias("found"))
    asked = dealt(scopes.select("scope_id", F.md5(F.to_json(scope)).alias("alike")), "scope_id").groupBy("scope_id").agg(F.min("alike").alias("alike"), F.max("alike").alias("last"))
    one = asked.where("alike <=> last").select("scope_id", "alike")
    twice = asked.where("alike <> last").select(F.col("scope_id").alias("id"))
    several = scopes.select("scope_id", F.md5(F.to_json(scope)).alias("alike")).join(if_small(twice), F.col("scope_id").eqNullSafe(F.col("id")), "left_semi")
    found = if_small(found)
    merged = several.join(found, "alike").select("scope_id", F.inline("found")).groupBy("scope_id", "intent").agg(F.min("path").alias("path"))
    return one.join(found, "alike").select("scope_id", F.inline("found")).union(merged)


def filled_down(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each null replaced by the last value before it within its keys."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in columns})


def resolved_names(declared: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, resolved, how) of declared (name) in catalog (name): the same, or without a doubled .html at its end; else itself."""
    bare = F.when(F.col("name").rlike(r"\.(txt|html)\.html$"), F.regexp_replace("name", r"\.html$", ""))
    known = catalog.select(F.col("name").alias("found")).distinct()
    asked = declared.select("name").distinct().withColumn("bare", bare)
    rows = asked.join(known, F.col("name") == F.col("found"), "left").withColumnRenamed("found", "same")
    rows = rows.join(known, F.col("bare") == F.col("found"), "left").withColumnRenamed("found", "repaired")
    how = F.when(F.col("same").isNotNull(), "same").when(F.col("repaired").isNotNull(), "repaired").otherwise("unknown")
    return rows.select("name", F.coalesce("same", "repaired", "name").alias("resolved"), how.alias("how"))


def assigned(scores: DataFrame, group: str = "shop", least: float = 0.0, ties: Column | None = None) -> DataFrame:
    """(group, slot, value, score, and ties if given): greedily one value for each slot and one slot for each value, by (-score, slot, ties, value).

    scores (group, slot, value, score) has each pair once. Greedy choice is made by rounds: a pair goes in once it is the best
    left for its slot and for its value. Each round is two minimums with map-side combining, so no group is held by one task,
    and is checkpointed. Sides are never broadcast: sizes that Spark derives from files, through generators and checkpoints, are far too small.
    """
    checkpoint_dir(scores.sparkSession)
    key = F.struct((-F.col("score")).alias("worse"), "slot", *([] if ties is None else [ties.alias("ties")]), "value").alias("key")
    left = scores.where(F.col("score") >= least).select(group, "slot", "value", key).checkpoint()
    chosen = left.select(group, "key").limit(0)
    while not left.isEmpty():
        by_slot, by_value = (left.groupBy(group, c).agg(F.min("key").alias("key")).select(group, "key") for c in ("slot", "value"))
        best = by_slot.join(by_value.hint("merge"), [group, "key"]).checkpoint()
        chosen = chosen.union(best)
        for c in ("slot", "value"):
            left = left.join(best.select(group, F.col(f"key.{c}").alias(c)).hint("merge"), [group, c], "left_anti")
        left = left.select(group, "slot", "value", "key").checkpoint()
    return chosen.select(group, "key.slot", "key.value", (-F.col("key.worse")).alias("score"), *([] if ties is None else ["key.ties"]))


def where_of(conditions: dict[str, object]) -> Column:
    """A filter from a context: a value must be equal, of several one; blanks, GEN and lists of these alone don't constrain."""
    out = F.lit(True)
    for name, wanted in conditions.items():
        values = [v for v in (wanted if isinstance(wanted, (list, tuple, set)) else [wanted]) if v is not None and str(v).strip() not in ("",) and str(v).upper() != GENERAL]
        if values:
            out = out & (F.col(name) == values[0] if len(values) == 1 else F.col(name).isin(*values))
    return out
