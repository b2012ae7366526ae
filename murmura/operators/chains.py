"""Negotiation chains: paths of nodes from their entries, the chain of a shop or the default one, and records made along it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import merged, without_prefixes
from ..session import checkpoint_dir
from .common import if_small

GENERAL = "GEN"


def chains(nodes: DataFrame) -> DataFrame:
    """(shop, entry, node, place, previous, is_end) of nodes (shop, node, next) that an entry reaches; place counts from 1.

    An entry is a node that none names as its next. Of several nodes with the same next, the least one goes on with it. Nodes on a circle
    have no entry and are left out; so are names that are no nodes. Pointers to earlier nodes are doubled in each round, so that rounds grow with the
    logarithm of the longest chain, each of them two joins by (shop, node). Repeated nodes count once, with their least next.
    """
    checkpoint_dir(nodes.sparkSession)
    known = nodes.where("shop is not null and node is not null").groupBy("shop", "node").agg(F.min("next").alias("next")).checkpoint()
    before = known.where("next is not null and next <> node").groupBy("shop", F.col("next").alias("node")).agg(F.min("node").alias("previous"))
    none = F.lit(None).cast(known.schema["node"].dataType)
    # up: the farthest earlier node known so far, null once the entry (top) is found; steps: how far away that is
    step = known.select("shop", "node").join(before, ["shop", "node"], "left").withColumns({"up": F.col("previous"), "steps": F.col("previous").isNotNull().cast("long"), "top": F.when(F.col("previous").isNull(), F.col("node")).otherwise(none)})
    step = step.select("shop", "node", "previous", "up", "steps", "top").checkpoint()
    for _ in range(max(1, known.count()).bit_length() + 1):
        if step.where("up is not null").isEmpty():
            break
        above = step.select("shop", F.col("node").alias("up"), F.col("up").alias("__up"), F.col("steps").alias("__steps"), F.col("top").alias("__top"))
        met = step.join(above, ["shop", "up"], "left")
        step = met.select("shop", "node", "previous", F.col("__up").alias("up"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), F.coalesce("top", "__top").alias("top")).checkpoint()
    reached = step.where("top is not null").select("shop", F.col("top").alias("entry"), "node", (F.col("steps") + 1).alias("place"), "previous")
    goes_on = reached.where("previous is not null").select("shop", F.col("previous").alias("node"), F.lit(True).alias("__on")).distinct()
    return reached.join(goes_on, ["shop", "node"], "left").select("shop", "entry", "node", "place", "previous", F.col("__on").isNull().alias("is_end"))


def node_of(asked: DataFrame, paths: DataFrame, general: str = GENERAL) -> DataFrame:
    """asked (shop, round, further columns) with node and previous: the node at that place of the shop's chain, or of the default
    one where the shop has none; null beyond the chain. paths (shop, node, place, previous) has one chain a shop."""
    own = paths.select("shop", F.lit(True).alias("__own")).distinct()
    rows = asked.join(if_small(own), "shop", "left").withColumn("__shop", F.when(F.col("__own"), F.col("shop")).otherwise(F.lit(general)))
    places = paths.select(F.col("shop").alias("__shop"), F.col("place").alias("__place"), "node", "previous")
    return rows.join(if_small(places), (rows["__shop"] == places["__shop"]) & (rows["round"] == places["__place"]), "left").select(*asked.columns, "node", "previous")


@dataclass(frozen=True)
class Template:
    """A record that each shop gets: its id, the ids (beginnings, in order of preference) of the record that it starts from, what it
    sets, and the flags that it adds to its base's or, without keep_flags, has alone."""

    id: str
    bases: tuple[str, ...]
    sets: dict[str, str] = field(default_factory=dict)
    flags: tuple[str, ...] = ()
    keep_flags: bool = True


def synthesised(records: DataFrame, templates: list[Template], dropped: tuple[str, ...], stripped: tuple[str, ...] = ()) -> DataFrame:
    """records (shop, id, place, flags array, further string columns) without those whose id begins with one of `dropped`, and a record of each template for
    each shop.

    A template's record starts from the first record (by place) of the first of its bases that the shop has, or from nothing. Flags
    that begin with one of `stripped` go from all. The first record of each base is found by one grouped minimum, not by collecting a shop.
    """
    texts = [c for c in records.columns if c not in ("shop", "id", "place", "flags")]
    none = F.array().cast("array<string>")
    starts = lambda name, prefixes: _any([F.startswith(F.col(name), F.lit(p)) for p in prefixes])
    shops = records.select("shop").distinct()
    wanted = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("preference"), F.lit(b).alias("base")) for n, t in enumerate(templates) for k, b in enumerate(t.bases)])
    listed = records.where(starts("id", tuple({b for t in templates for b in t.bases}))).select("*", F.inline(wanted)).where(F.startswith("id", F.col("base")))
    first = listed.groupBy("shop", "n").agg(F.min_by(F.struct("flags", *texts), F.struct("preference", "place", "id")).alias("first"))
    each = F.array(*[
        F.struct(
            F.lit(n).alias("n"), F.lit(t.id).alias("id"), F.array(*map(F.lit, t.flags)).cast("array<string>").alias("more"), F.lit(t.keep_flags).alias("keeps"),
            *[F.lit(t.sets.get(c)).cast("string").alias(f"set_{c}") for c in texts],
        ) for n, t in enumerate(templates)
    ])
    made = shops.select("shop", F.inline(each)).join(first, ["shop", "n"], "left")
    flags = merged(F.when(F.col("keeps"), F.coalesce("first.flags", none)).otherwise(none), F.col("more"))
    made = made.select("shop", "id", F.col("n").cast("long").alias("place"), flags.alias("flags"), *[F.coalesce(f"set_{c}", f"first.{c}").alias(c) for c in texts])
    kept = records.where(~starts("id", dropped)) if dropped else records
    out = made.unionByName(kept.withColumn("place", F.col("place") + len(templates)))
    return out.withColumn("flags", without_prefixes(F.coalesce("flags", none), stripped)) if stripped else out


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out
