"""Knowledge records: numbering, layers of vocabularies, slots, supplements, build plans, and what replies may use of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small

from ..functions.text import stripped, urls


def numbered_ids(records: DataFrame, document: str, order: list[str], prefix: str) -> DataFrame:
    """records with id `prefix-n` in each document, n from 1 in order, and unique_id: the given record id, from its second
    occurrence in the document on with `-2`, `-3`. Documents are bounded groups."""
    place = F.row_number().over(Window.partitionBy(document).orderBy(*order))
    again = F.row_number().over(Window.partitionBy(document, "record_id").orderBy(*order))
    unique = F.when(again == 1, F.col("record_id")).otherwise(F.concat("record_id", F.lit("-"), again))
    return records.withColumns({"id": F.concat(F.lit(prefix + "-"), place), "unique_id": unique})


def normalised(records: DataFrame, shop: Column, action_type: str = "action", policy_type: str = "policy") -> DataFrame:
    """Records (title, content, entitle, encontent, language, applicable_shops, rule_type, action, intent) in normal form: blanks
    as null, English text from the own where it is missing, the shop of the file in place of none or GEN. A record without title
    and content goes, unless it is an action (whose title is its intent)."""
    text = lambda c: F.nullif(stripped(F.col(c)), F.lit(""))
    fields = ("title", "content", "entitle", "encontent", "language", "applicable_shops", "rule_type", "action", "intent")
    r = records.withColumns({c: text(c) for c in fields})
    acts = (F.col("rule_type") == action_type) & F.col("action").isNotNull()
    r = r.withColumn("title", F.coalesce("title", F.when(acts, F.coalesce("intent", F.lit("Action trigger")))))
    own = F.when(F.col("applicable_shops").isNull() | (F.upper("applicable_shops") == "GEN"), F.coalesce(shop, F.col("applicable_shops"))).otherwise(F.col("applicable_shops"))
    out = r.withColumns({"entitle": F.coalesce("entitle", "title"), "encontent": F.coalesce("encontent", "content"), "language": F.coalesce("language", F.lit("en")), "applicable_shops": own})
    return out.where(F.coalesce(acts, F.lit(False)) | F.col("title").isNotNull() | F.col("content").isNotNull())


def merged_layers(layers: DataFrame) -> DataFrame:
    """(field, shop, value, layer): layers (field, shop, value, layer) with a value once for a field and shop, from the first layer
    that has it regardless of case; what the general shop has is left out of the others."""
    low = F.lower(F.trim("value"))
    one = layers.where(F.trim("value") != "").groupBy("field", "shop", low.alias("k")).agg(F.min_by(F.struct("value", "layer"), F.struct("layer", "value")).alias("v"))
    general = one.where("shop = 'GEN'").select("field", "k").distinct()
    own = one.where("shop <> 'GEN'").join(general, ["field", "k"], "left_anti").select("field", "shop", "k", "v")
    return own.unionByName(one.where("shop = 'GEN'")).select("field", "shop", F.trim("v.value").alias("value"), "v.layer")


def slots_of_shops(slots: DataFrame) -> DataFrame:
    """(shop, slots): of each shop, its own slots and the general ones, sorted."""
    general = slots.where("shop = 'GEN'").select("slot")
    shops = slots.where("shop <> 'GEN'").select("shop").distinct()
    each = slots.where("shop <> 'GEN'").select("shop", "slot").union(shops.crossJoin(if_small(general)))
    return each.groupBy("shop").agg(F.sort_array(F.collect_set("slot")).alias("slots"))


def supplements(tiers: DataFrame, sections: list[tuple[str, int, str]]) -> DataFrame:
    """(shop, tier, id, title): records of sections (name, n, title), n for each tier of a shop, numbered."""
    rows = tiers.select("shop", "tier", F.explode(F.array(*[F.struct(F.lit(a).alias("section"), F.lit(n).alias("n"), F.lit(t).alias("title")) for a, n, t in sections])).alias("s"))
    return rows.select("shop", "tier", F.explode(F.sequence(F.lit(1), F.col("s.n"))).alias("i"), "s").select("shop", "tier", F.concat_ws("-", "s.section", "tier", "i").alias("id"), "s.title")


def replaced_by_prefix(records: DataFrame, new: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """records without those whose id begins with a prefix, and the new ones."""
    keep = F.lit(True)
    for p in prefixes:
        keep = keep & ~F.startswith("id", F.lit(p))
    return records.where(keep).unionByName(new)


def build_plan(changes: DataFrame, owners: DataFrame) -> DataFrame:
    """(target, operation, place): what changed files (source_file, operation, place) ask to be built: a supplement its owner's
    playbook (owners: supplement, playbook), any other file itself; each target once, at its first place. Deleted playbooks are
    deleted; a deleted supplement rebuilds its owner."""
    met = changes.join(owners.withColumnRenamed("supplement", "source_file"), "source_file", "left")
    target = F.coalesce("playbook", "source_file")
    operation = F.when((F.col("operation") == "deleted") & F.col("playbook").isNull(), "delete").otherwise("build")
    return met.select(target.alias("target"), operation.alias("operation"), "place").groupBy("target").agg(F.min_by("operation", F.struct("place", "operation")).alias("operation"), F.min("place").cast("long").alias("place"))


def authorised_urls(slot_values: Column, script: Column) -> Column:
    """Links that a reply may hold: those in the values of a rule's slots, and in its script; each once, in order."""
    return F.array_distinct(F.concat(F.flatten(F.transform(slot_values, urls)), urls(F.coalesce(script, F.lit("")))))


def required_values(slot_values: Column, script: Column, has_information: Column) -> Column:
    """Values that a reply must hold: those of the rule's slots, without any the links of its script; none for a rule without
    key information."""
    own = F.array_distinct(F.filter(F.transform(slot_values, stripped), lambda v: v != ""))
    return F.when(~has_information, F.array().cast("array<string>")).when(F.size(own) > 0, own).otherwise(urls(F.coalesce(script, F.lit(""))))


def prepared_script(en_body: Column, body: Column, slots: Column) -> Column:
    """The English body, else the own, with slots (map) in braces replaced by their values."""
    text = F.coalesce(F.nullif(stripped(en_body), F.lit("")), stripped(body), F.lit(""))
    return F.aggregate(F.map_entries(slots), F.regexp_replace(text, r"\$\{", "{"), lambda done, e: F.replace(done, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
