"""Labels of key information that a record's slots back: longest prefixes by hash, then what the shop has values and words for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped
from .common import if_small

#: Beginnings of slots and the tags that they stand for.
PREFIXES = (
    ("wa_group_", "whatsapp_group"), ("whatsapp_form_", "whatsapp_form"), ("affiliate_link_", "affiliate_link"), ("commission_rate_", "commission_rate"), ("creator_portal_", "creator_portal"),
    ("creator_team_", "creator_team_link"), ("community_link_", "community_link"), ("manager_wechat_", "manager_wechat"), ("manager_contact_", "manager_contact"), ("ai_ugc_", "ai_ugc_portal"),
)
PLACEHOLDER = r"\{([a-zA-Z0-9_]+)\}"


def slot_tags(slots: DataFrame, prefixes: DataFrame) -> DataFrame:
    """slots (slot, further columns) with tag: that of the longest prefix (prefix, tag) that the slot begins with; slots without one go.

    A slot asks by hash for its beginnings, one for each length that occurs among the prefixes, which are few.
    """
    lengths = sorted(r.n for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect())
    none = F.array().cast("array<string>")
    begins = F.array(*[F.when(F.length("slot") >= n, F.substring("slot", 1, n)) for n in lengths]) if lengths else none
    asked = slots.withColumn("__row", F.struct(*slots.columns)).withColumn("prefix", F.explode(F.array_distinct(F.filter(begins, lambda b: b.isNotNull()))))
    met = asked.join(if_small(prefixes.groupBy("prefix").agg(F.min("tag").alias("tag"))), "prefix")
    return met.groupBy("__row").agg(F.max_by("tag", F.length("prefix")).alias("tag")).select("__row.*", "tag")


def labels(records: DataFrame, values: DataFrame, extracted: DataFrame, aliases: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(record_id, labels array) of records (record_id, shop, slots array, content, encontent, information array) that have any.

    A tag is backed by a slot of the record (named or as a placeholder in its texts) that has a value in the shop (values: shop, slot, value) and, where
    the shop has words for key information (extracted: shop, tag), is among these. A record's own information is kept as far as it is
    backed; without any, all backed tags count, in order of the slots. A tag is shown as its first alias (aliases: shop, tag, place, alias), else as its
    name with spaces. Records without a shop have none; record ids are unique.
    """
    none = F.array().cast("array<string>")
    named = F.filter(F.coalesce("slots", none), lambda s: stripped(s) != "")
    placed = F.flatten(F.array(*[F.coalesce(F.regexp_extract_all(c, F.lit(PLACEHOLDER), 1), none) for c in ("content", "encontent")]))
    own = F.array_distinct(F.filter(F.transform(F.coalesce("information", none), stripped), lambda s: F.coalesce(s, F.lit("")) != ""))
    r = records.where("shop is not null").select("record_id", "shop", F.array_distinct(F.concat(named, placed)).alias("slots"), own.alias("own"))
    rows = r.select("record_id", "shop", F.posexplode("slots").alias("pos", "slot")).join(if_small(values.where(F.trim("value") != "").select("shop", "slot").distinct()), ["shop", "slot"], "left_semi")
    tagged = slot_tags(rows, prefixes)
    words = extracted.where("shop is not null").groupBy("shop").agg(F.collect_set("tag").alias("words"))  # a vocabulary of tags
    backed = tagged.join(if_small(words), "shop", "left").where(F.col("words").isNull() | F.array_contains("words", F.col("tag"))).groupBy("record_id", "shop", "tag").agg(F.min("pos").alias("pos"))
    items = r.where(F.size("own") > 0).select("record_id", "shop", F.posexplode("own").alias("item_pos", "item"))
    spelt = aliases.select("shop", F.lower("alias").alias("low"), "tag").union(backed.select("shop", F.lower("tag"), "tag")).groupBy("shop", "low").agg(F.min("tag").alias("tag"))
    given = items.withColumn("low", F.lower("item")).join(if_small(spelt), ["shop", "low"]).join(backed.select("record_id", "tag"), ["record_id", "tag"], "left_semi").select("record_id", "shop", "tag", F.col("item_pos").alias("pos"))
    without = r.where(F.size("own") == 0).select("record_id")
    chosen = given.union(backed.join(without, "record_id", "left_semi").select("record_id", "shop", "tag", "pos"))
    shown = aliases.groupBy("shop", "tag").agg(F.min_by("alias", "place").alias("alias"))
    lines = chosen.join(if_small(shown), ["shop", "tag"], "left").withColumn("label", F.coalesce("alias", F.replace("tag", F.lit("_"), F.lit(" "))))
    first = lines.groupBy("record_id", "label").agg(F.min("pos").alias("pos"))
    return first.groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("labels"))


def fixed_prefixes(like: DataFrame) -> DataFrame:
    """PREFIXES as a table of the session of `like`."""
    return like.sparkSession.createDataFrame(PREFIXES, "prefix string, tag string")
