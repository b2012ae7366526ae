"""Values of records as columns: cells, lists, flags, metadata, labels, scores, names and links."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SEPARATORS, stripped

#: Fixed value: the label before a chunk's progress in the text that is embedded.
PROGRESS_LABEL = "三级分类-达人进度"
#: Confidences as numbers.
CONFIDENCE = {"high": 0.9, "medium": 0.65, "low": 0.35}
#: Order of tiers in a hierarchy, the wildcard apart.
TIER_ORDER = ("A-level", "B-level", "C-level", "S-level", "SS-level")


def cell(raw: Column) -> Column:
    """struct(value, items) of a cell: a text without separators stays a value; with several parts, items; one part is a value."""
    s = stripped(F.coalesce(raw, F.lit("")))
    parts = F.filter(F.transform(F.split(s, SEPARATORS), stripped), lambda x: x != "")
    value = F.when(~s.rlike(SEPARATORS), s).when(F.size(parts) == 0, "").when(F.size(parts) == 1, F.try_element_at(parts, F.lit(1)))
    return F.struct(value.alias("value"), F.when(value.isNull(), parts).alias("items"))


def json_text(items: Column) -> Column:
    """A list as JSON, for export only; null stays null."""
    return F.to_json(items)


def merged(*lists: Column) -> Column:
    """Lists one after another, each value once, in order of first sight; null lists add nothing."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


def overlay(own: Column, general: Column) -> Column:
    """What a layer has beyond the general one."""
    return F.array_except(own, F.coalesce(general, F.array().cast("array<string>")))


def without_prefixes(flags: Column, prefixes: tuple[str, ...]) -> Column:
    """Flags that begin with none of the prefixes."""

    def other(flag: Column) -> Column:
        out = F.lit(True)
        for p in prefixes:
            out = out & ~F.startswith(flag, F.lit(p))
        return out

    return F.filter(flags, other)


def level_flags(level: Column, mapping: dict[str, tuple[str, ...]]) -> Column:
    """Flags of a level, none for an unknown one or null."""
    out = F.array().cast("array<string>")
    for name, flags in mapping.items():
        out = F.when(stripped(level) == name, F.array(*map(F.lit, flags)).cast("array<string>")).otherwise(out)
    return out


def quote_amount(amount: Column) -> Column:
    """An amount with two decimals; null if it does not fit."""
    return F.round(amount, 2).try_cast("decimal(18,2)")


def confidence(label: Column) -> Column:
    """A label as a number, a number in text as itself within 0 and 1; null for anything else."""
    low = F.lower(stripped(label))
    number = low.try_cast("double")
    out = F.when(number.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))
    for name, value in CONFIDENCE.items():
        out = F.when(low == name, F.lit(value)).otherwise(out)
    return out


def number_or_null(raw: Column) -> Column:
    """A number from text with thousands separators; negatives and anything else are null."""
    value = F.regexp_replace(raw, r"[,\s]", "").try_cast("double")
    return F.when(value >= 0, value)


def embedding_text(en_title: Column, en_body: Column, title: Column, body: Column, progress: Column) -> Column:
    """What is embedded of a chunk: its English title and body, else its own, and its progress at the end."""
    text = lambda c: stripped(F.coalesce(c, F.lit("")))
    both = lambda a, b: stripped(F.concat(text(a), F.lit("\n"), text(b)))
    base = F.when(both(en_title, en_body) != "", both(en_title, en_body)).otherwise(both(title, body))
    return F.when(text(progress) != "", stripped(F.concat(base, F.lit(f"\n{PROGRESS_LABEL}: "), text(progress)))).otherwise(base)


def context_window(text: Column, begin: Column, length: Column, radius: int = 96) -> Column:
    """What stands within so many characters around a span (begin from 0), white space collapsed."""
    first = F.greatest(begin - radius, F.lit(0))
    return stripped(F.regexp_replace(F.substring(text, first + 1, begin + length + radius - first), r"\s+", " "))


def slot_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+k|[a-z]+|[0-9]+"), 0))


def slot_score(slot: Column, value: Column, context: Column, same_kind: Column) -> Column:
    """How well a candidate fits a slot: the share of the slot's tokens in context and value, 0.35 of their share in the value
    alone (as part of it, from two letters), 0.05 for the same kind, and bonuses or losses for bounds that agree or contradict."""
    tokens, around, inside = slot_tokens(F.replace(slot, F.lit("_"), F.lit(" "))), slot_tokens(F.concat_ws(" ", context, value)), slot_tokens(value)
    n = F.size(tokens)
    part = F.size(F.filter(tokens, lambda t: F.array_contains(inside, t) | ((F.length(t) >= 2) & F.contains(F.lower(value), t))))
    has, said = lambda w: F.array_contains(tokens, w), lambda w: F.array_contains(around, w)
    bounds = F.lit(0.0)
    for own, other in (("gte", "lt"), ("lt", "gte")):
        bounds = bounds + F.when(has(own) & said(own), 0.25).otherwise(0.0) - F.when(has(own) & said(other), 0.35).otherwise(0.0)
    for own, other in (("first", "per"), ("per", "first")):
        bounds = bounds + F.when(has(own) & said(own), 0.35).otherwise(0.0) - F.when(has(own) & said(other) & ~said(own), 0.4).otherwise(0.0)
    score = F.size(F.array_intersect(tokens, around)) / n + 0.35 * part / n + bounds + F.when(same_kind, 0.05).otherwise(0.0)
    return F.when(n > 0, F.round(score, 6)).otherwise(0.0)


def slot_kind(slot: Column) -> Column:
    """percent, money, url or any, by a slot's name."""
    s = F.lower(slot)
    return (
        F.when(F.endswith(s, F.lit("_pct")) | F.contains(s, F.lit("commission_rate")) | F.endswith(s, F.lit("_rate")), "percent")
        .when(s.rlike("_usd|bonus|per_video"), "money").when(s.rlike("link|portal|form|group|url"), "url").otherwise("any")
    )


def is_noise(kind: Column, value: Column, context: Column) -> Column:
    """Candidates that are no values: links of assets, percentages of style sheets, amounts of policies, sales of 1000 and more."""
    low = F.lower(context)
    amount = F.regexp_replace(value, "[$,]", "").try_cast("double")
    asset = low.rlike(r"src=|stylesheet|\.css|\.js\b|font") | F.lower(value).rlike(r"\.(?:png|jpe?g|gif|svg|css|js)(?:\?|$)")
    money = low.rlike("policy|penalty|example") | ((amount >= 1000) & low.rlike("gmv|monthly"))
    return F.coalesce(F.when(kind == "url", asset).when(kind == "percent", low.rlike(r"width|height|opacity|margin|padding")).when(kind == "money", money), F.lit(False))


def is_handoff(reply: Column, title: Column) -> Column:
    """Whether an answer was left to people: no reply, or markers in reply or title."""
    r, t = F.lower(stripped(F.coalesce(reply, F.lit("")))), F.lower(F.coalesce(title, F.lit("")))
    return (r == "") | F.contains(r, F.lit("intent_skip")) | F.contains(t, F.lit("intent_classifier_handoff"))


def week_name(start: Column, end: Column, part: Column, prefix: str | None = None) -> Column:
    """The name of a week's table, with its part from the second on; with a prefix, in words."""
    form = "yyyy-MM-dd" if prefix is None else "yyyy年MM月dd日"
    base = F.concat(F.lit("" if prefix is None else prefix + " "), F.date_format(start, form), F.lit("_" if prefix is None else "-"), F.date_format(end, form))
    return F.when(part == 1, base).otherwise(F.concat(base, F.lit("-"), part))


def report_bounds(now: Column) -> Column:
    """struct(start, end): from 16:30 of the day before until now."""
    start = F.date_trunc("day", now) - F.expr("interval 1 day") + F.expr("interval 16 hours 30 minutes")
    return F.struct(start.alias("start"), now.alias("end"))


def with_query(url: Column, key: str, value: Column) -> Column:
    """A link with one query parameter set, others and the fragment kept."""
    frag = F.regexp_extract(url, r"(#.*)$", 1)
    bare = F.regexp_replace(url, r"#.*$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, rf"([?&]){re.escape(key)}=[^&]*", "$1"), r"&&+", "&")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\?&", "?"), r"[?&]$", "")
    return F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.lit(key + "="), value, frag)


def same_text(a: Column, b: Column) -> Column:
    """Equality without regard to case (accents count)."""
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def table_text(rows: Column) -> Column:
    """array<array<string>> as lines of cells joined by ` | `, lines without text left out."""
    lines = F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: stripped(F.coalesce(c, F.lit("")))), " | "))
    return F.array_join(F.filter(lines, lambda x: F.regexp_replace(x, r"[|\s]", "") != ""), "\n")


def metadata(fields: dict[str, Column], extra: Column | None = None, sparse: Column | None = None) -> Column:
    """map<string,string> of a chunk's fields, and of extra entries under `col_`. Nulls are left out; where sparse holds
    (rows of spreadsheets), blanks too."""
    blank_goes = F.lit(False) if sparse is None else F.coalesce(sparse, F.lit(False))
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()])
    kept = F.filter(entries, lambda e: e["value"].isNotNull() & (~blank_goes | (F.trim(e["value"]) != "")))
    if extra is None:
        return F.map_from_entries(kept)
    named = lambda e: F.struct(F.when(F.startswith(e["key"], F.lit("col_")), e["key"]).otherwise(F.concat(F.lit("col_"), e["key"])).alias("key"), e["value"].alias("value"))
    more = F.transform(F.filter(F.map_entries(F.coalesce(extra, F.create_map().cast("map<string,string>"))), lambda e: e["value"].isNotNull()), named)
    own = F.transform(kept, lambda e: e["key"])
    return F.map_from_entries(F.concat(kept, F.filter(more, lambda e: ~F.array_contains(own, e["key"]))))


def tier_rank(name: Column) -> Column:
    """Place of a tier: the wildcard first, known tiers in order, others after them."""
    place = F.array_position(F.array(*map(F.lit, TIER_ORDER)), name)
    return F.when(F.upper(name) == "GEN", 0).when(place > 0, place).otherwise(len(TIER_ORDER) + 1).cast("int")


def merged_tree(base: Any, overlay: Any) -> Any:
    """Two nested configurations as one: dicts by key, lists as an ordered union, anything else from the overlay unless null."""
    if isinstance(base, dict) and isinstance(overlay, dict):
        return {**base, **{k: merged_tree(base.get(k), v) for k, v in overlay.items()}}
    if isinstance(base, list) and isinstance(overlay, list):
        return base + [x for i, x in enumerate(overlay) if x not in base and x not in overlay[:i]]
    return base if overlay is None else overlay
