"""What a finished reply may and must hold: nine tests in order; signatures, restored slots and estimated earnings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

#: Links (also short ones), amounts, percentages, deadlines, and places that were left open.
URL = r"(?i)https?://[^\s\)\]\"'<>]+|wa\.me/[^\s\)\]\"'<>]+"
MONEY = r"\$\s*\d[\d,]*(?:\.\d+)?"
PERCENT = r"\b\d+(?:\.\d+)?\s*%"
DEADLINE = r"(?i)\b(?:within|in|after)\s+\d+\s+(?:business\s+)?(?:days?|hours?|weeks?)\b"
OPEN = r"\[[^\]]+\]|\{[a-zA-Z_]+\}"
#: Dollars a view of the first and the second offer, the cap of the first; the number of videos where none is given.
FIRST_RATE, SECOND_RATE, CAP, VIDEOS = 0.002, 0.003, 2.0, 4
NONE = "array<string>"


def _strings() -> Column:
    return F.array().cast(NONE)


def _found(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), 0), _strings())


def urls(text: Column) -> Column:
    """Links of a text in order, without punctuation at their ends; none for null."""
    return F.transform(_found(text, URL), lambda u: F.regexp_replace(u, r"[.,;:!?)\"']+$", ""))


def signature_pattern(name: str) -> str:
    return rf"(?i)\s*[—\-]\s*{name}\s*$"


def signed(body: Column, name: str) -> Column:
    """The body with one signature after a blank line; an empty one stays empty."""
    text = F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(text, signature_pattern(name), ""), r"\s+$", "")
    return F.when(text == "", "").otherwise(F.concat(bare, F.lit(f"\n\n— {name}")))


def restored(text: Column, values: Column) -> Column:
    """Slots in braces (single or double) replaced by their values (a map); null values stay open."""

    def put(done: Column, e: Column) -> Column:
        once = F.replace(done, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"])
        return F.replace(once, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"])

    entries = F.filter(F.coalesce(F.map_entries(values), F.array().cast("array<struct<key:string,value:string>>")), lambda e: e["value"].isNotNull())
    return F.aggregate(entries, F.coalesce(text, F.lit("")), put)


def dollars(amount: Column) -> Column:
    """Two decimals, rounded by the exact value of the double, without trailing zeros."""
    return F.regexp_replace(F.replace(F.format_number(amount, 2), F.lit(",")), r"\.?0+$", "")


def earnings(views: Column, videos: Column, creator: Column) -> Column:
    """map<string,string> of placeholders for average views: the views, each rate, the total of all videos; null for null views."""
    v, n = F.greatest(views, F.lit(0)), F.greatest(F.coalesce(F.nullif(videos, F.lit(0)), F.lit(VIDEOS)), F.lit(1))
    first, second = v.cast("double") * FIRST_RATE, v.cast("double") * SECOND_RATE
    pairs = {"avgVV": F.format_number(v, 0), "videoCount": n.cast("string"), "total": dollars(n * first)}
    pairs |= {"avgVV*0.002": dollars(first), "avgVV*0.004": dollars(first * CAP), "avgVV*0.003": dollars(second), "avgVV*0.0015": dollars(second / 2)}
    made = F.create_map(*[x for k, c in pairs.items() for x in (F.lit(k), c)])
    named = F.when(F.coalesce(F.trim(creator), F.lit("")) != "", F.map_concat(made, F.create_map(F.lit("creator"), F.trim(creator)))).otherwise(made)
    return F.when(views.isNotNull(), named)


def lacks_earnings(reply: Column, values: Column) -> Column:
    """Whether a reply names no amount although earnings are known; false for a blank reply and without them."""
    known = F.coalesce(F.element_at(values, F.lit("avgVV*0.002")), F.lit("")) != ""
    return known & (F.coalesce(stripped(reply), F.lit("")) != "") & ~F.coalesce(reply.rlike(r"\$\s*\d"), F.lit(False))


def slot_urls(slots: Column, values: Column) -> Column:
    """Links in the values of slots, in order."""
    return F.flatten(F.transform(F.coalesce(slots, _strings()), lambda s: urls(F.element_at(values, s))))


def tag_urls(tags: Column, values: Column) -> Column:
    """Links in the values of all slots whose name contains a tag of key information."""
    entries = F.coalesce(F.map_entries(values), F.array().cast("array<struct<key:string,value:string>>"))
    own = lambda tag: F.filter(entries, lambda e: F.contains(F.lower(e["key"]), F.replace(F.lower(tag), F.lit(" "), F.lit("_"))))
    return F.flatten(F.transform(F.coalesce(tags, _strings()), lambda t: F.flatten(F.transform(own(t), lambda e: urls(e["value"])))))


def required_urls(slots: Column, tags: Column, script: Column, values: Column) -> Column:
    """Links that a reply must hold if its rule has key information: the first of each slot's value, else the script's first."""
    firsts = F.filter(F.transform(F.coalesce(slots, _strings()), lambda s: F.get(urls(F.element_at(values, s)), F.lit(0))), lambda u: u.isNotNull())
    own = F.array_distinct(firsts)
    return F.when(F.coalesce(F.size(tags), F.lit(0)) <= 0, _strings()).when(F.size(own) > 0, own).otherwise(F.slice(urls(script), 1, 1))


def required_values(slots: Column, tags: Column, script: Column, values: Column) -> Column:
    """Values that a reply must hold if its rule has key information: of its slots, else all links of its script."""
    own = F.filter(F.transform(F.coalesce(slots, _strings()), lambda s: stripped(F.element_at(values, s))), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.when(F.coalesce(F.size(tags), F.lit(0)) <= 0, _strings()).when(F.size(own) > 0, F.array_distinct(own)).otherwise(F.array_distinct(urls(script)))


def verdict(reply: Column, authorised: Column, required: Column, values: Column, allowed: Column, name: str) -> Column:
    """ok, or the first of nine tests that a reply fails.

    In order: empty_reply, missing_signature, placeholder_in_reply, unauthorized_url, missing_required_url, missing_key_information, and
    amounts, percentages and deadlines that are not in the allowed text: unauthorized_money, unauthorized_percent, unauthorized_deadline.
    """
    body = stripped(F.coalesce(reply, F.lit("")))
    foreign = lambda pattern: F.exists(_found(body, pattern), lambda m: ~F.contains(F.coalesce(allowed, F.lit("")), m))
    missing = lambda wanted: F.exists(wanted, lambda w: ~F.contains(body, w))
    return (
        F.when(body == "", "empty_reply").when(~body.rlike(signature_pattern(name)), "missing_signature").when(body.rlike(OPEN), "placeholder_in_reply")
        .when(F.size(F.array_except(urls(body), authorised)) > 0, "unauthorized_url").when(missing(required), "missing_required_url").when(missing(values), "missing_key_information")
        .when(foreign(MONEY), "unauthorized_money").when(foreign(PERCENT), "unauthorized_percent").when(foreign(DEADLINE), "unauthorized_deadline").otherwise("ok")
    )
