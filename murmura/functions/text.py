"""Text as columns: lines of conversations, lists in cells, amounts, links, placeholders and slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of links, dollar amounts, percentages and placeholders.
URL = r"https?://[^\s<>\"')\]]+"
MONEY = r"\$\s?[0-9]+(?:\.[0-9]+)?"
PERCENT = r"[0-9]+(?:\.[0-9]+)?\s?%"
PLACEHOLDER = r"\{([A-Za-z_][A-Za-z0-9_]*)\}"
#: Fixed value: what separates several values in a cell.
SEPARATORS = "[,，;；]+"
#: Words near an amount that make it a likely quote, and those that make it unlikely.
QUOTE_HINTS = ("rate", "charge", "per video", "quote", "flat fee")
QUOTE_AGAINST = ("gmv", "sales", "revenue")


def stripped(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def line_part(line: Column, part: str) -> Column:
    """time, role, speaker or body of a line `[time][role:speaker] body` (speaker may be absent); empty if it is no such line."""
    pattern = r"^\[([^\]]*)\]\[([a-z]+)(?::([^\]]*))?\]\s*(.*)$"
    return F.regexp_extract(line, pattern, {"time": 1, "role": 2, "speaker": 3, "body": 4}[part])


def values(cell: Column) -> Column:
    """The values of a cell, in order, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), SEPARATORS), stripped), lambda x: x != "")


def without_wildcards(items: Column) -> Column:
    """Values that constrain: not blank and not GEN in any case."""
    return F.filter(items, lambda x: ~F.upper(stripped(x)).isin("", "GEN"))


def language_guess(c: Column) -> Column:
    """en if there are more ASCII letters than characters beyond ASCII, else zh."""
    letters = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    beyond = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    return F.when(letters > beyond, "en").otherwise("zh")


def slug(c: Column) -> Column:
    """Lower case, with runs of anything but letters and digits as single hyphens, none at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "-"), "^-|-$", ""))


def html_text(c: Column) -> Column:
    """What an HTML page shows: without comments, scripts, styles and tags, white space collapsed."""
    out = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<(?:script|style)\b.*?</(?:script|style)>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    return stripped(F.regexp_replace(out, r"\s+", " "))


def urls(c: Column) -> Column:
    """Links without trailing punctuation, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(URL), 0), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def amounts(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(MONEY), 0)


def percentages(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(PERCENT), 0)


def placeholders(c: Column) -> Column:
    """Names in braces, each once, in order; ${x} counts as {x}."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(c, r"\$\{", "{"), F.lit(PLACEHOLDER), 1))


def restored(c: Column, slots: dict[str, str]) -> Column:
    """Slots in braces replaced by their values."""
    for name, value in slots.items():
        c = F.replace(c, F.lit("{" + name + "}"), F.lit(value))
    return c


def desensitised(c: Column, slots: dict[str, str]) -> Column:
    """Values replaced by their slots in braces, longest value first."""
    for name, value in sorted(slots.items(), key=lambda x: (-len(x[1]), x[0])):
        c = F.replace(c, F.lit(value), F.lit("{" + name + "}"))
    return c


def signed(body: Column, name: str) -> Column:
    """The body with one signature at its end, however it was signed before."""
    bare = F.regexp_replace(body, rf"(?i)\s*[-–—]*\s*{name}\s*$", "")
    return F.concat(stripped(bare), F.lit(f"\n\n- {name}"))


def quote(c: Column, hints: tuple[str, ...] = QUOTE_HINTS, against: tuple[str, ...] = QUOTE_AGAINST) -> Column:
    """The dollar amount that is most likely a quote: hints within 40 characters before it count for, others against; of equal
    scores the larger amount. struct(amount, score); null without an amount. There is no thousands separator: $5,000 is 5."""
    parts = F.split(c, r"\$\s?(?=[0-9])")
    def scored(i: Column) -> Column:
        before, here = F.lower(F.right(F.element_at(parts, i), F.lit(40))), F.element_at(parts, i + 1)
        points = sum((F.when(F.contains(before, F.lit(h)), 2).otherwise(0) for h in hints), F.lit(1))
        points = points - sum((F.when(F.contains(before, F.lit(h)), 2).otherwise(0) for h in against), F.lit(0))
        return F.struct(points.alias("score"), F.regexp_extract(here, r"^[0-9]+(?:\.[0-9]{1,2})?", 0).try_cast("decimal(18,2)").alias("amount"))
    found = F.when(F.size(parts) > 1, F.array_max(F.filter(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), scored), lambda x: x["amount"].isNotNull())))
    return found
