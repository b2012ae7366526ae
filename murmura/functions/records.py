"""Fields of knowledge records and chat histories as columns: sections, numbered items, messages, actions, negotiation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

#: Short refusals, once trailing dots and exclamation marks are gone, and phrases that refuse.
SHORT_REFUSALS = ("no", "nope", "nah", "pass", "decline", "not interested", "no thanks", "no thank you", "not for me")
REFUSAL_PHRASES = r"(?i)\b(?:not interested|no thanks|no thank you|don'?t want|won'?t|can'?t do|pass)\b"
#: Spellings of actions, in lower case, and what they are called.
ACTIONS = {
    "one_sample_two_videos": "one_sample_two_videos",
    "one sample two videos": "one_sample_two_videos",
    "b_level_one_sample_two_videos": "one_sample_two_videos",
    "join_wa_1": "join_wa_1",
    "join_wa_2": "join_wa_2",
    "send flat fee offer": "send_flat_fee_offer",
    "send_cpm_offer": "send_cpm_offer",
    "send cpm offer + estimate": "send_cpm_offer",
    "send cpm offer estimate": "send_cpm_offer",
    "log creator's minimum rate to quote sheet": "log_creator_quote",
    "log creator minimum rate to quote sheet": "log_creator_quote",
    "log creators minimum rate to quote sheet": "log_creator_quote",
    "push commission rate and sample form": "push_commission_sample",
    "send a1 pure commission opening": "send_a1_opening",
    "send whatsapp group invite link": "send_whatsapp_group_link",
    "send_whatsapp_group_link": "send_whatsapp_group_link",
    "send affiliate link": "send_affiliate_link",
    "send_affiliate_link": "send_affiliate_link",
    "add to ai ugc roster, send portal link": "add_to_ai_ugc_roster",
    "add to ai ugc roster send portal link": "add_to_ai_ugc_roster",
    "add_to_ai_ugc_roster": "add_to_ai_ugc_roster",
    "add to dnc list, stop all outreach": "mark_dnc",
    "add to dnc list stop all outreach": "mark_dnc",
    "mark_dnc": "mark_dnc",
    "flat_fee_agreed": "flat_fee_agreed",
}
#: Fixed value: endings that an intent's name loses.
INTENT_ENDINGS = r"(?i)\s+(?:Negotiation|Handling|Enrollment|Interest|Transfer|Support)\s*$"
#: The two spellings of the key that holds a negotiation round.
ROUND, OLD_ROUND = "price_negotiation_rounds", "negotiation_rounds"
CREATOR_TAG = r"(?i)\[creator\s*\]"


def sections(text: Column) -> Column:
    """array<struct<name, body>> of a text with lines like `===== name =====`; what stands before the first is left out."""
    split = F.split(F.concat(F.lit("\n"), text), r"\n===== ")
    parts = F.slice(split, F.lit(2), F.greatest(F.size(split), F.lit(0)))
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"^([^\n]*?) =====", 1)).alias("name"), stripped(F.regexp_replace(p, r"^[^\n]*", "")).alias("body")))


def numbered_items(text: Column) -> Column:
    """array<struct<number, body>> of lines that begin with `1.`, each with the lines that follow it; blank lines and white space
    at ends of lines go. A text without such lines is item 1 as a whole; a blank one has none."""
    body = stripped(text)
    parts = F.filter(F.split(body, r"(?m)(?=^[ \t]*[0-9]+\.)"), lambda p: p.rlike(r"^[ \t]*[0-9]+\."))
    lines = lambda p: F.filter(F.transform(F.split(p, "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")
    item = lambda p: F.struct(F.regexp_extract(p, r"^[ \t]*([0-9]+)\.", 1).alias("number"), stripped(F.array_join(lines(F.regexp_replace(p, r"^[ \t]*[0-9]+\.[ \t]*", "")), "\n")).alias("body"))
    found = F.filter(F.transform(parts, item), lambda x: x["body"] != "")
    whole = F.when(body != "", F.array(F.struct(F.lit("1").alias("number"), body.alias("body")))).otherwise(F.slice(F.array(F.struct(F.lit("").alias("number"), body.alias("body"))), 1, 0))
    return F.when(F.size(parts) > 0, found).otherwise(whole)


def level(title: Column, everything: Column) -> Column:
    """S, A or B from a title like `A-01`, else from the first such level that is named anywhere; else GEN."""
    low = F.lower(everything)
    named = F.coalesce(*[F.when(F.contains(low, F.lit(f"{x}-level")) | F.contains(low, F.lit(f"{x} 级")), F.lit(x.upper())) for x in "sab"], F.lit("GEN"))
    from_title = F.upper(F.regexp_extract(F.trim(title), r"(?i)^([SAB])-[0-9]{2}", 1))
    return F.when(from_title != "", from_title).otherwise(named)


def message_text(info: Column) -> Column:
    """Values of a JSON object joined by lines, number keys first and in order, then others; any other text as it is."""
    text = F.coalesce(F.trim(info), F.lit(""))
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    place = lambda e: F.struct(e["key"].try_cast("bigint").isNull().alias("named"), e["key"].try_cast("bigint").alias("n"), e["key"].alias("key"), F.trim(e["value"]).alias("value"))
    values = F.transform(F.array_sort(F.transform(F.filter(entries, lambda e: F.trim(e["value"]) != ""), place)), lambda e: e["value"])
    return F.when(F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")) & entries.isNotNull(), F.array_join(values, "\n")).otherwise(text)


def creator_lines(history: Column) -> Column:
    """Lines of a history that a creator wrote."""
    return F.array_join(F.filter(F.transform(F.split(history, "\n"), stripped), lambda x: x.rlike(CREATOR_TAG)), "\n")


def last_bracket(lines: Column) -> Column:
    """What the last bracket before a creator's tag holds; empty without one."""
    found = F.filter(F.transform(F.regexp_extract_all(lines, F.lit(r"(?i)\[([^\[\]]+)\]\s*\[creator\s*\]"), 1), stripped), lambda x: x != "")
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def action(raw: Column, aliases: dict[str, str] = ACTIONS) -> Column:
    """An action's usual name: by its name in lower case with underscores and without other signs, else by its text in lower case;
    any other is called by that name. Letters of any script stay; a blank one is empty."""
    low = F.lower(stripped(raw))
    name = F.regexp_replace(F.regexp_replace(low, r"[\s\-]+", "_"), r"(?U)[^\w]", "")
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.when(name == "", "").otherwise(F.coalesce(F.try_element_at(known, name), F.try_element_at(known, low), name))


def refuses(message: Column) -> Column:
    """Whether a message refuses to work together; false for null and blank."""
    short = F.regexp_replace(F.lower(stripped(message)), r"[.!]+$", "")
    return F.coalesce((short != "") & (short.isin(*SHORT_REFUSALS) | message.rlike(REFUSAL_PHRASES)), F.lit(False))


def canonical_intent(raw: Column) -> Column:
    """An intent's name without a general ending, white space collapsed, cut at a word within 48 characters; null if blank."""
    name = stripped(F.regexp_replace(F.regexp_replace(stripped(raw), INTENT_ENDINGS, ""), r"\s+", " "))
    cut = F.substring(name, 1, 48)
    return F.nullif(F.when(F.length(name) > 48, F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(name), F.lit(""))


def progress_matches(rule: Column, context: Column) -> Column:
    """Every token of the rule is in the context; a key alone is met by any value of it; a round by either spelling."""
    usual = lambda t: F.when(F.startswith(t, F.lit(OLD_ROUND + "=")), F.concat(F.lit("price_"), t)).otherwise(t)
    own = F.transform(context, usual)
    met = lambda t: F.array_contains(own, t) | (~F.contains(t, F.lit("=")) & (t != ROUND) & F.exists(own, lambda c: F.startswith(c, F.concat(t, F.lit("=")))))
    return F.when(F.size(rule) == 0, F.lit(True)).otherwise((F.size(context) > 0) & F.forall(rule, met))


def round_of(tokens: Column) -> Column:
    """The negotiation round among tokens like `price_negotiation_rounds=2`; null without one."""
    found = F.filter(tokens, lambda t: t.rlike(rf"^(?:{ROUND}|{OLD_ROUND})=[0-9]+$"))
    return F.regexp_extract(F.try_element_at(found, F.lit(1)), r"=([0-9]+)$", 1).try_cast("int")


def negotiation_state(stored: Column, node: Column, tokens: Column, chain: tuple[str, ...] = ("A1", "A2", "A3", "A4")) -> Column:
    """struct(round, node, before): a missing round comes from the tokens, else from the node; a missing node from the round."""
    nodes = F.array(*map(F.lit, chain))
    given = F.nullif(F.upper(F.trim(node)), F.lit(""))
    at = F.nullif(F.array_position(nodes, given).cast("int"), F.lit(0))
    number = F.coalesce(stored, round_of(tokens), at)
    inside = number.between(1, len(chain))
    now = F.coalesce(given, F.when(inside, F.try_element_at(nodes, F.greatest(number, F.lit(1)))))
    before = F.when(inside & (number > 1), F.try_element_at(nodes, F.greatest(number - 1, F.lit(1))))
    return F.struct(number.alias("round"), now.alias("node"), before.alias("before"))


def epoch_time(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def shortened(text: Column, chars: int) -> Column:
    """At most so many characters, without white space at the end and with three dots if it is cut."""
    t = F.coalesce(stripped(text), F.lit(""))
    return F.when(F.length(t) > chars, F.concat(F.regexp_replace(F.substring(t, 1, chars), r"\s+$", ""), F.lit("..."))).otherwise(t)


def unfenced(text: Column) -> Column:
    """A text without the fence of a Markdown code block around it."""
    return stripped(F.regexp_replace(F.regexp_replace(stripped(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), 0))


def header(name: Column) -> Column:
    """A column's name for comparison: dashes alike, no white space, lower case."""
    return F.lower(F.regexp_replace(F.translate(name, "–—－", "---"), r"\s+", ""))


def json_list(text: Column) -> Column:
    """The strings of a JSON array; any other text is one value, a blank one none."""
    t = F.trim(text)
    return F.when(F.startswith(t, F.lit("[")), F.coalesce(F.from_json(t, "array<string>"), F.array().cast("array<string>"))).when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))
