"""Values of slots from documents: candidates with their surroundings, scores by an inverted index of tokens, one value a slot.

A slot and a candidate of a shop and a kind meet where they share a token, or a sign that gives points without one; pairs that share
nothing score too little to count, so all pairs need never be made. The choice is greedy, made by rounds of mutual bests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import slot_kind
from .common import dealt, if_small
from .knowledge import assigned

#: Patterns of links, percentages and amounts; hosts and surroundings of assets; surroundings of style sheets, of policies and
#: of examples; large sales; files whose values are authoritative.
URL = r"https?://[^\s\"'<>()\[\]{}，,；;]+"
PERCENT = r"(?<![\d.])(\d+(?:\.\d+)?)\s*%"
MONEY = r"\$(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
ASSET_HOST = r"(^|\.)(fonts\.googleapis|fonts\.gstatic|googleapis\.com|gstatic\.com|w3\.org)"
ASSET_CONTEXT = r"font|stylesheet|preconnect|\.css|w3\.org|schema\.org|rel=.stylesheet"
STYLE_CONTEXT = r"width\s*:|height\s*:|font-size\s*:|margin\s*:|padding\s*:|color\s*:|top\s*:|left\s*:|right\s*:|transform\s*:"
POLICY_CONTEXT = r"PRIORITY\s*0|CPM\s*底金|CPM\s*计价|一口价\s*底金|草稿\s*50%|发布\s*50%|首付\s*=|尾款\s*=|\$0\.00\d+\s*/?\s*VV|月\s*GMV\s*[><≤≥]|100%\s*可见|四级优先链"
EXAMPLE_CONTEXT = r"示例计算|示例|creator_handle|monthly_gmv|avg_vv|action_taken|priority_node|prev_node|平均\s*VV|单条封顶\s*=|单条底金\s*=|[①②③④⑤]|@\w+|layer\s*[ABC]\s*·"
SALES_CONTEXT = r"GMV|gmv|monthly"
AUTHORITY = r"(?:^|[\\/])(?:add\d+|supplement|restore[_-]?config)(?:[._-].*)?\.(?:txt|md)$"
#: What says which of two bounds or payments is meant; near a value, and within its surroundings.
NEAR_SIGNS = {"first": r"(?i)第一个|首次|first|1st", "per": r"(?i)每发|每条|per video|each video|per post", "gte": "以上|gte|>=|≥", "lt": "以下|一下|lt|<"}
WIDE_SIGNS = {"gte": r"(?i)以上|gte|>=|≥|above|over|minimum", "lt": r"(?i)以下|一下|lt|<|below|under|less"}
#: Points for overlap inside the value, for agreeing and contradicting signs, for the kind; the least score.
INSIDE, AGREES, CONTRADICTS, FOR_PAYMENT, AGAINST_PAYMENT, SAME_KIND, LEAST = 0.35, 0.25, 0.35, 0.35, 0.4, 0.05, 0.15
#: A rate of commission in surroundings that don't speak of one loses points.
COMMISSION_CONTEXT, NO_COMMISSION = r"(?i)commission|佣金|rate|percent", 0.4
#: Different tokens of all slots up to which candidates list none but these; with more, they list all of theirs.
VOCABULARY = 200


@dataclass(frozen=True)
class Bonus:
    """Points for slots whose name matches `slot` if `pattern` is found before the value (or around it); not if `unless` is found around."""

    slot: str
    pattern: str
    points: float
    around: bool = False
    unless: str | None = None


#: Fixed values.
BONUSES = (
    Bonus("ai_video.*commission|commission.*ai_video", r"(?i)AI视频|ai video|带货成功", 0.65, around=True),
    Bonus("ai_video.*commission|commission.*ai_video", r"(?i)这条链接|挂链|affiliate", -0.55, unless=r"(?i)AI视频|ai video|带货成功"),
    Bonus("^commission_rate_gmv_gte_1k$", r"(?i)1k以上|1k 以上", 0.65),
    Bonus("^commission_rate_gmv_gte_1k$", r"(?i)1k以下|1k 以下", -0.55),
    Bonus("^commission_rate_gmv_lt_1k$", r"(?i)这条链接", 0.7),
    Bonus("^commission_rate_gmv_lt_1k$", r"(?i)1k以上|1k 以上", -0.55),
    Bonus("^commission_rate_gmv_lt_1k$", r"(?i)AI视频|ai video|带货成功", -0.55, around=True),
)

_CANDIDATE = "shop string, source_file string, kind string, value string, begin int, context string, value_at int, role string"


def _found(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, value, begin, end) of what looks like a value, links first."""
    for m in re.finditer(URL, text, re.I):
        yield "url", re.sub(r"(?<=\d)(You|you)$", "", m[0].rstrip(".,;)")).strip(), m.start(), m.end()
    for m in re.finditer(PERCENT, text):
        yield "percent", f"{m[1]}%", m.start(), m.end()
    for m in re.finditer(MONEY, text):
        yield "money", f"${m[1]}", m.start(), m.end()


def _is_noise(kind: str, value: str, context: str, authority: bool) -> bool:
    says = lambda pattern: re.search(pattern, context, re.I) is not None
    if kind == "url":
        return re.search(ASSET_HOST, value, re.I) is not None or says(ASSET_CONTEXT)
    if kind == "percent":
        return says(STYLE_CONTEXT) or not authority and says(POLICY_CONTEXT)
    large = float(value[1:].replace(",", "")) >= 1000 and re.search(SALES_CONTEXT, context, re.I) is not None
    return authority and (says(POLICY_CONTEXT) or says(EXAMPLE_CONTEXT) or large)


def _candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for shop, file, text in frame.itertuples(index=False):
            authority = re.search(AUTHORITY, file or "", re.I) is not None
            for kind, value, begin, end in _found(text or ""):
                first = max(0, begin - 96)
                context = re.sub(r"\s+", " ", text[first : end + 96]).strip()
                if value and not _is_noise(kind, value, context, authority):
                    at = begin - first if begin - first < len(context) else max(context.find(value), 0)
                    role = "authoritative" if authority else "policy" if re.search(POLICY_CONTEXT, context, re.I) else "illustrative"
                    rows.append((shop, file, kind, value, begin, context, at, role))
        yield pd.DataFrame(rows, columns=["shop", "source_file", "kind", "value", "begin", "context", "value_at", "role"])


def candidates(docs: DataFrame) -> DataFrame:
    """(shop, source_file, kind, value, begin, context, value_at, role) of values in docs (shop, source_file, text), noise left out.

    context is what stands within 96 characters, white space collapsed; value_at is the value's place in it. Built-in functions don't give
    places of matches in linear time, so texts go through Python once, dealt out however few files they come from. Null texts have none; equal rows give
    equal rows.
    """
    return dealt(docs.select("shop", "source_file", "text"), "shop", "source_file").mapInPandas(_candidates, _CANDIDATE)


def tokens(text: Column) -> Column:
    """Runs of Latin letters and digits in lower case, and thousands like 5k within them, each once."""
    low = F.lower(text)
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), 0), F.regexp_extract_all(low, F.lit("[0-9]+k"), 0)))


def _before(radius: int) -> Column:
    return F.substring(F.col("context"), F.greatest(F.col("value_at") - radius, F.lit(0)) + 1, F.least(F.col("value_at"), F.lit(radius)))


def _signs(text: Column, signs: dict[str, str]) -> Column:
    return F.filter(F.array(*[F.when(text.rlike(p), s) for s, p in signs.items()]), lambda s: s.isNotNull())


def _offered(slots: DataFrame) -> tuple[Column, Column]:
    """Tokens of a candidate's context and value, and slots' tokens that are parts of the value ("form" in https://formhub.example, from two letters,
    or single ones that are tokens of it). Of slots (tokens) with few different tokens, only these are listed, as others meet none."""
    low, value, none = F.lower("value"), tokens(F.col("value")), F.array().cast("array<string>")
    each = slots.select(F.explode("tokens").alias("token")).distinct()
    asked = sorted(r.token for r in each.limit(VOCABULARY + 1).collect())
    if len(asked) <= VOCABULARY:
        words = lambda some: F.array(*map(F.lit, some)).cast("array<string>")
        parts = F.filter(words([t for t in asked if len(t) > 1]), lambda t: F.contains(low, t))
        return F.array_intersect("offers", words(asked)), F.concat(parts, F.array_intersect(value, words([t for t in asked if len(t) == 1])))
    lengths = [r.n for r in each.select(F.length("token").alias("n")).distinct().collect()]

    def runs(n: int) -> Column:
        return F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, F.lit(n)))).otherwise(none)

    parts = F.flatten(F.array(none, *[runs(n) for n in lengths if n >= 2]))
    return F.col("offers"), F.array_distinct(F.concat(F.filter(parts, lambda p: p.rlike("^[a-z0-9]+$")), F.filter(value, lambda t: F.length(t) == 1)))


def scored_pairs(slots: DataFrame, found: DataFrame, least: float = LEAST, bonuses: tuple[Bonus, ...] = BONUSES) -> DataFrame:
    """(shop, slot, place, candidate, score) of slots (shop, slot, place) and found (candidates, with a number `candidate`) that score at least `least`.

    A score is the share of a slot's tokens in context and value, INSIDE of their share in the value (as a part of it, from two letters),
    points for signs and the kind, and bonuses. Pairs are made by tokens within a shop and a kind; signs are tokens too where they give points.
    What a score needs of a candidate goes with its tokens, and what it needs of a slot follows from the name, so candidates are read once and
    neither side is joined again.
    """
    wide = F.when(F.size("near") > 0, F.col("near")).otherwise(F.col("wide"))
    after = F.substring(F.col("context"), F.col("value_at") + F.length("value") + 1, F.lit(24))
    around = F.concat("before", after)
    hits = [F.coalesce((around if b.around else F.col("before")).rlike(b.pattern), F.lit(False)) & (F.lit(True) if b.unless is None else ~around.rlike(b.unless)) for b in bonuses]
    c = found.withColumns({"before": _before(48), "near": _signs(_before(32), NEAR_SIGNS)}).withColumn("wide", _signs(F.col("before"), WIDE_SIGNS))
    c = c.withColumns({"signs": wide, "hits": F.filter(F.array(*[F.when(h, F.lit(f"~{i}")) for i, h in enumerate(hits)]), lambda h: h.isNotNull())})
    c = c.select("shop", "kind", "candidate", "value", "near", "signs", "hits", tokens(F.concat_ws(" ", "context", "value")).alias("offers"), F.col("context").rlike(COMMISSION_CONTEXT).alias("pays"))

    asks = F.filter(F.array(*[F.when(F.col("slot").rlike(b.slot), F.lit(f"~{i}")) for i, b in enumerate(bonuses)]), lambda h: h.isNotNull())
    of_slot = {"tokens": tokens(F.replace("slot", F.lit("_"), F.lit(" "))), "slot_kind": slot_kind(F.col("slot")), "asks": asks}
    s = slots.select("shop", "slot", "place").withColumns(of_slot).where(F.size("tokens") > 0)
    kinds = F.when(F.col("slot_kind") == "any", F.array(*map(F.lit, ("url", "percent", "money")))).otherwise(F.array("slot_kind"))
    listed = s.withColumn("kind", F.explode(kinds)).select("shop", "slot", "place", "kind", F.explode(F.concat("tokens", "asks")).alias("token"))
    offers, parts = _offered(s)
    entry = lambda t, where: F.struct(t.alias("token"), F.lit(where).alias("where"))
    offered = F.concat(F.transform(offers, lambda t: entry(t, 0)), F.transform(parts, lambda t: entry(t, 1)), F.transform(F.array_distinct(F.concat("near", "signs", "hits")), lambda t: entry(t, 2)))
    about = ["near", "signs", "hits", "pays"]
    index = c.select("shop", "kind", "candidate", *about, F.inline(offered)).join(if_small(listed), ["shop", "kind", "token"])
    met = index.groupBy("shop", "slot", "place", "kind", "candidate", *about).agg(F.sum(F.when(F.col("where") == 0, 1).otherwise(0)).alias("shared"), F.sum(F.when(F.col("where") == 1, 1).otherwise(0)).alias("inside"))
    rows = met.withColumns(of_slot)

    asked, said = lambda w: F.array_contains("tokens", w), lambda w, of="signs": F.array_contains(of, w)
    n = F.size("tokens")
    score = F.col("shared") / n + INSIDE * F.col("inside") / n
    for own, other in (("gte", "lt"), ("lt", "gte")):
        score = score + F.when(asked(own) & said(own), AGREES).otherwise(0.0) - F.when(asked(own) & said(other), CONTRADICTS).otherwise(0.0)
    for own, other in (("first", "per"), ("per", "first")):
        score = score + F.when(asked(own) & said(own, "near"), FOR_PAYMENT).otherwise(0.0) - F.when(asked(own) & said(other, "near") & ~said(own, "near"), AGAINST_PAYMENT).otherwise(0.0)
    score = score + F.when(F.col("slot_kind") == F.col("kind"), SAME_KIND).otherwise(0.0) - F.when((F.col("slot_kind") == "percent") & asked("commission") & ~F.col("pays"), NO_COMMISSION).otherwise(0.0)
    for i, b in enumerate(bonuses):
        score = score + F.when(said(f"~{i}", "hits") & said(f"~{i}", "asks"), b.points).otherwise(0.0)
    return rows.withColumn("score", F.round(score, 6)).where(F.col("score") >= least).select("shop", "slot", "place", "candidate", "score")


def slot_values(slots: DataFrame, docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(shop, slot, value, source_file, score) for slots (shop, slot, place): the authoritative value that each gets, null without one.

    The best pairs are chosen one after another: by score, then the slot's place, then the candidate's file, kind and position. A slot
    gets one value; a candidate serves one slot, and so does a link wherever it stands. Slots are one row each; repeated documents add nothing.
    """
    order = F.struct("source_file", F.array_position(F.array(*map(F.lit, ("url", "percent", "money"))), F.col("kind")).alias("kind_place"), "begin")
    found = candidates(docs).where("role = 'authoritative'").dropDuplicates(["shop", "source_file", "kind", "value", "begin"])
    found = found.withColumn("candidate", F.struct(order.alias("order"), "shop", "kind", "value"))
    pairs = scored_pairs(slots, found, least)
    same = F.when(F.col("candidate.kind") == "url", F.col("candidate.value")).otherwise(F.to_json("candidate"))
    best = F.min_by(F.struct("score", "candidate"), F.struct(-F.col("score"), "candidate.order")).alias("best")
    pairs = pairs.withColumn("value", same).groupBy("shop", "slot", "place", "value").agg(best)
    pairs = pairs.select("shop", F.struct("place", "slot").alias("slot"), "value", "best.score", "best.candidate")
    ties = F.struct("candidate.order", "candidate.value")
    kept = assigned(pairs, "shop", least, ties=ties).select("shop", F.col("slot.slot").alias("slot"), "ties.value", F.col("ties.order.source_file").alias("source_file"), "score")
    return slots.select("shop", "slot").join(kept.hint("merge"), ["shop", "slot"], "left")
