"""Intents of messages by keywords: scores, ranks, merges, boosts, and the whole ranking of a message."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .conditions import in_allowed_scope

#: Keywords that become part of a plan; longer lists are searched by an automaton, in blocks of so many words.
MOST_WORDS, BLOCK = 2_000, 100_000


def _by_automaton(texts: DataFrame, words: list[tuple[str, str, int]]) -> DataFrame:
    """(id, intent, score): one pass over each text, whatever the number of words (intent, keyword in lower case, points)."""
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        of: dict[str, list[tuple[str, int]]] = {}
        for intent, word, points in shared.value:
            of.setdefault(word, []).append((intent, points))
        automaton = ahocorasick.Automaton()
        for word in of:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for batch in batches:
            at, intents, scores = [], [], []
            for i, low in enumerate(batch["low"].to_pylist()):
                total: dict[str, int] = {}
                for word in {w for _, w in automaton.iter(low or "")}:
                    for intent, points in of[word]:
                        total[intent] = total.get(intent, 0) + points
                at += [i] * len(total)
                intents += total
                scores += total.values()
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at, pa.int64())), pa.array(intents, pa.string()), pa.array(scores, pa.int32())], ["id", "intent", "score"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, intent string, score int")


def points(texts: DataFrame, keywords: DataFrame, weight: Column) -> DataFrame:
    """(id, intent, score) of texts (id, low: a text in lower case) and keywords (intent, keyword): the sum of the weights (a column of
    `keyword`) of the different keywords of an intent that the text contains, where there is one.

    Up to MOST_WORDS keywords are an expression of one pass in the JVM; longer lists go through an automaton, in blocks of BLOCK words
    whose scores are added up. Blank keywords count nothing.
    """
    rows = keywords.select("intent", F.lower("keyword").alias("keyword"), weight.cast("int").alias("points")).where("keyword <> ''").distinct()
    total = rows.count()
    if total <= MOST_WORDS:
        by_intent: dict[str, list[tuple[str, int]]] = {}
        for r in rows.orderBy("intent", "keyword").collect():
            by_intent.setdefault(r.intent, []).append((r.keyword, r.points))
        each = [F.struct(F.lit(i).alias("intent"), sum((F.when(F.contains("low", F.lit(w)), n).otherwise(0) for w, n in ws), F.lit(0)).alias("score")) for i, ws in by_intent.items()]
        none = F.array().cast("array<struct<intent:string,score:int>>")
        return texts.select("id", F.inline(F.filter(F.array(*each) if each else none, lambda p: p["score"] > 0)))
    blocks = -(-total // BLOCK)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("keyword"), F.lit(blocks)))
    found = None
    for n in range(blocks):
        part = _by_automaton(texts.select("id", "low"), [(r.intent, r.keyword, r.points) for r in dealt.where(F.col("block") == n).collect()])
        found = part if found is None else found.union(part)
    return found if blocks == 1 else found.groupBy("id", "intent").agg(F.sum("score").cast("int").alias("score"))


def keyword_scores(messages: DataFrame, keywords: DataFrame) -> DataFrame:
    """(message_id, intent, score) from (message_id, text) and (intent, keyword): two points for a keyword of over four
    characters that the text contains in any case, else one. Lists may be of any length."""
    texts = messages.select(F.col("message_id").alias("id"), F.lower("text").alias("low"))
    return points(texts, keywords, F.when(F.length("keyword") > 4, 2).otherwise(1)).withColumnRenamed("id", "message_id")


def ranked(scores: DataFrame, priorities: dict[str, int], keep: int = 8) -> DataFrame:
    """The best intents of each message by (-score, -priority, intent), with confidence relative to the best: 0.92 at most."""
    priority = F.coalesce(*[F.when(F.col("intent") == k, v) for k, v in priorities.items()], F.lit(0))
    own = Window.partitionBy("message_id")
    rows = scores.withColumn("priority", priority).withColumn("top", F.max("score").over(own))
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), F.desc("priority"), "intent"))).where(F.col("rank") <= keep)
    return rows.select("message_id", "intent", "score", F.col("rank").cast("long").alias("rank"), F.round(F.least(F.lit(0.92), 0.45 + 0.45 * F.col("score") / F.col("top")), 6).alias("confidence"))


def best_per_intent(candidates: DataFrame) -> DataFrame:
    """The greatest confidence of each intent of a message."""
    return candidates.groupBy("message_id", "intent").agg(F.max("confidence").alias("confidence"))


def boosted(candidates: DataFrame, messages: DataFrame, when: Column, intent: str, least: float) -> DataFrame:
    """Candidates with an intent at `least` at least for messages where a condition holds, put in where it is absent."""
    added = messages.where(when).select("message_id", F.lit(intent).alias("intent"), F.lit(least).alias("confidence"))
    return best_per_intent(candidates.select("message_id", "intent", "confidence").unionByName(added))


def top(candidates: DataFrame, threshold: float, k: int) -> DataFrame:
    """The k best intents over a threshold, by (-confidence, intent)."""
    place = F.row_number().over(Window.partitionBy("message_id").orderBy(F.desc("confidence"), "intent"))
    rows = candidates.where(F.col("confidence") >= threshold).withColumn("place", place)
    return rows.where(F.col("place") <= k).withColumn("place", F.col("place").cast("long"))


def emotion(text: Column) -> Column:
    """refusal, not_interested, interested or null, in this order of precedence."""
    low = F.lower(text)
    return F.when(low.rlike("stop|unsubscribe|reject"), "refusal").when(low.rlike("not interested|worthless|no thanks"), "not_interested").when(low.rlike("interested|thank|great"), "interested")


#: Fixed value: greetings, which have no obvious intention.
GREETING = r"^(hi|hello|hey|thanks|thank you)\b"


def _weight() -> Column:
    return F.when((F.length("keyword") > 4) | F.col("keyword").rlike(r"[^\x00-\x7F]"), 2).otherwise(1)


def _best_by_text(texts: DataFrame, keywords: DataFrame, keep: int) -> DataFrame:
    """(low, found): of each different text the intents that score, by (-score, -priority, intent), at most `keep`."""
    priority = keywords.groupBy("intent").agg(F.max("priority").alias("priority"))
    scores = points(texts.select("low", F.col("low").alias("id")).distinct(), keywords, _weight()).join(F.broadcast(priority), "intent")  # a row an intent
    row = F.struct((-F.col("score")).alias("score"), (-F.col("priority")).alias("p"), "intent")
    return scores.groupBy(F.col("id").alias("low")).agg(F.slice(F.array_sort(F.collect_list(row)), 1, keep).alias("found"))  # an entry an intent


def _exact_by_text(exact: DataFrame) -> DataFrame:
    replies = exact.select(F.lower("reply").alias("low"), F.struct((-F.col("priority")).alias("p"), F.col("intent").alias("intent")).alias("r"))
    return replies.groupBy("low").agg(F.min("r")["intent"].alias("exact"))


def classified(messages: DataFrame, exact: DataFrame, keywords: DataFrame) -> DataFrame:
    """messages without `message`, with (intent, confidence, matched_by): the intent whose whole reply the message is (by -priority,
    intent), else the one whose keywords score most (then by -priority, intent), else a greeting, else GEN.

    exact (intent, reply, priority); keywords (intent, keyword, priority): two points beyond ASCII or over four characters, else one.
    Equal messages are scored once. Null and blank messages are GEN with low confidence.
    """
    text = F.regexp_replace(F.coalesce("message", F.lit("")), r"^\s+|\s+$", "")
    rows = messages.withColumn("low", F.lower(text))
    rows = rows.join(_exact_by_text(exact), "low", "left").join(_best_by_text(rows.select("low"), keywords, 1), "low", "left").withColumn("best", F.get("found", F.lit(0)))
    blank, hit, word, greets = F.col("low") == "", F.col("exact").isNotNull(), F.col("best").isNotNull(), F.col("low").rlike(GREETING)
    return rows.withColumns({
        "intent": F.when(blank, "GEN").when(hit, F.col("exact")).when(word, F.col("best.intent")).when(greets, "No obvious intention").otherwise("GEN"),
        "confidence": F.when(blank, "low").when(hit | (F.col("best.score") <= -3), "high").when(word | greets, "medium").otherwise("low"),
        "matched_by": F.when(blank, "none").when(hit, "exact").when(word | greets, "keyword").otherwise("none"),
    }).drop("message", "low", "exact", "best", "found")


#: Confidences of a whole reply and a greeting, the least of a price refused, the threshold, and how many intents are returned.
EXACT, GREETED, REFUSED, LEAST, TOP = 0.9, 0.65, 0.92, 0.5, 3
RANKED = "array<struct<intent:string,confidence:double,matched_by:string,reason:string>>"


def ranking(messages: DataFrame, exact: DataFrame, keywords: DataFrame, groups: tuple[tuple[str, ...], ...] = (), boost: str = "CPM Rate", least: float = LEAST, k: int = TOP) -> DataFrame:
    """(message_id, intents): the best k intents of each message (message_id, message, allowed array, refuses_price boolean), as RANKED.

    A whole reply that is in scope decides alone. Else candidates are the eight best by keywords, or without any a whole reply out of
    scope or a greeting; where the price is refused, `boost` comes in with REFUSED at least, before others of its confidence. Those under `least` or out of
    scope go. Equal messages are scored once; blank ones have no intents.
    """
    text = F.regexp_replace(F.coalesce("message", F.lit("")), r"^\s+|\s+$", "")
    rows = messages.withColumn("low", F.lower(text))
    known = keywords.where(~F.col("intent").isin("GEN", "No obvious intention", "no_obvious_intention"))
    rows = rows.join(_exact_by_text(exact), "low", "left").join(_best_by_text(rows.select("low"), known, 8), "low", "left")
    entry = lambda intent, confidence, by, reason: F.struct(intent.alias("intent"), confidence.cast("double").alias("confidence"), F.lit(by).alias("matched_by"), reason.alias("reason"))
    none = F.array().cast(RANKED)
    highest = F.get("found", F.lit(0))["score"]
    by_words = F.transform("found", lambda f: entry(f["intent"], F.least(F.lit(REFUSED), F.lit(0.45) + f["score"] / F.greatest(-highest, F.lit(1)) * F.lit(-0.45)), "keyword", F.concat(F.lit("keyword_score="), -f["score"])))
    whole = F.array(entry(F.col("exact"), F.lit(EXACT), "exact", F.lit("exact_match")))
    greeting = F.array(entry(F.lit("No obvious intention"), F.lit(GREETED), "keyword", F.lit("greeting")))
    base = F.when(F.size("found") > 0, by_words).when(F.col("exact").isNotNull(), whole).when(F.col("low").rlike(GREETING), greeting).otherwise(none)
    refused = F.lit("price_refused")
    raised = F.transform("base", lambda c: F.when(c["intent"] == boost, entry(c["intent"], F.greatest(c["confidence"], F.lit(REFUSED)), "refined", refused)).otherwise(c))
    with_boost = F.when(F.exists("base", lambda c: c["intent"] == boost), raised).otherwise(F.concat(F.array(entry(F.lit(boost), F.lit(REFUSED), "refined", refused)), "base"))
    rows = rows.withColumn("base", base.cast(RANKED)).withColumn("base", F.when(F.col("refuses_price"), with_boost.cast(RANKED)).otherwise(F.col("base")))
    in_scope = lambda intent: in_allowed_scope(intent, F.coalesce("allowed", F.array().cast("array<string>")), groups)
    placed = F.array_sort(F.transform("base", lambda c, i: F.struct((-c["confidence"]).alias("worse"), i.alias("i"), c.alias("c"))))
    kept = F.slice(F.filter(F.transform(placed, lambda x: x["c"]), lambda c: (c["confidence"] >= least) & in_scope(c["intent"])), 1, k)
    alone = F.col("exact").isNotNull() & in_scope(F.col("exact"))
    return rows.select("message_id", F.when(F.col("low") == "", none).when(alone, whole.cast(RANKED)).otherwise(kept).alias("intents"))


def single(intents: Column) -> Column:
    """struct(intent, confidence, matched_by) of a ranking's first: high from 0.75, medium from 0.5; GEN, low, none without one."""
    first = F.get(intents, F.lit(0))
    label = F.when(first["confidence"] >= 0.75, "high").when(first["confidence"] >= 0.5, "medium").otherwise("low")
    return F.struct(F.coalesce(first["intent"], F.lit("GEN")).alias("intent"), label.alias("confidence"), F.coalesce(first["matched_by"], F.lit("none")).alias("matched_by"))
