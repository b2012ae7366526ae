"""What a creator's message means, and what is answered without a model: flags, intents, refusals, messenger groups, effects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quotes import _let, quote
from .records import REFUSAL_PHRASES, SHORT_REFUSALS
from .text import stripped

#: Whole messages that set flags, in order of trial.
WHOLE = (
    (("ok", "sure"), ("reply_ok",)),
    (("yes", "interested"), ("reply_yes", "reply_interested")),
    (("ai",), ("reply_ai",)),
    (("stop", "unsubscribe", "dnc"), ("reply_reject",)),
    (("no", "nope", "nah", "pass", "decline", "not interested", "no thanks", "no thank you"), ("reply_reject",)),
)
#: Fixed value: words that refuse.
REFUSES = r"(?i)\b(not interested|no thanks|won'?t|can'?t do)\b"
#: What else sets a flag, in order.
SAID = (
    ("reply_ok", r"(?i)replied\s+'?OK'|accept.*pure commission|reply.*\bok\b"),
    ("reply_sure", r"(?i)replied\s+'?Sure'|\breply_sure\b"),
    ("reply_interested", r"(?i)\bYes\b|\bInterested\b|strong interest"),
    ("reply_reject", r"(?i)rejected|declined|refused"),
    ("reply_quote", r"(?i)provides?\s+a\s+quote|bottom.?line|minimum rate|asked for flat fee|flat fee only"),
    ("reply_ai", r"(?i)replied\s+'?AI'|\bAI\b.*trigger"),
)
#: Requests for samples, acceptance, offers made before, and prices.
SAMPLE_QUESTION = r"(?i)\b(how|what|where|when|why|can\s+i|could\s+i|do\s+i|apply)\b.{0,48}\b(sample|samples)\b|\b(sample|samples)\b.{0,24}\b(apply|application|get|receive|ship)\b"
SAMPLE_REQUEST = r"(?i)\b(want|need|send|get|apply\s+for|request)\b.{0,32}\b(sample|samples)\b|\bfree\s+sample\b|\bsend\s+me\s+(the\s+)?sample\b"
TWO_VIDEOS = r"(?i)\b(2|two)\s+(short\s+)?videos?\b|一条样品.*两条视频|1\s*sample.*2\s*video"
AGREES = r"(?i)\b(yes|ok|sure|agree|accept|interested|i'?m\s+in|deal)\b"
ACCEPTS = r"(?i)^(yes|ok|okay|sure|interested!?|i'?m\s+in|sounds\s+good|let'?s\s+do\s+it)\b"
OFFERED_TWO_VIDEOS = r"(?i)\b2\s+short\s+videos?\b|\basked\s+for\s+2\s+short\s+videos?\b|two\s+videos?\s+back|2\s+videos?\s+in\s+return"
OFFERED_AI = r"(?i)ai\s+ugc|ready-to-post\s+ai\s+video|no\s+filming|creator\s+portal|\$1\s+per\s+video|\$5\s+bonus|reply\s+'ai'|scan\s+the\s+qr|join\s+our\s+wa\s+group|easy\s+collab"
OFFERED_COMMISSION = r"(?i)commission-only|pure.?commission|open\s+plan|commission\s+only"
CPM = r"(?i)\bcpm\b|flat\s+fee\s+on\s+top|base\s+payment|base\s+rate|what(?:'s|\s+is)\s+the\s+rate|can\s+you\s+do\s+cpm|guaranteed\s+payment"
TOO_LOW = r"(?i)too\s+low|so\s+low|not\s+enough|price\s+is|proce\s+is|rate\s+is\s+low|commission\s+is\s+too|pay\s+is\s+too|need\s+(?:a\s+)?base|want\s+more"
FLAT_FEE_ONLY = r"(?i)flat\s+fee\s+only|fixed\s+price\s+only|i\s+don'?t\s+want\s+cpm|just\s+give\s+me\s+a\s+flat|flat\s+rate\s+only|one[- ]?video\s+flat\s+fee\s+only"
#: Emotions by words, and how they are called.
EMOTION_REFUSES = r"(?i)\b(no\b|not interested|pass|decline|stop|unsubscribe|reject|won'?t)\b|don'?t\s+want|not\s+for\s+me"
EMOTION_NOT_NOW = r"(?i)not\s+interested|no\s+thanks|maybe\s+later|not\s+now|pass\s+on|不感兴趣|暂时不|不考虑"
EMOTION_INTERESTED = r"(?i)\b(yes|sure|ok|interested|sounds?\s+good|i'?m\s+in|deal|let'?s\s+do)\b|感兴趣|可以|好的"
REFUSED, NOT_NOW, INTERESTED = "拒绝合作", "当前聊天主题不感兴趣", "感兴趣或同意"
#: Answers about a messenger group.
NO_MESSENGER = r"(?i)(?:don'?t\s+have\s+whatsapp|no\s+whatsapp|without\s+whatsapp|don'?t\s+use\s+whatsapp|没有\s*whatsapp|没有\s*wa|不用\s*whatsapp)"
SHARED_NUMBER = r"(?i)(?:my\s+whatsapp\s+(?:is|number)|whatsapp\s*(?:is|:)?\s*(\+?[0-9][0-9\s\-()]{7,20}))|(?:whatsapp|wa).{0,20}(\+?[0-9][0-9\s\-()]{9,18}[0-9])"
NUMBER_ONLY = r"(?:^|\s)(\+?[0-9][0-9\s\-()]{9,18}[0-9])(?:\s|$)"
NOT_FOUND = r"(?i)(?:can'?t\s+find|cannot\s+find|didn'?t\s+find|not\s+find|找不到|没找到|找不到群|链接打不开|link\s+doesn'?t\s+work|where\s+is\s+the\s+group)"
JOINED = r"(?i)(?:\b(?:i\s+)?joined\b|\b(?:i\s+)?added\b|already\s+in|published\+joined|scanned\s*\+\s*completed|我加了|已经加入|加入了群|加好了)"
#: Steps of progress.
SAMPLE_ASKED, SAMPLE_NOT_ASKED, SHOWCASED, NOT_SHOWCASED = "已申请批样", "未申请批样", "已加窗", "未加窗"


def _said(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def _strings(items: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, items)).cast("array<string>")


def reply_flags(message: Column) -> Column:
    """Flags that a message sets: by the whole message, by words that refuse, else by what it says, in order; none for null."""
    text = stripped(F.coalesce(message, F.lit("")))
    low = F.lower(text)
    found = F.filter(F.array(*[F.when(_said(text, p), F.lit(flag)) for flag, p in SAID]), lambda f: f.isNotNull())
    out = F.when(text == "", _strings(()))
    for whole, flags in WHOLE:
        out = out.when(low.isin(*whole), _strings(flags))
    return out.when(_said(text, REFUSES), _strings(("reply_reject",))).otherwise(F.array_distinct(found))


def refuses_outreach(message: Column) -> Column:
    """Whether a message refuses to work together: by a flag, as a short refusal, or by a phrase; false for null and blank."""
    text = stripped(F.coalesce(message, F.lit("")))
    short = F.regexp_replace(F.lower(text), r"[.!]+$", "")
    return (text != "") & (F.array_contains(reply_flags(text), "reply_reject") | short.isin(*SHORT_REFUSALS) | _said(text, REFUSAL_PHRASES))


def rejects_price(message: Column, context: Column) -> Column:
    """Whether a message finds the price too low after an offer of commission."""
    return (F.coalesce(F.trim(message), F.lit("")) != "") & _said(message, TOO_LOW) & _said(context, OFFERED_COMMISSION)


def bare_accept(message: Column) -> Column:
    return _said(stripped(F.coalesce(message, F.lit(""))), ACCEPTS)


def confirms_two_videos(message: Column, context: Column) -> Column:
    """Whether a message accepts two videos for a sample: it says so itself, or it accepts after the offer."""
    text = stripped(F.coalesce(message, F.lit("")))
    whole = F.lower(text).isin("yes", "interested", "ok", "sure", "yes, i'm interested!")
    return (text != "") & ((_said(text, TWO_VIDEOS) & _said(text, AGREES)) | (_said(context, OFFERED_TWO_VIDEOS) & (bare_accept(text) | whole)))


def asks_for_sample(message: Column) -> Column:
    text = stripped(F.coalesce(message, F.lit("")))
    return _said(text, SAMPLE_QUESTION) | (_said(text, SAMPLE_REQUEST) & ~confirms_two_videos(text, F.lit("")))


def refined_intent(intent: Column, confidence: Column, message: Column, context: Column) -> Column:
    """struct(intent, confidence, hint) after a ladder of corrections, the first that holds; without one, as it was, no hint."""
    text = stripped(F.coalesce(message, F.lit("")))
    now = lambda name, conf, hint: F.struct(F.lit(name).alias("intent"), (F.lit(conf) if isinstance(conf, str) else conf).alias("confidence"), F.lit(hint).alias("hint"))
    asked = F.contains(text, F.lit("?")) | F.lower(text).rlike("^(how|what|can)")
    interested = F.lower(intent).isin("interest", "ok", "强意向") & _said(text, r"(?i)\b(interested|yes)\b") & _said(context, OFFERED_TWO_VIDEOS)
    same = F.struct(intent.alias("intent"), confidence.alias("confidence"), F.lit(None).cast("string").alias("hint"))
    return (
        F.when(text == "", same)
        .when(asks_for_sample(text), now("Ask for samples", F.when(asked, "high").otherwise(confidence), "sample_inquiry_not_strong_intent"))
        .when(confirms_two_videos(text, context), now("interest", "high", "one_sample_two_videos_confirmed"))
        .when(_said(context, OFFERED_AI) & bare_accept(text), now("AI-UGC Earnings", "high", "ai_ugc_pitch_accept"))
        .when(_said(text, FLAT_FEE_ONLY), now("Flat Fee", "high", "a_tier_flat_fee_only"))
        .when(rejects_price(text, context), now("CPM Rate", "high", "a1_reject_price_too_low_to_a2_cpm"))
        .when(_said(text, CPM), now("CPM Rate", "high", "a_tier_cpm_negotiation"))
        .when(F.coalesce(interested, F.lit(False)), now("GEN", "medium", "interested_without_two_video_confirmation"))
        .otherwise(same)
    )


def enriched_flags(flags: Column, message: Column, context: Column) -> Column:
    """Flags with those that a bare yes adds, after an offer of AI videos one more; each once, in order."""
    more = F.when(bare_accept(message), F.concat(_strings(("reply_yes", "reply_interested")), F.when(_said(context, OFFERED_AI), _strings(("reply_ai",))).otherwise(_strings(()))))
    return F.array_distinct(F.concat(flags, F.coalesce(more, _strings(()))))


def inferred_emotion(message: Column, preset: Column, accepts_count: bool = True) -> Column:
    """The emotion given, else by a bare yes (where accepts_count), by flags and words; GEN without any."""
    text = stripped(F.coalesce(message, F.lit("")))
    given = F.trim(preset)
    flags = reply_flags(text)
    bare = bare_accept(text) if accepts_count else F.lit(False)
    interested = F.arrays_overlap(flags, _strings(("reply_interested", "reply_yes")))
    return (
        F.when(~F.upper(given).isin("", "GEN"), given).when(text == "", "GEN").when(bare, INTERESTED)
        .when(F.array_contains(flags, "reply_reject") | _said(text, EMOTION_REFUSES), REFUSED)
        .when(_said(text, EMOTION_NOT_NOW), NOT_NOW).when(interested | _said(text, EMOTION_INTERESTED), INTERESTED).otherwise("GEN")
    )


def messenger_answer(message: Column) -> Column:
    """no_whatsapp, shared_number, not_found or joined, the first that holds; null for any other message."""
    text = stripped(F.coalesce(message, F.lit("")))
    number = _said(text, SHARED_NUMBER) | (_said(text, "(?i)whatsapp|wa") & _said(text, NUMBER_ONLY))
    return F.when(_said(text, NO_MESSENGER), "no_whatsapp").when(number, "shared_number").when(_said(text, NOT_FOUND), "not_found").when(_said(text, JOINED), "joined")


def next_step(progress: Column, answer: Column) -> Column:
    """What a creator is asked for next: sample_review, sample or showcase."""
    has = lambda p: F.array_contains(progress, p)
    return (
        F.when(has(SAMPLE_ASKED), "sample_review").when((answer == "joined") & has(SHOWCASED) & has(SAMPLE_NOT_ASKED), "sample")
        .when(has(NOT_SHOWCASED) | (F.size(progress) == 0), "showcase").when(has(SHOWCASED), "sample").otherwise("showcase")
    )


def messenger_value(answer: Column) -> Column:
    """What is stored of a messenger answer: 1 joined, 2 no messenger, else nothing."""
    return F.when(answer == "joined", 1).when(answer == "no_whatsapp", 2)


def sales_slot(kind: str, monthly_sales: Column) -> Column:
    """The slot of a link by monthly sales: from 1000, or under it and unknown."""
    return F.when(monthly_sales >= 1000, f"{kind}_gmv_gte_1k").otherwise(f"{kind}_gmv_lt_1k")


#: Actions and what they change: a column that is set to a value, the quote of the message, the state, or nothing.
EFFECTS: dict[str, tuple[str, str | None, str | None]] = {
    "one_sample_two_videos": ("set", "cooperation_intention", "one_sample_two_videos"),
    "add_to_ai_ugc_roster": ("set", "cooperation_intention", "ai_ugc_roster"),
    "join_wa_1": ("set", "join_wa", "1"),
    "join_wa_2": ("set", "join_wa", "2"),
    "mark_dnc": ("reject", "shop_rejected", "true"),
    "log_creator_quote": ("quote", "expert_quote", "creator_quote"),
    "send_flat_fee_offer": ("quote", "expert_quote", "creator_flat_fee"),
    "flat_fee_agreed": ("quote", "expert_quote", "creator_flat_fee"),
    "send_cpm_offer": ("none", None, "cpm_offer_sent_in_reply"),
    "push_commission_sample": ("none", None, "commission_sample_sent_in_reply"),
    "send_a1_opening": ("none", None, "a1_opening_sent_in_reply"),
    "send_whatsapp_group_link": ("none", None, "whatsapp_link_in_reply"),
    "send_affiliate_link": ("none", None, "affiliate_link_in_reply"),
}


def effect(action: Column, creator: Column, message: Column, effects: dict[str, tuple[str, str | None, str | None]] = EFFECTS) -> Column:
    """struct(kind, target, value, note) of an action's change; null for an unknown action or without a creator.

    effects is a registry that callers may extend: name to (kind, column, value). Of kind quote, the value is the amount in the
    message and the note its type; without an amount, kind is none.
    """
    names = [n for n, (kind, _, _) in effects.items() if kind == "quote"]
    amount = F.when(action.isin(*names), quote(message)["amount_usd"].cast("string"))
    return _let(amount, lambda a: _effect(action, creator, a, effects))


def _effect(action: Column, creator: Column, amount: Column, effects: dict[str, tuple[str, str | None, str | None]]) -> Column:
    out = F.when(F.coalesce(F.trim(creator), F.lit("")) == "", F.lit(None).cast("struct<kind:string,target:string,value:string,note:string>"))
    for name, (kind, target, value) in effects.items():
        text = F.lit(None).cast("string")
        if kind == "quote":
            found = F.struct(F.lit("quote").alias("kind"), F.lit(target).alias("target"), amount.alias("value"), F.lit(value).alias("note"))
            missing = F.struct(F.lit("none").alias("kind"), text.alias("target"), text.alias("value"), F.lit("no_amount_in_message").alias("note"))
            made = F.when(amount.isNotNull(), found).otherwise(missing)
        elif kind == "none":
            made = F.struct(F.lit(kind).alias("kind"), text.alias("target"), text.alias("value"), F.lit(value).alias("note"))
        else:
            made = F.struct(F.lit(kind).alias("kind"), F.lit(target).alias("target"), F.lit(value).alias("value"), text.alias("note"))
        out = out.when(action == name, made)
    return out


def goodbye(language: Column, signature: str) -> Column:
    """The farewell after a first refusal, in the language asked for, signed."""
    zh = F.startswith(F.lower(F.trim(language)), F.lit("zh")) | F.contains(language, F.lit("中文"))
    body = F.when(F.coalesce(zh, F.lit(False)), "很遗憾听到这个消息，这里就不再打扰你了。祝你一切顺利！").otherwise("I'm sorry to hear that. I won't reach out about this again. All the best!")
    return F.concat(body, F.lit(f"\n\n- {signature}"))
