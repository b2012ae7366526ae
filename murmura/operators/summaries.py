"""Composite reports: a day in a few lines, audit rows with whole histories and transcripts, and requests with what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import message_text
from ..functions.text import stripped
from .common import if_small
from .reports import chunked_lines, numbered

#: The lines of a daily report, plain and as Markdown.
LINES = {
    "window": ("统计区间：{}", "**统计区间：** {}"), "inquiries": ("达人问询数：{}个人（{}）", "**达人问询数：** {}个人（{}）"),
    "replies": ("AI回复次数：{}次；", "**AI回复次数：** {}次；"), "keywords": ("关键词回复次数：{}次（其中 {}）", "**关键词回复次数：** {}次（其中 {}）"),
}
NONE = "无"


def _listed(counts: DataFrame, name: str, entry: str, between: str) -> DataFrame:
    """One row (total, inner): names with their counts by (-n, name) as text. counts has a row for each source or keyword."""
    shown = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("worse"), F.col(name).alias("name")))), lambda x: F.format_string(entry, x["name"], -x["worse"]))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.when(F.count("*") > 0, F.array_join(shown, between)).otherwise(NONE).alias("inner"))


def daily(audit: DataFrame, keywords: DataFrame, start: str, end: str) -> DataFrame:
    """One row (plain, markdown) of audit (create_time, source, creator_name, message_info) and keyword rows (create_time, source, key_words)
    from start to end, both included: inquiries by source in both logs, replies, and keyword replies by keyword. Blank sources are left
    out of the inquiries. Only counts by source and keyword meet in one row."""
    within = F.col("create_time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    a, k = audit.where(within), keywords.where(within)
    source = stripped(F.coalesce("source", F.lit("")))
    by_source = lambda df: df.select(source.alias("source")).where("source <> ''").groupBy("source").agg(F.count("*").alias("n"))
    both = by_source(a).union(by_source(k)).groupBy("source").agg(F.sum("n").alias("n"))
    inquiries = _listed(both, "source", "%s：%d人", "，").select(F.col("total").alias("people"), F.col("inner").alias("sources"))
    words = _listed(k.groupBy("key_words").agg(F.count("*").alias("n")), "key_words", "【%s】触发：%d人", "； ").select(F.col("total").alias("hits"), F.col("inner").alias("words"))
    replied = a.where((F.trim("creator_name") != "") & (F.trim("message_info") != "")).agg(F.count("*").alias("replies"))
    one = inquiries.crossJoin(words).crossJoin(replied)  # one row each
    window = F.lit(f"{start[:16]} ~ {end[:16]}")
    values = {"window": (window,), "inquiries": ("people", "sources"), "replies": ("replies",), "keywords": ("hits", "words")}
    made = lambda n: F.array_join(F.array(*[F.format_string(LINES[name][n].replace("%", "%%").replace("{}", "%s"), *args) for name, args in values.items()]), "\n")
    return one.select(F.concat(made(0), F.lit("\n")).alias("plain"), made(1).alias("markdown"))


def transcripts(audit: DataFrame) -> DataFrame:
    """(creator, position, line): lines of a creator's messages in order of time, each text once, without blank and system lines.

    audit has id, creator_name, create_time and message_info, which may be JSON. The first of equal lines is found by a minimum that is combined before the
    shuffle; positions are by parts, so that a creator with most lines takes many tasks.
    """
    lines = audit.select(F.trim("creator_name").alias("creator"), "create_time", "id", F.posexplode(F.split(message_text(F.col("message_info")), "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", stripped("line")).where((F.col("line") != "") & ~F.contains(F.lower("line"), F.lit("[system]")))
    first = lines.groupBy("creator", "line").agg(F.min(F.struct("create_time", "id", "pos")).alias("at"))
    return numbered(first, ["creator"], [F.col("at").asc()], "position").select("creator", "position", "line")


def with_histories(audit: DataFrame, timeline: DataFrame, lines: DataFrame, size: int = 100) -> DataFrame:
    """(id, creator, part, chunk, text): each audit row with its creator's history and transcript, in chunks of `size` lines.

    timeline (creator, position, text) and lines (creator, position, line) are numbered within a creator; chunks are made once a creator and then joined to
    its rows. Creators without either have no rows.
    """
    history = chunked_lines(timeline, ["creator"], "position", F.col("text"), size, "text").select("creator", F.lit("history").alias("part"), "chunk", "text")
    chat = chunked_lines(lines, ["creator"], "position", F.col("line"), size, "text").select("creator", F.lit("chat").alias("part"), "chunk", "text")
    rows = audit.select("id", F.trim("creator_name").alias("creator")).where("creator <> ''")
    return rows.join(history.union(chat), "creator").select("id", "creator", "part", "chunk", "text")


def with_state(requests: DataFrame, state: DataFrame) -> DataFrame:
    """requests with what is stored of their creator in their shop, for fields that they leave open.

    requests and state have creator_id, shop, tier, progress, emotion, sales and conditions; state also rejected, one row for each creator and
    shop. Null, blank and GEN texts, null numbers and empty lists are open; stored GEN fills nothing. rejected is false without a state. A request
    without a creator or a shop meets none.
    """
    fields = ("tier", "progress", "emotion", "sales", "conditions")
    key = lambda c: F.nullif(F.trim(c), F.lit(""))
    stored = state.select(key("creator_id").alias("__creator"), key("shop").alias("__shop"), *[F.col(c).alias(f"__{c}") for c in fields], F.col("rejected").alias("__rejected"))
    met = requests.join(if_small(stored), (key("creator_id") == F.col("__creator")) & (key("shop") == F.col("__shop")), "left")
    text = lambda c: F.when(F.upper(F.trim(c)).isin("", "GEN"), None).otherwise(F.trim(c))
    items = lambda c: F.when(F.size(F.filter(c, lambda x: ~F.upper(F.trim(x)).isin("", "GEN"))) > 0, F.col(c))
    filled: dict[str, Column] = {c: F.coalesce(text(c), text(f"__{c}"), F.lit("GEN")) for c in ("tier", "emotion")}
    filled |= {c: F.coalesce(items(c), items(f"__{c}"), F.array().cast("array<string>")) for c in ("progress", "conditions")}
    filled |= {"sales": F.coalesce("sales", "__sales"), "rejected": F.coalesce("__rejected", F.lit(False))}
    kept = [c for c in requests.columns if c not in filled]
    return met.select(*kept, *[c.alias(n) for n, c in filled.items()])
