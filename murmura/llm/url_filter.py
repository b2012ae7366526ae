"""URL filters: allow and block rules, and link-graph propagation of trust and distrust for what no rule decides.

Hosts with allowed pages seed a personalised PageRank along the links between hosts; hosts with blocked pages seed one
against them, so that who links to blocked hosts gets distrust. A threshold on their difference decides each host.
Everything is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import checkpoint_dir, materialize

#: Links that leave a host: any href or src with an authority.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ? or #, with A-Z in lower case; empty without :// or for null."""
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    return F.when(F.instr(url, "://") > 0, F.translate(host, _UPPER, _LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What stands after the host up to ? or #; empty without :// or for null."""
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none; ties go to the first in order of text.

    A rule is host and path in one, like `example.com/de/`: it fits the host and its subdomains where the path starts with
    the rule's. The list is part of the plan, so it should have thousands of rules at most.
    """
    ordered = sorted(set(rules), key=lambda r: (-len(r[0]), r[0], r[1]))
    if not ordered:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    made = [F.struct(F.lit(r.partition("/")[0]).alias("h"), F.lit("/" + r.partition("/")[2] if "/" in r else "").alias("p"), F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in ordered]
    fits = F.filter(F.array(*made), lambda x: ((host == x["h"]) | host.endswith(F.concat(F.lit("."), x["h"]))) & path.startswith(x["p"]))
    first = F.try_element_at(fits, F.lit(1))
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int, every: int = 4, least: float = 1e-9) -> DataFrame:
    """(kind, host, score) from edges (kind, source, target, share) and seeds (kind, host, seed): score = seed + damping * sum of
    share * score over incoming edges, iterated. It stops after `rounds`, or when no score changes by `least` any more.

    Scores are summed with map-side combining, so a host that a third of all links lead to costs one row a task.
    """
    checkpoint_dir(edges.sparkSession)
    scores = seeds.select("kind", "host", F.col("seed").alias("score"))
    for n in range(1, rounds + 1):
        moved = scores.join(edges.withColumnRenamed("source", "host"), ["kind", "host"]).groupBy("kind", F.col("target").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("moved"))
        after = seeds.join(moved, ["kind", "host"], "full").select("kind", "host", (F.coalesce("seed", F.lit(0.0)) + damping * F.coalesce("moved", F.lit(0.0))).alias("score"))
        if n % every == 0 or n == 1:
            after = after.checkpoint()
            change = after.join(scores.withColumnRenamed("score", "old"), ["kind", "host"], "full").agg(F.max(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
            if (change or 0.0) < least:
                return after
        scores = after
    return scores


def host_scores(ruled: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(host, trust, distrust) from rows (host, verdict or null, html): what a host has of itself is its share of allowed or
    blocked pages; the rest comes along links. Null and empty html has no links; links within a host don't count."""
    pages = ruled.where("host <> ''")
    own = pages.groupBy("host").agg(F.avg(F.when(F.col("verdict") == "allow", 1.0).otherwise(0.0)).alias("allow"), F.avg(F.when(F.col("verdict") == "block", 1.0).otherwise(0.0)).alias("block"))
    seeds = materialize(own.select("host", F.expr("stack(2, 'trust', allow, 'distrust', block) as (kind, seed)")), "seeds").where("seed > 0")
    found = pages.where("html is not null").select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("to"))
    found = found.select("host", F.translate("to", _UPPER, _LOWER).alias("to")).where("host <> to")
    links = materialize(found.groupBy("host", "to").agg(F.count("*").alias("n")), "links")
    out, into = links.groupBy("host").agg(F.sum("n").alias("total")), links.groupBy("to").agg(F.sum("n").alias("total"))
    forward = links.join(out, "host").select(F.lit("trust").alias("kind"), F.col("host").alias("source"), F.col("to").alias("target"), (F.col("n") / F.col("total")).alias("share"))
    backward = links.join(into, "to").select(F.lit("distrust").alias("kind"), F.col("to").alias("source"), F.col("host").alias("target"), (F.col("n") / F.col("total")).alias("share"))
    scores = propagate(materialize(forward.union(backward), "edges"), seeds, damping, rounds)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)
    return scores.groupBy("host").agg(of("trust"), of("distrust"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.5, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of each row of pages.

    verdict is the rule's; without one, a host with distrust - trust over the threshold is blocked and any other allowed. Scores
    are not normalised: a host starts with its own share of allowed or blocked pages, 0 to 1, so 0.5 is what a host has half of
    whose pages are blocked, and what reaches a host along links is damped by each step. A score at the threshold is allowed.
    A null url, or one without ://, has an empty host and path, fits no rule and is allowed. Repeated rows come out as
    often as they came in, and a null id stays null; an empty table gives an empty result; other columns are not read.
    """
    url = F.col(url_col)
    ruled = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).alias("html"))
    ruled = ruled.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    scores = materialize(host_scores(ruled.select("host", F.col("r.verdict").alias("verdict"), "html"), damping, rounds), "scores")
    zero = F.lit(0.0)
    bad = F.round(F.coalesce("distrust", zero) - F.coalesce("trust", zero), 9) > threshold
    return ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"),
    )
