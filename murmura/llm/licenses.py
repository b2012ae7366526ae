"""License scans by canonical digest: texts are normalised and their digests joined with those of known licenses.

Normal form: lower case; copyright lines and "all rights reserved" lines dropped; punctuation and white space alike; one of
several equivalent spellings. Whole texts are looked up, and so are single lines, as license notices are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import EQUIVALENT, NOTICES, TEXTS
from .runtime import if_small, prepare

#: A line with a copyright sign or word before a year, a sign or a placeholder; and a line of reserved rights.
COPYRIGHT = r"\n[^\p{L}\n]*(?:(?:copyright|copr\.?)[ \t]*(?:\(c\)|©|[0-9]{4}|[<\[{])|\(c\)[ \t]*[0-9]{4}|©)[^\n]*"
RESERVED = r"\n[^\p{L}\n]*all rights reserved[^\p{L}\n]*(?:\n|$)"
APART = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The normal form: words with a space on either side of each; null stays null."""
    out = F.concat(F.lit("\n"), F.lower(F.regexp_replace(text, "\r\n?", "\n")))
    out = F.regexp_replace(out, COPYRIGHT, "")
    out = F.regexp_replace(out, RESERVED, "\n")
    out = F.regexp_replace(F.concat(F.lit(" "), out, F.lit(" ")), APART, "  ")
    for one, other in EQUIVALENT:
        out = F.replace(out, F.lit(f" {one} "), F.lit(f" {other} "))
    return out


def digest(text: Column) -> Column:
    """SHA-256 of the normal form."""
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(digest, license_id) of known texts; of equal normal forms, the first id in order of text."""
    rows = spark.createDataFrame(sorted(texts.items()), "license_id string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def load(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(digest, license_id) of the license texts in a folder, one a file, named by the file without `.txt`: the table that scan
    takes as licenses. Of files with equal normal forms, the first name. The built-in texts are put in too."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    name = F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1), r"(?i)\.txt$", "")
    rows = files.select(name.alias("license_id"), digest(F.col("value")).alias("digest")).unionByName(known(spark, TEXTS).select("license_id", "digest"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def _spellings(word: str) -> set[str]:
    """The words that the normal form writes as this word."""
    out = {word}
    while more := {one for one, other in EQUIVALENT if other in out} - out:
        out |= more
    return out


def needles(forms: list[str]) -> list[str] | None:
    """Pieces of lower-case words of which any text with one of these normal forms has one; null if there are none such."""
    left, out = [[w for w in form.split() if re.fullmatch("[a-z0-9]+", w)] for form in forms], []
    while left:
        candidates = {w for words in left for w in words}
        if not all(left):
            return None
        covers = lambda w, words: any(all(any(x in y for x in _spellings(w)) for y in _spellings(v)) for v in words)
        best = max(sorted(candidates), key=lambda w: (sum(covers(w, words) for words in left), len(w)))
        out += sorted(_spellings(best))
        rest = [words for words in left if not covers(best, words)]
        if len(rest) == len(left):
            return None
        left = rest
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licenses: DataFrame | None = None, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(doc_id, digest, license_id, notices) of each row of docs.

    digest is of the whole text's normal form (null for a null text; an empty text has one like others), license_id the
    known license with that digest or null, notices the sorted ids, joined by commas, of notices that are a line of the
    text (empty if none). licenses is a table (digest, license_id) with unique digests; it is broadcast only if its size
    allows. Repeated rows come out as often as they came in; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    licenses = known(spark, TEXTS) if licenses is None else licenses.select("digest", "license_id")
    forms = [r.form for r in spark.createDataFrame([(t,) for t in notices.values()], "text string").select(canonical(F.col("text")).alias("form")).collect()]
    ids = [(r.digest, r.license_id) for r in known(spark, notices).collect()]  # as many as notices were given
    by_digest = F.create_map(*[F.lit(x) for pair in ids for x in pair]) if ids else None
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    if found := needles(forms):  # only lines that can be a notice are digested
        lines = F.filter(lines, lambda line: F.lower(line).rlike("|".join(found)))
    digests = F.transform(lines, digest)  # once a line, then looked up
    hits = F.filter(F.transform(digests, lambda d: F.try_element_at(by_digest, d)), lambda i: i.isNotNull()) if ids else F.array().cast("array<string>")
    found = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"), F.array_join(F.array_sort(F.array_distinct(hits)), ",").alias("notices"))
    return found.join(if_small(licenses), "digest", "left").select("doc_id", "digest", "license_id", "notices")
