"""A corpus pipeline: language, quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
docs; the last returns packed pieces. Extra columns of docs are carried along, whatever they are called. Of repeated rows the
first two stages keep or drop all, near duplicates keep one, and the last two take each as a document of its own; an empty table
gives an empty result in each.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm import language, quality
from murmura.llm.jaccard import jaccard_components
from murmura.llm.packing import pack_documents
from murmura.llm.queries import held_out
from murmura.llm.runtime import if_small, materialize
from murmura.llm.substring_dedup import remove_repeats

#: Share of a document's letters that must be in its language; below, no learned language explains it.
LEAST_SCORE = 0.2


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that clash with none of an operator's, and old name to new."""
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _filtered(found: DataFrame, names: dict[str, str], keep: Column) -> DataFrame:
    return found.where(keep).select(*names.values()).toDF(*names)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or with most letters in scripts that no learned language uses, go."""
    model = language.train(docs.where(~held_out()), sample_docs=4_000)
    rows, names = _renamed(docs)
    found = language.identify(rows, model, text_col=names["text"], keep=tuple(names.values()), penalty=16.0)
    return _filtered(found, names, (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go. The field learns from labelled documents that are left."""
    crf = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), sample_docs=2_000)
    rows, names = _renamed(docs)
    found = quality.quality(rows, crf, text_col=names["text"], keep=tuple(names.values()), least_words=50, repeat_percent=50, share=0.5)
    return _filtered(found, names, F.col("kept"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates stays, once; documents with a null id all stay.

    Rows are told apart by id and text, as an id may stand on several texts.
    """
    groups = materialize(jaccard_components(docs, n=5, percent=75, tell_texts=True), "components")
    gone, heads = groups.where("doc_id <> component_id").select("doc_id", "text_id"), groups.where("doc_id = component_id")
    repeated = heads.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if repeated:  # of several texts of one id that head the same group, the one with the least hash stays
        least = heads.where("component is not null").groupBy("component").agg(F.min("text_id").alias("least"))
        gone = gone.union(heads.join(least, "component").where("text_id <> least").select("doc_id", "text_id"))
    gone = if_small(materialize(gone.distinct().toDF("__id", "__text_id"), "gone"))
    left = docs.join(gone, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__text_id")), "left_anti").select(*docs.columns)
    if repeated:  # only then are texts shuffled; null ids are told apart by a random number
        left = left.withColumns({"__one": F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()), "__text": F.xxhash64("text")})
        left = left.dropDuplicates(["doc_id", "__text", "__one"]).drop("__text", "__one")
    return left


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words or more that stand elsewhere too are cut out of the texts; n_chars counts what is left."""
    rows, names = _renamed(docs)
    kept = remove_repeats(rows, id_col=names["doc_id"], text_col=names["text"], span=35, keep=tuple(v for k, v in names.items() if k != "text"))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return kept.select(*[new.get(k, F.col(v)).alias(k) for k, v in names.items()])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", by_language),
    ("quality", by_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("repeats", without_repeats),
    ("packing", packed),
]

#: Language, quality and tokens come from trained models and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again, but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
