"""Importance resampling towards a target: documents whose runs of words are more frequent in the target are drawn more often.

Each partition keeps a trie of the word runs it meets. A node is a run; it has the CRC-32 state of its text, so that a longer run
goes on from there, and a count. Counts become bucket totals, which Spark adds up. Documents are scored by walking tries whose
nodes have their bucket's gain attached; of the scores with Gumbel noise, the highest are drawn.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, numbered, prepare, utf8

#: Bytes that belong to words, A-Z as a-z; all others separate: digits, letters, and all of other scripts.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: A trie is given up, its counts first, once it has so many nodes or bytes of words.
MOST_NODES, MOST_BYTES = 300_000, 32 << 20


def words(text: bytes | None) -> list[bytes]:
    """Lower-case words of a UTF-8 text."""
    return (text or b"").translate(_WORD_BYTES).split()


class Node(dict):
    """Word to the node of the run that goes on with it."""

    __slots__ = ("amount", "state", "trie")

    def __init__(self, trie: Trie, state: int, amount: int) -> None:
        self.trie, self.state, self.amount = trie, state, amount

    def __missing__(self, word: bytes) -> Node:
        trie = self.trie
        state = zlib.crc32(word if self is trie.root else b" " + word, self.state)
        self[word] = node = Node(trie, state, trie.gains[state % trie.buckets] if trie.gains else 0)
        trie.nodes += 1
        trie.bytes += len(word)
        return node


class Trie:
    """Runs of 1 to n words. Without gains, a node's amount counts its run; with gains, it is its bucket's gain."""

    def __init__(self, n: int, buckets: int, gains: list[int] | None = None) -> None:
        self.n, self.buckets, self.gains = n, buckets, gains
        self.clear()

    def clear(self) -> None:
        self.nodes = self.bytes = 0
        self.root = Node(self, 0, 0)

    @property
    def full(self) -> bool:
        return self.nodes > MOST_NODES or self.bytes > MOST_BYTES

    def paths(self, found: list[bytes]) -> Iterator[tuple[tuple, int]]:
        """The runs of n words that begin at each word, shorter at the end (None), and how often each is met."""
        return iter(Counter(zip_longest(*(found[k:] for k in range(self.n)))).items())

    def count(self, found: list[bytes]) -> None:
        for path, times in self.paths(found):
            node = self.root
            for word in path:
                if word is None:
                    break
                node = node[word]
                node.amount += times

    def score(self, found: list[bytes]) -> int:
        total = 0
        for path, times in self.paths(found):
            node = self.root
            for word in path:
                if word is None:
                    break
                node = node[word]
                total += times * node.amount
        return total

    def pour(self, totals: np.ndarray) -> None:
        """Add the counts to the totals of their buckets, and give the trie up."""
        level = [self.root]
        while level:
            level = [child for node in level for child in node.values()]
            for node in level:
                totals[node.state % self.buckets] += node.amount
        self.clear()


def _count(n: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, totals = Trie(n, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in utf8(batch["text"]):
                trie.count(words(text))
                if trie.full:
                    trie.pour(totals)
        trie.pour(totals)
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(totals[some])], ["bucket", "n"])

    return run


def bucket_totals(texts: DataFrame, n: int, buckets: int, text_col: str = "text") -> list[int]:
    """How many features of all texts fall in each bucket: at most `buckets` rows reach the driver."""
    found = texts.select(F.col(text_col).alias("text")).mapInArrow(_count(n, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    totals = [0] * buckets
    for row in found:
        totals[row.bucket] = row.n
    return totals


def gains(source: list[int], target: list[int]) -> list[int]:
    """1000 times the logarithm of how much likelier each bucket is in the target, with one added to every bucket, rounded down."""
    b, s, t = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log(float(y + 1) * float(s + b) / (float(x + 1) * float(t + b)))) for x, y in zip(source, target, strict=True)]


def _score(n: int, found: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(n, len(found), found)
        for batch in batches:
            lengths, weights = [], []
            for text in utf8(batch["text"]):
                each = words(text)
                lengths.append(len(each))
                weights.append(trie.score(each))
                if trie.full:
                    trie.clear()
            columns = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(lengths, pa.int64()), pa.array(weights, pa.int64())], [*columns, "n_words", "weight"])

    return run


def noise(id_: Column, seed: str) -> Column:
    """Gumbel noise of an id, 1000 times and rounded down; the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank (from 1) where it is drawn, else null.

    Features are the runs of 1 to n words, repeats counted. Drawn are floor(percent / 100 of the rows with at least least_words
    words) of these rows, by falling score; ties go to the smaller id, then to fewer features, and equal rows follow one another in any order.
    A null text has no words; a null id has the noise of an empty one and comes last among ties. Repeated rows are rows of their own.
    An empty target makes rare buckets likelier; an empty table gives an empty result. Other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gain = gains(bucket_totals(rows, n, buckets), bucket_totals(target, n, buckets))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(_score(n, gain), f"doc_id {kind}, n_words long, weight long")
    features = sum((F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(1, n)), F.col("n_words"))
    scored = scored.withColumns({"n_features": features, "score": F.col("weight") + noise(F.col("doc_id"), seed), "row": F.monotonically_increasing_id()})
    scored = materialize(scored, "scores")  # row tells equal rows apart, so that they too are dealt to many tasks
    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")]
    ranked = numbered(scored.where(able), order, "ranks").withColumn("rank", F.when(F.col("position") < drawn, F.col("position") + 1))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).union(rest.select(*columns))
