"""Repeated passages: seeds on winnowed anchors, extended to maximal repeats over a length threshold.

A window is `span` consecutive words. Its anchor is the rightmost least hash of the k-word grams in it, so equal windows
have the same anchor at the same place (winnowing with span - k + 1 grams). The windows of one anchor in a document are
neighbours and form a block, the furthest an anchor can be extended both ways.

1. One pass emits each anchor with its block's hash: about two rows for each span - k + 1 words.
2. Documents are joined on anchors. Blocks that occur twice under one anchor are repeats as a whole, extended to both ends.
   Counts are combined before they are shuffled, so a passage that a third of the documents share costs one row a task.
3. An anchor with several blocks is extended word by word: of each block one document brings the words on either side, all
   blocks of the anchor are aligned at it, and each way's extensions are named by their length and words. What two blocks
   share over at least `span` words is kept as maximal ranges. No pairs are formed.
4. An anchor with over HOT blocks is not held by one task: its blocks list their windows, which are counted by a shuffle.
5. Covered words are removed from the documents.

Blocks and windows are named by two 64-bit hashes, of the anchor and of the whole, or of both extensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, prepare, utf8
from .words import _P, Spans, mix, windows, word_hashes

#: Words in a gram: short enough for a long winnowing window, long enough to be rare.
GRAM = 8
#: Most blocks of an anchor that one task extends, and about how many it extends at a time.
HOT, TOGETHER = 4_096, 16_384
#: Bits of a block's shape that hold its number of windows; the rest is where its anchor stands after its first word.
_BITS = 16

_spans = Spans()


def blocks(h: np.ndarray, span: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's place, first window, number of windows) of each anchor of a text with word hashes h."""
    grams, width = mix(windows(h, gram)), span - gram + 1
    value, place = grams, np.arange(len(grams))
    size = 1
    while size < width:
        step = min(size, width - size)
        right = value[step:] <= value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.minimum(value[step:], value[:-step])
        size += step
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[first], first, np.diff(np.concatenate([first, [len(place)]]))


def _words(text: bytes | None) -> np.ndarray:
    return word_hashes((text or b"").split())


def _described(text: bytes | None, span: int) -> tuple[np.ndarray, ...] | None:
    """(anchors, block hashes, first windows, shapes) of a text; None if it is shorter than a window."""
    h = _words(text)
    if len(h) < span:
        return None
    place, first, n = blocks(h, span)
    shape = n | (place - first) << _BITS
    return mix(_spans.of(h, place, place + GRAM)).view(np.int64), _spans.of(h, first, first + n - 1 + span).view(np.int64), first.astype(np.int32), shape.astype(np.int32)


def _anchors(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for key, text in zip(batch["doc_key"].to_numpy(), utf8(batch["text"]), strict=True):
                if (own := _described(text, span)) is not None:
                    found.append(own)
                    keys.append(np.full(len(own[0]), key, np.int64))
            if keys:
                anchor, block, start, shape = (pa.array(np.concatenate(x)) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([anchor, block, pa.array(np.concatenate(keys)), start, shape], ["anchor", "block", "doc_key", "start", "shape"])

    return run


def _contexts(span: int):
    """Of each open block its words (hashes), or under a hot anchor the hashes of its windows, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, windows_of = [], []
            for key, text, ranges in zip(batch["doc_key"].to_pylist(), utf8(batch["text"]), batch["ranges"].to_pylist(), strict=True):
                h = _words(text)
                all_windows = mix(windows(h, span)).view(np.int64) if any(r["hot"] for r in ranges) else None
                for r in ranges:
                    start, n = r["start"], r["shape"] & (1 << _BITS) - 1
                    if r["hot"]:
                        windows_of += [(r["anchor"], key, start + i, 1, r["repeats"], None, int(w)) for i, w in enumerate(all_windows[start : start + n])]
                    else:
                        words.append((r["anchor"], key, start, r["shape"], r["repeats"], h[start : start + n - 1 + span].tobytes(), None))
            rows = [*words, *windows_of]
            columns = [[r[i] for r in rows] for i in range(7)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "doc_key", "start", "shape", "repeats", "words", "hash"])

    return run


def extended(anchor: np.ndarray, shape: np.ndarray, words: list[np.ndarray], span: int) -> np.ndarray:
    """Of blocks (rows), whether their windows with 0, 1, ... words before the anchor are shared with another block of the
    anchor: blocks are aligned at their anchors, and each way is extended word by word."""
    most = span - GRAM
    n, at = shape & (1 << _BITS) - 1, shape >> _BITS
    left, right = np.zeros((len(words), most), np.uint64), np.zeros((len(words), most), np.uint64)
    for i, (w, a) in enumerate(zip(words, at.tolist(), strict=True)):
        left[i, :a] = w[:a][::-1]
        after = w[a + GRAM :][:most]
        right[i, : len(after)] = after

    def extensions(side: np.ndarray) -> np.ndarray:
        out = np.ones((len(side), most + 1), np.uint64)
        for k in range(most):
            out[:, k + 1] = mix(out[:, k] * _P + side[:, k])
        return out

    before, after = extensions(left), extensions(right)
    shared = np.zeros((len(words), most + 1), bool)
    for o in range(most + 1):
        rows = np.flatnonzero((at - n < o) & (o <= at))
        if len(rows) < 2:
            continue
        keys = (after[rows, most - o], before[rows, o], anchor[rows])
        order = np.lexsort(keys)
        same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
        shared[rows[order[1:][same]], o] = True
        shared[rows[order[:-1][same]], o] = True
    return shared


def _extend(span: int):
    """Rows sorted by anchor: maximal ranges of windows that another block of the anchor shares, of blocks that are no repeats
    as a whole."""

    def ranges(rows: pa.Table) -> pa.RecordBatch:
        start, shape = rows["start"].to_numpy().astype(np.int64), rows["shape"].to_numpy().astype(np.int64)
        words = [np.frombuffer(w, np.uint64) for w in rows["words"].to_pylist()]
        shared = extended(rows["anchor"].to_numpy(), shape, words, span)
        shared[rows["repeats"].to_numpy(zero_copy_only=False)] = False
        edges = np.diff(np.pad(shared.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (row, first), (_, last) = np.nonzero(edges == 1), np.nonzero(edges == -1)
        begin = start[row] + (shape >> _BITS)[row] - (last - 1)  # the window with the most words before the anchor comes first
        return pa.RecordBatch.from_arrays([pa.array(rows["doc_key"].to_numpy()[row]), pa.array(begin.astype(np.int32)), pa.array((last - first).astype(np.int32))], ["doc_key", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            waiting.append(batch)
            n += len(batch)
            if n >= TOGETHER:  # anchors that are whole
                rows = pa.Table.from_batches(waiting)
                anchor = rows["anchor"].to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))
                if cut:
                    yield ranges(rows.slice(0, cut))
                waiting, n = rows.slice(cut).to_batches(), len(rows) - cut
        if n:
            yield ranges(pa.Table.from_batches(waiting))

    return run


def _remove(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, ranges in zip(utf8(batch["text"]), batch["ranges"].to_pylist(), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                if not ranges:
                    n_removed.append(0)
                    kept.append(b" ".join(words))
                    continue
                packed = np.array(ranges, np.int64)
                start, n = packed >> 32, packed & 0xFFFFFFFF
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, start, 1)
                np.add.at(edges, start + n - 1 + span, -1)
                stays = np.cumsum(edges[:-1]) == 0
                n_removed.append(len(words) - int(stays.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stays)]))
            names = [c for c in batch.schema.names if c not in ("text", "ranges")]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*names, "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 35, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, n_words, n_removed, kept) of each row of docs, kept being the words left, joined by one space.

    A word goes if a window of `span` words that covers it starts anywhere else in docs, in the same row or another;
    windows are judged on the input. Texts with fewer words, empty and null texts (no words) lose nothing. Rows are told
    apart by id and text: repeated rows are occurrences of their own, and a null id is an id like others. keep names
    columns that are passed on; one that is called like a column made here is an error before any job. An empty table gives an
    empty result.
    """
    if not GRAM < span < 1 << _BITS - 1:
        raise ValueError(f"span must be over {GRAM} and under {1 << _BITS - 1}")
    if clashes := {"doc_id", "text", "ranges", "doc_key", "n_words", "n_removed", "kept"} & set(keep):
        raise ValueError(f"keep names columns that are made here: {sorted(clashes)}")
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text")).withColumn("doc_key", F.xxhash64("doc_id", "text"))
    anchors = materialize(docs.select("doc_key", "text").mapInArrow(_anchors(span), "anchor long, block long, doc_key long, start int, shape int"), "anchors")

    found = materialize(anchors.groupBy("anchor", "block").agg((F.count("*") > 1).alias("repeats")), "found")
    several = found.groupBy("anchor").agg(F.count("*").alias("blocks")).where("blocks > 1")
    met = found.join(several, "anchor", "left").where("repeats or blocks is not null").select("anchor", "block", "repeats", F.col("blocks").isNotNull().alias("open"), (F.coalesce("blocks", F.lit(0)) > HOT).alias("hot"))
    met = materialize(anchors.join(met.hint("shuffle_merge"), ["anchor", "block"]), "met")

    whole = met.where("repeats").select("doc_key", "start", F.expr(f"shape & {(1 << _BITS) - 1}").alias("n"))
    one = met.where("open").groupBy("anchor", "block").agg(F.min(F.struct("doc_key", "start", "shape")).alias("one"), F.first("repeats").alias("repeats"), F.first("hot").alias("hot"))
    open_ = materialize(one.groupBy("one.doc_key").agg(F.collect_list(F.struct("anchor", "one.start", "one.shape", "repeats", "hot")).alias("ranges")), "open")
    # a text that stands in several rows is opened once for each row, with the same words
    opened = docs.select("doc_key", "text").join(open_.hint("shuffle_merge"), "doc_key").mapInArrow(_contexts(span), "anchor long, doc_key long, start int, shape int, repeats boolean, words binary, hash long")
    opened = materialize(opened.dropDuplicates(["anchor", "doc_key", "start"]), "opened")
    parts = opened.where("words is not null").select("anchor", "doc_key", "start", "shape", "repeats", "words").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_extend(span), "doc_key long, start int, n int")
    hot = opened.where("hash is not null")
    twice = hot.groupBy("anchor", "hash").agg(F.count("*").alias("c")).where("c > 1").select("anchor", "hash")
    listed = hot.where("not repeats").join(twice, ["anchor", "hash"]).select("doc_key", "start", F.lit(1).alias("n"))

    packed = whole.union(parts).union(listed).select("doc_key", F.expr("shiftleft(cast(start as bigint), 32) + n").alias("r"))
    ranges = packed.groupBy("doc_key").agg(F.collect_set("r").alias("ranges"))
    joined = docs.join(ranges, "doc_key", "left").select("doc_id", *keep, "text", "ranges")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("text", "ranges"))
    return joined.mapInArrow(_remove(span), f"{kept}, n_words long, n_removed long, kept string")
