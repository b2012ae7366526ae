"""Packing token sequences into as few fixed-size bins as possible: dominance reduction, then best fit.

Only lengths matter, so the plan is made on the histogram of lengths (at most `capacity` rows) and its size is bounded by
the capacity, not by the corpus: every step places all the copies of a set of lengths that it can. Pieces then find
their place by their rank among the pieces of the same length, which is counted in parts.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize, prepare, refuse, remembered, utf8

#: Pieces of one length that are ranked in one group, on average.
RANKED = 50_000
#: Chunks between white space that a worker remembers.
_MEMORY = 400_000

Pattern = tuple[tuple[int, int], ...]


def reduce_dominated(counts: Counter, capacity: int) -> list[tuple[Pattern, int]]:
    """Fix sets of lengths that dominate all other sets with the same length, after Martello and Toth; counts shrinks.

    For a length j with r = capacity - j left: j alone if nothing else fits; with k, the largest that fits, if k fills r
    or no two others fit; with k and b if no three others fit and every pair that fits is dominated by (k, b), or by k.
    """
    fixed: list[tuple[Pattern, int]] = []
    lengths = sorted(x for x in counts if counts[x])

    def smallest(above: int, n: int, without: int) -> list[int]:
        out: list[int] = []
        for x in lengths[bisect.bisect_right(lengths, above) :]:
            out += [x] * min(n - len(out), counts[x] - (x == without))
            if len(out) == n:
                break
        return out

    def largest(most: int, used: Counter) -> int:
        for x in reversed(lengths[: bisect.bisect_right(lengths, most)]):
            if counts[x] > used[x]:
                return x
        return 0

    def fix(*chosen: int) -> None:
        n = Counter(chosen)
        times = min(counts[x] // k for x, k in n.items())
        fixed.append((tuple(sorted(n.items(), reverse=True)), times))
        for x, k in n.items():
            counts[x] -= k * times
            if not counts[x]:
                lengths.remove(x)

    changed = True
    while changed:
        changed = False
        for j in sorted(lengths, reverse=True):
            while counts[j]:
                r, low = capacity - j, smallest(0, 3, j)
                k = largest(r, Counter([j]))
                if not k:
                    fix(j)
                elif k == r or len(low) < 2 or low[0] + low[1] > r:
                    fix(j, k)
                elif len(low) < 3 or sum(low) > r:
                    b = largest(r - k, Counter([j, k]))
                    pairs = smallest(b, 2, j)
                    if b and not (len(pairs) == 2 and sum(pairs) <= r):
                        fix(j, k, b)
                    elif not b and not (len(pairs) == 2 and sum(pairs) <= r):
                        fix(j, k)
                    else:
                        break
                else:
                    break
                changed = True
    return fixed


def best_fit(counts: Counter, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing, all copies of a length at once: each goes to the fullest bin that it fits."""
    left: dict[int, list[list]] = {}  # room left: [pattern, bins]
    rooms: list[int] = []

    def put(pattern: Pattern, room: int, n: int) -> None:
        if n:
            if room not in left:
                left[room] = []
                bisect.insort(rooms, room)
            left[room].append([pattern, n])

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            i = bisect.bisect_left(rooms, length)
            old = i < len(rooms)
            room, pattern, bins = capacity, (), todo
            if old:
                room = rooms[i]
                pattern, bins = left[room].pop()
                if not left[room]:
                    del left[room], rooms[i]
            each = room // length
            full = min(bins, todo // each)
            put((*pattern, (length, each)), room - each * length, full)
            todo -= full * each
            rest = bins - full
            if todo and rest:
                put((*pattern, (length, todo)), room - todo * length, 1)
                todo, rest = 0, rest - 1
            if old:
                put(pattern, room, rest)
    return [(p, n) for room in rooms for p, n in left[room]]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Bins as (((length, copies), ...), number of such bins) for so many pieces of each length."""
    if any(x > capacity or x < 1 for x in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    left = Counter({int(k): int(n) for k, n in counts.items()})
    return reduce_dominated(left, capacity) + best_fit(Counter({k: n for k, n in left.items() if n}), capacity)


def _segments(bins: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Where ranks of each length go: sorted by (length, first rank)."""
    rows, taken, sequence = [], Counter(), 0
    for pattern, n in bins:
        offset = 0
        for length, each in pattern:
            rows.append((length, taken[length], each, sequence, offset))
            taken[length] += each * n
            offset += length * each
        sequence += n
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "each", "sequence", "offset"), columns, strict=True))


def _place(segments):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = segments.value
        key = (s["length"] << 44) + s["first"]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            i = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            bin_, nth = np.divmod(rank - s["first"][i], s["each"][i])
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(s["sequence"][i] + bin_), pa.array(s["offset"][i] + nth * length)], [*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (length long, other columns) with sequence_id long and offset long: sequences of at most `capacity`.

    Every row gets a place; equal rows are places of their own. Lengths must be 1 to capacity. pieces should be a table or
    a checkpoint: it is read three times. Its columns must not be called rank, salt, first_rank, sequence_id or offset.
    An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    refuse(pieces.columns, ["rank", "salt", "first_rank", "sequence_id", "offset"])
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    segments = spark.sparkContext.broadcast(_segments(plan(counts, capacity)))
    salts = max(1, -(-max(counts.values(), default=0) // RANKED))
    order = [F.col(c) for c in pieces.columns if c != "length"]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = salted.groupBy("length", "salt").count()
    before = before.withColumn("first_rank", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("first_rank")).select(*pieces.columns, "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(_place(segments), f"{schema}, sequence_id long, offset long")


#: Letters for which case and composed form are plain, beside printable ASCII.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
#: What the vocabulary's rules take as one word, for such texts in lower case.
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")


class Chunks(dict):
    """Chunk between white space (UTF-8) to its ids as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins across it, so a text's ids are its chunks' ids in order. Words of
    plain letters go to the tokenizer's model at once; any other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            if len(self.words) > _MEMORY:
                self.words.clear()
            found = self.model.tokenize(word if word.isascii() else "".join([self.letters[b] for b in word.encode()]))
            self.words[word] = ids = b"".join([self.packed[t.id] for t in found])
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if _PLAIN.fullmatch(text) and not ("<" in text and any(s in text for s in self.special)):
            ids = b"".join([self.word(w) for w in _WORD.findall(text.lower())])
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[chunk] = ids
        return ids

    def of(self, text: bytes) -> bytes:
        if len(self) > _MEMORY:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


def _chunks(path: str) -> Chunks:
    return remembered(f"packing {path}", lambda: Chunks(path))


def _tokenize(path: str, capacity: int, end: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunks(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), utf8(batch["text"]), strict=True):
                ids = memoryview(chunks.of(text or b"") + tail)
                for i in range(0, len(ids), 4 * capacity):
                    part = ids[i : i + 4 * capacity]
                    rows.append((doc_id, i // (4 * capacity), i // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of docs.

    A document's ids are its text's (null: empty) with `end` after them; only a document of over `capacity` ids is cut.
    A null id stays null; repeated rows are documents of their own; an empty table gives an empty result. tokenizer_path is a local file on every machine.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = docs.mapInArrow(_tokenize(tokenizer_path, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long")
    return pack(materialize(pieces, "pieces"), capacity)
