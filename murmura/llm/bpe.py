"""Byte-level BPE: a streaming encoder with bounded lookahead, and an incremental decoder.

Merges happen in order of rank, so what follows a text can change its tokens only along a chain of merges of growing
rank, each of which takes up, as its right part, a token that begins where the last one's left part began. The longest
chain of the merge list is the sufficient lookahead: a token that ends that many bytes before the end of what has been
read is final. The encoder emits it and keeps only the bytes behind, however long the text.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, refuse, remembered, utf8

_S = r"[\t-\r \x85\xa0  -     　]"
_NOT = r"[^\t-\r \x85\xa0  -     　\p{L}\p{N}]"
#: Fixed value: the published rule that splits a text before its merges.
SPLIT = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?{_NOT}+|{_S}+(?!{_NOT}|\p{{L}}|\p{{N}})|{_S}+")
_RUNS = {"letter": regex.compile(r"\p{L}+"), "number": regex.compile(r"\p{N}+"), "other": regex.compile(rf"{_NOT}+"), "space": regex.compile(rf"{_S}+")}
_LAST_END = regex.compile(rf"{_S}(?!{_S})(?s:.)")  # in the text read backwards
#: Chunks and words that a worker remembers; characters fed at once.
_MEMORY, BLOCK = 400_000, 1 << 16


class Merges:
    """The vocabulary and merge list of a byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocab: dict[str, int] = made["model"]["vocab"]
        self.bytes_of = {i: bytes([byte_of[c] for c in t]) for t, i in vocab.items()}
        self.single = [0] * 256
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.single[b[0]] = i
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in made["model"]["merges"]]
        #: (left, right) to rank, and rank to result
        self.rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes before the end of a text whose tokens can still change: the longest chain of merges, each with as its right
        part a token whose leftmost parts include the left part of a merge before it in the chain and in rank."""
        left: dict[int, int] = {}
        reach: dict[int, int] = {}  # left part: longest chain that ends in a merge with it
        longest = 1
        for (a, b), made in zip(self.rank, self.made, strict=True):
            chain, part = 0, b
            while part is not None:
                chain, part = max(chain, reach.get(part, 0)), left.get(part)
            chain += len(self.bytes_of[a])
            reach[a] = max(reach.get(a, 0), chain)
            left.setdefault(made, a)
            longest = max(longest, chain)
        return longest

    def encode(self, text: bytes) -> list[int]:
        """Ids of one word: the pair of least rank, leftmost first, is merged until none is left."""
        ids = [self.single[b] for b in text]
        if len(ids) > 48:
            return self._encode_long(ids)
        get, none = self.rank.get, len(self.made)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i : i + 2] = [self.made[best]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.rank.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, _ = self.made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get((made, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, made, ids[k]))
            if (h := before[i]) >= 0 and (r := get((ids[h], made))) is not None:
                heapq.heappush(heap, (r, h, ids[h], made))
        return [x for x in ids if x >= 0]


class Word:
    """The transducer of one word: bytes in, final ids out, with at most twice `window` bytes kept."""

    def __init__(self, merges: Merges, window: int | None = None) -> None:
        self.merges, self.kept = merges, b""
        self.window = max(window or 4 * merges.lookahead, merges.lookahead + 1)

    def feed(self, more: bytes) -> list[int]:
        out: list[int] = []
        for i in range(0, len(more), self.window):
            self.kept += more[i : i + self.window]
            if len(self.kept) <= self.window:
                continue
            end, final = 0, len(self.kept) - self.merges.lookahead
            for token in self.merges.encode(self.kept):
                size = len(self.merges.bytes_of[token])
                if end + size > final:
                    break
                out.append(token)
                end += size
            self.kept = self.kept[end:]
        return out

    def finish(self) -> list[int]:
        ids, self.kept = self.merges.encode(self.kept), b""
        return ids


class Encoder:
    """Text in, packed little-endian 32-bit ids out, in pieces of any size; special tokens are ordinary text here."""

    def __init__(self, merges: Merges, window: int | None = None, block: int = BLOCK) -> None:
        self.merges, self.window, self.block = merges, window, block
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.text, self.open, self.run = "", None, ""

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            if len(word) >= 64:
                made = Word(self.merges, self.window)
                return self._pack(made.feed(word.encode()) + made.finish())
            if len(self.words) > _MEMORY:
                self.words.clear()
            self.words[word] = ids = self._pack(self.merges.encode(word.encode()))
        return ids

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a space and then what stands before the next one."""
        ids = b"".join([self._word(w) for w in SPLIT.findall(" " + chunk)])
        if len(chunk) < 64:
            if len(self.chunks) > _MEMORY:
                self.chunks.clear()
            self.chunks[chunk] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        """Ids of a text that ends where a word ends: no word has a single space but at its start."""
        if "  " in text or len(text) < 2:
            return b"".join([self._word(w) for w in SPLIT.findall(text)])
        first, *rest = text.split(" ")
        get, chunk = self.chunks.get, self._chunk
        return b"".join([*[self._word(w) for w in SPLIT.findall(first)], *[get(w) or chunk(w) for w in rest]])

    def feed(self, more: str) -> bytes:
        """Final ids of what has been read. Kept: what follows the last end of a word before white space, and of a word that
        is longer than a block, what its transducer keeps."""
        out = []
        if self.open:
            more, self.text = self.text + more, ""
            m = _RUNS[self.run].match(more)
            end = m.end() if m else 0
            last = 1 if self.run == "space" and end else 0  # the last white space may belong to the next word
            out.append(self._pack(self.open.feed(more[: end - last].encode())))
            if end >= len(more):
                self.text = more[end - last :]
                return b"".join(out)
            out.append(self._pack(self.open.finish()))
            self.open, more = None, more[end - last :]
        self.text += more
        if len(self.text) < self.block:
            return b"".join(out)
        for m in _LAST_END.finditer(self.text[::-1]):
            cut = len(self.text) - m.end() + 1
            out.append(self._whole(self.text[:cut]))
            self.text = self.text[cut:]
            break
        if len(self.text) >= self.block:  # white space, if any, and then none: what ends four characters before is final
            for m in SPLIT.finditer(self.text):
                if m.end() > len(self.text) - 4:
                    break
                out.append(self._word(m[0]))
            self.text = self.text[m.start() :]
            word = m[0]
            if len(word) >= self.block:
                self.run = next(k for k, p in _RUNS.items() if p.match(word[1] if word[0] == " " and len(word) > 1 else word[0]))
                end = len(word) - (self.run == "space")
                self.open = Word(self.merges, self.window)
                out.append(self._pack(self.open.feed(word[:end].encode())))
                self.text = self.text[end:]
                if len(self.text) > (self.run == "space"):  # up to three characters follow
                    rest, self.text = self.text, ""
                    out.append(self.feed(rest))
        return b"".join(out)

    def finish(self) -> bytes:
        out = b""
        if self.open:
            if self.run == "space":
                out = self._pack(self.open.feed(self.text.encode()))
                self.text = ""
            out += self._pack(self.open.finish())
            self.open = None
        out += self._whole(self.text) if self.text else b""
        self.text = ""
        return out

    def encode(self, text: str) -> bytes:
        if len(text) <= self.block:
            return self._whole(text) if text else b""
        return b"".join([*[self.feed(text[i : i + self.block]) for i in range(0, len(text), self.block)], self.finish()])


class Decoder:
    """Ids in, text out; bytes of a cut code point wait for the rest, and what is no UTF-8 becomes U+FFFD."""

    def __init__(self, merges: Merges) -> None:
        self.bytes_of = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        of = self.bytes_of
        return self.state.decode(b"".join([of[i] for i in ids]))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(2)
def merges_of(path: str) -> Merges:
    return Merges(path)


def _encoder(path: str) -> Encoder:
    return remembered(f"bpe {path}", lambda: Encoder(merges_of(path)))


def encode_text(path: str, text: str) -> bytes:
    """Packed ids of a text; special tokens in it become their ids, as the tokenizers library does by default."""
    encoder, special = _encoder(path), merges_of(path).special
    if not any(s in text for s in special):
        return encoder.encode(text)
    out = []
    for part in re.split("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")", text):
        out.append(Encoder._pack([special[part]]) if part in special else encoder.encode(part))
    return b"".join(out)


def _encode(path: str, text_col: str, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode_text(path, (t or b"").decode()) for t in utf8(batch[text_col])]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(ids, pa.binary())], [*keep, "ids"])

    return run


def decode_ids(path: str, ids: bytes | None, block: int = BLOCK) -> str:
    decoder = Decoder(merges_of(path))
    values = np.frombuffer(ids or b"", "<u4")
    return "".join([*[decoder.feed(values[i : i + block].tolist()) for i in range(0, len(values), block)], decoder.finish()])


def _decode(path: str, ids_col: str, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(path, x) for x in batch[ids_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(texts, pa.string())], [*keep, "decoded"])

    return run


def _fields(df: DataFrame, names: tuple[str, ...]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, ids) of each row of docs, ids being packed little-endian unsigned 32-bit integers; a null text is empty.

    tokenizer_path is a byte-level BPE file of the tokenizers library, local on every machine. Repeated rows come out as often as they
    came in; an empty table gives an empty result. keep must not name ids.
    """
    prepare(docs.sparkSession)
    refuse(keep, ["ids"])
    return docs.select(*dict.fromkeys((*keep, text_col))).mapInArrow(_encode(tokenizer_path, text_col, keep), _fields(docs, keep) + "ids binary")


def decode(rows: DataFrame, tokenizer_path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, decoded) of each row of rows, from packed ids; null ids are empty. An id outside the vocabulary is an error.

    Repeated rows come out as often as they came in; an empty table gives an empty result. keep must not name decoded.
    """
    prepare(rows.sparkSession)
    refuse(keep, ["decoded"])
    return rows.select(*dict.fromkeys((*keep, ids_col))).mapInArrow(_decode(tokenizer_path, ids_col, keep), _fields(rows, keep) + "decoded string")
