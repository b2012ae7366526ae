"""Token counts by greedy longest match, in linear time and without building the pieces.

The vocabulary's trie has a failure link at each node: where matching goes on once the longest pieces of what has been read
are popped, and how many these are. A word is read once, each byte moves ahead or pops.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import prepare, refuse, remembered, utf8

_MEMORY = 1_000_000


class Automaton:
    """Pieces that begin a word, and pieces that go on with one."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]) -> None:
        #: node * 256 + byte to node; nodes 0 and 1 are the roots of both kinds
        self.next: dict[int, int] = {}
        ends: set[int] = set()
        count = 2
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                node = root
                for b in piece:
                    key = node << 8 | b
                    if key not in self.next:
                        self.next[key] = count
                        count += 1
                    node = self.next[key]
                if piece:
                    ends.add(node)
        self.link, self.pops = [-1] * count, [0] * count
        children: list[list[tuple[int, int]]] = [[] for _ in range(count)]
        for key, node in self.next.items():
            children[key >> 8].append((key & 255, node))
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for b, node in children[parent]:
                if node in ends:
                    self.link[node], self.pops[node] = 1, 1
                else:
                    at, pops = self.link[parent], self.pops[parent]
                    while at >= 0 and (at << 8 | b) not in self.next:
                        pops += self.pops[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[node], self.pops[node] = self.next[at << 8 | b], pops
                queue.append(node)

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 if some part of it is in no piece."""
        node, n = 0, 0
        step, link, pops = self.next.get, self.link, self.pops
        for b in word:
            while (to := step(node << 8 | b)) is None:
                n += pops[node]
                node = link[node]
                if node < 0:
                    return 0
            node = to
        while node > 1:
            n += pops[node]
            node = link[node]
        return n if node == 1 else 0


@lru_cache(2)
def byte_level(path: str) -> Automaton:
    """From a file of base64 pieces and ranks: pieces with a leading space begin a word, the others go on."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return Automaton([p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "])


class Counts(dict):
    """Word to its number of pieces; words that can't be built count as one unknown piece."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.automaton.count(b" " + word) or 1
        return n

    def of(self, text: bytes) -> tuple[int, int]:
        if len(self) > _MEMORY:
            self.clear()
        words = text.split()
        return len(words), sum(map(self.__getitem__, words))


def _counts(path: str) -> Counts:
    return remembered(f"token counts {path}", lambda: Counts(byte_level(path)))


def _count(path: str, text_col: str, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(path)
        for batch in batches:
            found = [counts.of(t or b"") for t in utf8(batch[text_col])]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *(pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))], [*keep, "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, n_words, n_tokens) of each row of docs: its words at ASCII white space, and the pieces of a space and each word.

    Pieces are matched greedily, longest first, within a word. Null and empty texts have none; a word that the vocabulary
    can't build counts as one piece. vocabulary_path is local on every machine. Texts are read whole, however
    long. Repeated rows come out as often as they came in; an empty table gives an empty result. keep must not name the new columns.
    """
    prepare(docs.sparkSession)
    refuse(keep, ["n_words", "n_tokens"])
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*dict.fromkeys((*keep, text_col))).mapInArrow(_count(vocabulary_path, text_col, keep), fields + "n_words long, n_tokens long")
