"""Language identification of mixed text: script ranges, word scores, and Viterbi with a switching penalty.

Each word's script leaves only the languages seen in that script; among these, character grams score the word. The
best path through a text's words, which pays a penalty for each change of language, labels its spans.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, refuse, remembered, utf8

#: Hash buckets of character grams.
BUCKETS = 1 << 15  # the 15 highest bits of a hash
#: A language is a candidate for a script that has this share of its letters.
SCRIPT_SHARE = 0.01
#: Rows of each language that are learned from at least, if it has them; and the steps of a language's share of rows.
LEAST_DOCS, _FINE = 20, 1_000_000_000_000
#: Words that a worker remembers.
_MEMORY = 400_000

# The first code point of blocks of letters and the script from there on.
_RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"),
    (0xA6A0, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
)
_FIRST = [x for x, _ in _RANGES]
SCRIPTS = sorted({x for _, x in _RANGES})


@lru_cache(1)
def _letters() -> np.ndarray:
    """Of each code point: the index of its script in SCRIPTS, or -1 if it is no letter."""
    points = np.arange(0x110000)
    kinds = np.array([SCRIPTS.index(x) for _, x in _RANGES], np.int8)[np.searchsorted(_FIRST, points, side="right") - 1]
    kinds[[not chr(i).isalpha() for i in points]] = -1
    return kinds


def script_of(letter: str) -> int:
    """The index in SCRIPTS of a letter's script, -1 for what is no letter."""
    return int(_letters()[ord(letter)])


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, script or -1) of each word, and (word, bucket) of each gram of two or three letters or edges, in lower case.

    What isn't a letter is left out. Words must not have white space within.
    """
    points = np.frombuffer((b" " + b" ".join(words) + b" ").decode().lower().encode("utf-32-le"), np.uint32)
    kinds = _letters()[points]
    edge = points == 32
    points, kinds = points[edge | (kinds >= 0)], kinds[edge | (kinds >= 0)]
    edge = points == 32
    word = np.cumsum(edge) - 1
    inner = np.flatnonzero(~edge)
    letters = np.bincount(word[inner], minlength=len(words))[: len(words)]
    by_script = np.bincount(word[inner] * len(SCRIPTS) + kinds[inner], minlength=len(words) * len(SCRIPTS)).reshape(-1, len(SCRIPTS))
    x = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    two = np.flatnonzero(~(edge[1:] & edge[:-1])) + 1
    pair = x[two - 1] * np.uint64(0xC4CEB9FE1A85EC53) + (x[two] ^ (x[two] >> np.uint64(29)))
    three = x[inner - 1] * np.uint64(0xFF51AFD7ED558CCD) + (x[inner] ^ (x[inner] >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + (x[inner + 1] ^ (x[inner + 1] >> np.uint64(27)))
    hashed = np.concatenate([pair, three])
    hashed = (hashed ^ (hashed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return letters, np.where(letters > 0, by_script.argmax(1), -1), np.concatenate([word[two - 1], word[inner]]), (hashed >> np.uint64(49)).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # by language: log probability of each bucket
    allowed: np.ndarray  # whether a language uses a script
    prior: int  # the language seen most
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(batch["lang"].to_pylist(), utf8(batch["text"]), strict=True):
            words.setdefault(lang, Counter()).update(text.split())
        for lang, chunks in words.items():
            own = counts.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS)))
            times = np.fromiter(chunks.values(), np.float64, len(chunks))
            letters, kinds, word, buckets = word_features(list(chunks))
            own[:BUCKETS] += np.bincount(buckets, times[word], BUCKETS)
            own[BUCKETS:] += np.bincount(np.maximum(kinds, 0), letters * times, len(SCRIPTS))
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([x.tobytes() for x in counts.values()], pa.binary())], ["lang", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, counts in zip(batch["lang"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            sums[lang] = sums.get(lang, 0) + np.frombuffer(counts)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["lang", "counts"])


def sample_shares(counts: dict[str, int], sample_docs: int) -> dict[str, float]:
    """The share of each language's rows to learn from: the same number of each, or all, so that about sample_docs are taken."""
    left, each = sample_docs, 0.0
    for i, n in enumerate(rising := sorted(counts.values())):
        each = max(left / (len(rising) - i), LEAST_DOCS)
        if n > each:
            break
        left -= n
    return {k: min(1.0, each / n) for k, n in counts.items()} if rising and rising[-1] > each else dict.fromkeys(counts, 1.0)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = 4_000) -> Model:
    """A model of the languages in lang_col, from about sample_docs rows of docs (all if there are fewer), chosen by a hash of the id.

    The sample is taken by language: all rows of a rare one, equal numbers of the others, and no fewer than LEAST_DOCS (so
    more than sample_docs in all if there are very many languages). The language seen most is that of all rows, not of the
    sample. Rows with a null text or language teach nothing. What the driver receives is one array of fixed size for each language.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    shares = sample_shares({r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}, sample_docs)
    if min(shares.values(), default=1.0) < 1.0:
        most = docs.sparkSession.createDataFrame([(k, int(v * _FINE) or 1) for k, v in shares.items()], "own_lang string, most long")
        rows = rows.join(F.broadcast(most), F.col("lang") == F.col("own_lang")).where(F.pmod(F.xxhash64("doc_id"), F.lit(_FINE)) < F.col("most"))
    schema = "lang string, counts binary"
    parts = rows.select("lang", "text").mapInArrow(_count, schema)
    found = sorted((r.lang, np.frombuffer(r.counts)) for r in parts.repartition(16).mapInArrow(_add, schema).repartition(1).mapInArrow(_add, schema).collect())
    langs = [k for k, _ in found]
    if not langs:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros((len(SCRIPTS), 0), bool), 0)
    grams = np.array([x[:BUCKETS] for _, x in found])
    letters = np.array([x[BUCKETS:] for _, x in found])
    weights = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS))
    return Model(langs, weights.astype(np.float32), (letters >= SCRIPT_SHARE * np.maximum(letters.sum(1, keepdims=True), 1)).T, int((letters.sum(1) / [shares[k] for k in langs]).argmax()))


class Scores(dict):
    """Word to its row in arrays of scores, letters and whether it has a candidate; new words are filled in by of()."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.new: list[bytes] = []
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.scores = np.zeros((0, len(self.model.langs)), np.float32)
        self.letters, self.known = np.zeros(0, np.int32), np.zeros(0, bool)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def of(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Rows of the words of each text."""
        if len(self) > _MEMORY:
            self.forget()
        rows = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in ((t or b"").split() for t in texts)]
        if self.new:
            letters, kinds, word, buckets = word_features(self.new)
            can = self.model.allowed[np.maximum(kinds, 0)] & (kinds >= 0)[:, None]
            scores = np.stack([np.bincount(word, w[buckets], len(self.new)) for w in self.model.weights], 1) if self.model.langs else np.zeros((len(self.new), 0))
            scores = np.where(can, scores / 2, -np.inf)  # halved, as grams overlap
            known = can.any(1)
            scores = np.where(known[:, None], np.maximum(scores - scores.max(1, initial=-1e9, keepdims=True), -30), 0)
            have = len(self.letters)
            grow = max(0, len(self) - have)
            room = max(grow, have // 2 + 1024) if grow else 0
            if room:
                self.scores, self.letters, self.known = (np.concatenate([x, np.zeros((room, *x.shape[1:]), x.dtype)]) for x in (self.scores, self.letters, self.known))
            at = slice(len(self) - len(self.new), len(self))
            self.scores[at], self.letters[at], self.known[at] = scores, letters, known
            self.new = []
        return rows


def _scorer(model: Model) -> Scores:
    return remembered(f"language {model.name}", lambda: Scores(model))


def constant(scores: np.ndarray, penalty: float) -> int | None:
    """The language of the best path if no stretch of any other gains half the penalty, so that no change can pay; else None."""
    sums = np.cumsum(scores, 0, dtype=np.float64)
    best = int(sums[-1].argmax())
    gain = sums - sums[:, best : best + 1]
    low = np.minimum.accumulate(np.concatenate([np.zeros((1, gain.shape[1])), gain[:-1]]), 0)
    return best if (gain - low).max() <= penalty / 2 else None


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best path: word scores added up, less penalty for each change."""
    value = [0.0] * scores.shape[1]
    steps = []
    for row in scores.tolist():
        top = max(value)
        least = top - penalty
        steps.append((value, least, top))
        value = [(v if v >= least else least) + s for v, s in zip(value, row, strict=True)]
    label = value.index(max(value))
    labels = np.empty(len(scores), np.int64)
    for t in range(len(scores) - 1, -1, -1):
        labels[t] = label
        value, least, top = steps[t]
        if value[label] < least:
            label = value.index(top)
    return labels


def _predict(model, text_col: str, keep: tuple[str, ...], penalty: float, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _scorer(model.value)
        for batch in batches:
            columns, names = predict_texts(utf8(batch[text_col]), own, penalty, with_spans)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *columns], [*keep, *names])

    return run


def predict_texts(texts: list[bytes | None], own: Scores, penalty: float, with_spans: bool) -> tuple[list[pa.Array], list[str]]:
    langs = own.model.langs
    preds, shares, spans = [], [], []
    for rows in own.of(texts):
        letters, known, scores = own.letters[rows], own.known[rows], own.scores[rows]
        path: np.ndarray | int | None = None
        if known.any():
            if (path := constant(scores, penalty)) is None:
                path = viterbi(scores, penalty)
        elif letters.any() and langs:
            path = own.model.prior
        if path is None:
            preds.append("und")
            shares.append(0.0)
            spans.append([])
            continue
        labels = np.full(len(letters), path) if isinstance(path, int) else path
        sums = np.bincount(labels, letters * known, len(langs))
        best = int(sums.argmax()) if sums.any() else path
        preds.append(langs[best])
        shares.append(float(sums[best] / letters.sum()))
        edges = np.flatnonzero(np.diff(labels)) + 1
        spans.append([{"lang": langs[labels[a]], "start": int(a), "end": int(b)} for a, b in zip([0, *edges], [*edges, len(labels)], strict=True)] if with_spans else None)
    out = [pa.array(preds, pa.string()), pa.array(shares, pa.float64())]
    if with_spans:
        out.append(pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))))
    return out, ["lang_pred", "score", *["spans"] * with_spans]


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), penalty: float = 16.0, with_spans: bool = False) -> DataFrame:
    """(*keep, lang_pred, score[, spans]) of each row of docs; spans are stretches of words, from start to before end.

    lang_pred has most letters of the best path; score is its share of the letters, 0 to 1. A text that is null, empty or
    without a letter, or any text under a model that learned nothing, is `und` with score 0; letters of scripts that no
    language uses count against the score, and a text of such letters only gets the most seen language with score 0. Of
    equal paths and equal shares the first language by name counts. Repeated rows come out as often as they came in; an empty table
    gives an empty result. keep must not name the new columns; others of docs are not read.
    """
    prepare(docs.sparkSession)
    refuse(keep, ["lang_pred", "score", "spans"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*dict.fromkeys((*keep, text_col)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInArrow(_predict(shared, text_col, keep, penalty, with_spans), f"{schema}, lang_pred string, score double" + ", spans array<struct<lang: string, start: bigint, end: bigint>>" * with_spans)
