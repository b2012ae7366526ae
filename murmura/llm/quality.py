"""Quality rules by line labels: a linear-chain conditional random field marks lines as content or boilerplate.

Base counts reject texts at once; of the others, Viterbi decoding labels the lines and the share of words in content
lines decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, refuse, utf8
from .words import mix, windows, word_hashes

#: Bytes that a word can't have, symbols, and all bytes but a code point's first.
_SPACE, _SYMBOLS, _INNER = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(0x80, 0xC0))
_UPPER, _LETTERS = bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_END = re.compile(rb"[.!?:;\"')\]]\s*$")
#: Lines of a piece that the field is trained on; longer texts teach in several pieces.
PIECE = 64
#: Numbers of values of each feature of a line, and where each begins.
_SIZES = (6, 4, 4, 3, 2, 2, 4, 2, 3)
_FIRST = np.concatenate([[0], np.cumsum(_SIZES)])
FEATURES = int(_FIRST[-1])


def _step(x: float, *bounds: float) -> int:
    return sum(x >= b for b in bounds)


def line_features(line: bytes, words: list[bytes], seen: bool) -> list[int]:
    """Of each feature, the number of its value: words, symbols, capitals, repeated words, seen before, end, marks, bullet, digits."""
    n, size = len(words), len(line)
    letters = size - len(line.translate(None, _LETTERS))
    values = (
        _step(n, 2, 4, 8, 16, 32),
        _step((size - len(line.translate(None, _SYMBOLS))) / n, 0.05, 0.25, 0.75),
        _step((size - len(line.translate(None, _UPPER))) / max(letters, 1), 0.2, 0.4, 0.8),
        _step(len(set(words)) / n, 0.5, 0.75),
        int(seen),
        int(_END.search(line) is not None),
        _step((line.count(b"!") + line.count(b"?")) / n, 0.1, 0.4, 0.8),
        int(words[0] in (b"-", b"*", b"|", b"#") or words[0][:4] == b"http"),
        _step((size - len(line.translate(None, _DIGITS))) / size, 0.1, 0.3),
    )
    return [int(a) + v for a, v in zip(_FIRST, values, strict=False)]


def describe(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text, as the base rules count them."""
    words = text.split()
    chars = len(text.translate(None, _SPACE + _INNER))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(_SPACE):
            seen.add(line)
    repeated = 0
    if len(words) >= 3:
        three = mix(windows(word_hashes(words), 3))
        _, at, counts = np.unique(three, return_inverse=True, return_counts=True)
        twice = counts[at] > 1
        covered = np.zeros(len(words), bool)
        for i in range(3):
            covered[i : i + len(twice)] |= twice
        repeated = int(covered.sum())
    return len(words), chars, symbols, dup, repeated


def lines_of(text: bytes) -> tuple[list[list[int]], list[int]]:
    """(features, words) of each line that has a word."""
    seen: set[bytes] = set()
    features, counts = [], []
    for line in text.split(b"\n"):
        if words := line.split():
            features.append(line_features(line, words, line in seen))
            counts.append(len(words))
            seen.add(line)
    return features, counts


def _pieces(doc_pieces: int):
    """Texts as pieces of PIECE lines, at most doc_pieces of a text and evenly spread over it: features in a byte each, and how
    many lines the pieces of the text have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, label, text in zip(batch["doc_id"].to_pylist(), batch["label"].to_pylist(), utf8(batch["text"]), strict=True):
                features = np.array(lines_of(text or b"")[0], np.uint8).reshape(-1, len(_SIZES))
                starts = np.arange(0, len(features), PIECE)
                parts = [features[i : i + PIECE] for i in starts[np.unique(np.linspace(0, len(starts) - 1, doc_pieces).astype(int))]] if len(starts) else []
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * n, pa.int64()), pa.array([label] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([sum(map(len, parts))] * n, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                    ["doc_id", "label", "piece", "lines", "features"],
                )

    return run


class Crf:
    """Labels 0 boilerplate and 1 content: emission weights of features, transition weights."""

    def __init__(self, emit: np.ndarray, move: np.ndarray) -> None:
        self.emit, self.move = emit, move

    def decode(self, features: list[list[int]]) -> list[int]:
        """The best labels of a sequence; ties go to content."""
        scores = self.emit[np.array(features)].sum(1).tolist()
        (a00, a01), (a10, a11) = self.move.tolist()
        v0, v1 = scores[0]
        back = []
        for s0, s1 in scores[1:]:
            b0, b1 = v1 + a10 >= v0 + a00, v1 + a11 >= v0 + a01
            back.append((b0, b1))
            v0, v1 = s0 + (v1 + a10 if b0 else v0 + a00), s1 + (v1 + a11 if b1 else v0 + a01)
        label = int(v1 >= v0)
        out = [label]
        for b in reversed(back):
            label = int(b[label])
            out.append(label)
        return out[::-1]


def fit(sequences: list[tuple[np.ndarray, list[int], float]], steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Crf:
    """Maximum likelihood of (features, labels, weight of a line) by Adam on the exact gradient; sequences advance together,
    longest first, so time and memory grow with the longest one and with the number of lines."""
    sequences = sorted((s for s in sequences if len(s[0])), key=lambda s: -len(s[0]))
    theta = np.zeros(FEATURES * 2 + 4)
    if sequences:
        lengths = np.array([len(f) for f, _, _ in sequences])
        active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
        at = [np.array([sequences[i][0][t] for i in range(n)]) for t, n in enumerate(active)]
        gold = [np.array([sequences[i][1][t] for i in range(n)]) for t, n in enumerate(active)]
        each = np.array([w for _, _, w in sequences])
        weight, total = [each[:n] for n in active], float((each * lengths).sum())
        m = v = np.zeros_like(theta)
        for step in range(1, steps + 1):
            g = _gradient(theta, at, gold, weight, active) / total + decay * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(theta[: FEATURES * 2].reshape(-1, 2), theta[FEATURES * 2 :].reshape(2, 2))


def _gradient(theta, at, gold, weight, active) -> np.ndarray:
    emit, move = theta[: FEATURES * 2].reshape(-1, 2), theta[FEATURES * 2 :].reshape(2, 2)
    scores = [emit[f].sum(1) for f in at]
    alpha = [scores[0]]
    for t in range(1, len(at)):
        alpha.append(scores[t] + np.logaddexp.reduce(alpha[-1][: active[t], :, None] + move, axis=1))
    beta = [np.zeros((n, 2)) for n in active]
    for t in range(len(at) - 2, -1, -1):
        beta[t][: active[t + 1]] = np.logaddexp.reduce(move + (scores[t + 1] + beta[t + 1])[:, None, :], axis=2)
    norm = np.logaddexp.reduce(alpha[0] + beta[0], axis=1)
    g_emit, g_move = np.zeros_like(emit), np.zeros_like(move)
    for t, n in enumerate(active):
        p = np.exp(alpha[t] + beta[t] - norm[:n, None])
        p[np.arange(n), gold[t]] -= 1
        np.add.at(g_emit, at[t].T, (p * weight[t][:, None])[None])
        if t:
            pair = np.exp(alpha[t - 1][:n, :, None] + move + (scores[t] + beta[t])[:, None, :] - norm[:n, None, None])
            pair[np.arange(n), gold[t - 1][:n], gold[t]] -= 1
            g_move += (pair * weight[t][:, None, None]).sum(0)
    return np.concatenate([g_emit.ravel(), g_move.ravel()])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 2_000, doc_pieces: int = 4) -> Crf:
    """A field from at most sample_docs labelled documents (1: content, 0: boilerplate), chosen by a hash of the id, and of each
    from at most doc_pieces pieces of PIECE lines, evenly spread: what is gathered is at most 5 MB, however long texts are.

    A document's label stands for its lines, but for lines that it repeats, which are boilerplate. Of each label the same
    number of documents at most is taken, half of the sample. Null ids, labels and texts teach nothing; repeated rows teach
    again; empty tables give a field without preference, which calls every line content.
    """
    prepare(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    half = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs // 2) for k in (0, 1)]
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(half[0].union(half[1])), "doc_id")
    pieces = chosen.where("text is not null").mapInArrow(_pieces(doc_pieces), "doc_id long, label int, piece int, lines long, features binary")
    rows = pieces.orderBy(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "features").limit(sample_docs * doc_pieces).collect()
    seen_at = int(_FIRST[4]) + 1
    sequences = []
    for r in sorted(rows):
        features = np.frombuffer(r.features, np.uint8).reshape(-1, len(_SIZES)).astype(np.int64)
        sequences.append((features, np.where((features == seen_at).any(1), 0, r.label).tolist(), 1 / r.lines))  # each document counts once
    return fit(sequences)


def _judge(crf, text_col: str, keep: tuple[str, ...], least_words: int, repeat_percent: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t or b"", crf.value, least_words, repeat_percent, share) for t in utf8(batch[text_col])]
            made = zip(*rows, strict=True) if rows else [[]] * len(COLUMNS)
            kinds = (pa.int64(),) * 5 + (pa.bool_(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], [*keep, *COLUMNS])

    return run


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def judge(text: bytes, crf: Crf, least_words: int, repeat_percent: int, share: float) -> tuple:
    counts = describe(text)
    failed = counts[0] < least_words or 100 * counts[4] > repeat_percent * counts[0]
    content = 0.0
    if counts[0]:
        features, words = lines_of(text)
        content = float(np.dot(crf.decode(features), words)) / counts[0]
    return *counts, failed, not failed and content >= share, content


def quality(docs: DataFrame, crf: Crf, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), least_words: int = 50, repeat_percent: int = 50, share: float = 0.5) -> DataFrame:
    """(*keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share) of each row of docs.

    base_failed: fewer than least_words words, or more than repeat_percent of them in repeated 3-word windows. kept: the
    base rules hold and at least `share` of the words are in content lines. Null and empty texts have no words and fail.
    Equal scores of labels go to content. Repeated rows come out as often as they came in; an empty table gives an empty result.
    keep must not name the new columns; others of docs are not read.
    """
    prepare(docs.sparkSession)
    refuse(keep, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"])
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    rows = docs.select(*dict.fromkeys((*keep, text_col)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInArrow(_judge(shared, text_col, keep, least_words, repeat_percent, share), f"{schema}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")
