import base64
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from murmura.llm import bpe, packing
from murmura.llm.packing import pack_documents, plan
from murmura.llm.token_counts import Automaton, token_counts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

ODD = [
    "", " ", "  ", "\n", "a  b", "a   b", " a", "a ", "a\n b", "a \n b", "\t\tx", "don't we'll I'VE 's", "日本語 テスト", "é́ 한국어", "\x1c\x1f a", "a\x85b\xa0c", "​　x",
    "123 456abc", "!!!  ???", "a" * 5000, "ab" * 3000, " " * 3000, "\n" * 1000 + "x", "1" * 3000, "x" + " " * 100 + "y", "🙂👍🏽" * 50, "don't" * 500, "'" * 700 + "s",
]


def texts(seed=1):
    r = random.Random(seed)
    letters = "abcdethinr  \n'sll.,!12é日🙂\t"
    return ODD + ["".join(r.choice(letters) for _ in range(r.randint(1, n))) for n in (5, 20, 100, 1000) for _ in range(60)] + ["".join(r.choice("theanors") for _ in range(2000)) for _ in range(5)]


def brute_greedy(word, initial, continuing):
    n, at, pieces = 0, 0, initial
    while at < len(word):
        size = max((k for k in range(1, len(word) - at + 1) if word[at : at + k] in pieces), default=0)
        if not size:
            return 0
        n, at, pieces = n + 1, at + size, continuing
    return n


def test_counts_equal_brute_force():
    r = random.Random(2)
    for _ in range(60):
        make = lambda n: {bytes(r.choice(b"abc") for _ in range(r.randint(1, 5))) for _ in range(n)}  # noqa: B023, E731
        initial, continuing = make(r.randint(0, 12)), make(r.randint(0, 12))
        automaton = Automaton(initial, continuing)
        for _ in range(60):
            word = bytes(r.choice(b"abc") for _ in range(r.randint(1, 12)))
            assert automaton.count(word) == brute_greedy(word, initial, continuing)


def test_counts_of_awkward_rows(awkward, no_rows):
    with open(RANKS, "rb") as f:
        pieces = {base64.b64decode(x.split()[0]) for x in f}
    first, rest = {p for p in pieces if p[:1] == b" "}, {p for p in pieces if p[:1] != b" "}
    rows = {(r.doc_id, r.n_words, r.n_tokens) for r in token_counts(awkward, RANKS).collect()}
    want = set()
    for r in awkward.collect():
        words = (r.text or "").encode().split()
        want.add((r.doc_id, len(words), sum(brute_greedy(b" " + w, first, rest) for w in words)))
    assert rows == want
    assert token_counts(no_rows, RANKS).collect() == []


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(BYTE_BPE)


def test_ids_and_texts_equal_the_library(reference):
    for text in [*texts(), "x<|endoftext|> y", "<|endoftext|>" * 3, "a <|endoftext|>"]:
        ids = reference.encode(text, add_special_tokens=False).ids
        packed = bpe.encode_text(BYTE_BPE, text)
        assert np.frombuffer(packed, "<u4").tolist() == ids, text[:40]
        assert bpe.decode_ids(BYTE_BPE, packed, block=7) == reference.decode(ids, skip_special_tokens=False)


def test_streams_in_pieces_of_any_size_with_the_least_window(reference):
    merges, r = bpe.merges_of(BYTE_BPE), random.Random(5)
    for text in texts(7):
        stream = bpe.Encoder(merges, window=merges.lookahead + 1, block=r.choice([3, 7, 20, 100]))
        step = r.choice([1, 5, 50])
        got = b"".join([*[stream.feed(text[i : i + step]) for i in range(0, len(text), step)], stream.finish()])
        assert np.frombuffer(got, "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, text[:40]


def test_memory_stays_constant():
    merges = bpe.merges_of(BYTE_BPE)
    word, most = bpe.Word(merges), 0
    for _ in range(400):
        word.feed(b"thequickbrownfox" * 16)
        most = max(most, len(word.kept))
    assert most <= 2 * word.window
    stream, most = bpe.Encoder(merges, block=1000), 0
    for _ in range(200):
        stream.feed("abcdefg" * 30)
        most = max(most, len(stream.text) + len(stream.open.kept if stream.open else b""))
    assert most <= 2 * (stream.block + 4 * merges.lookahead)


def test_random_ids_decode_like_the_library(reference):
    r = random.Random(4)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(r.randint(1, 30))]
        assert bpe.decode_ids(BYTE_BPE, np.array(ids, "<u4").tobytes(), block=r.choice([1, 2, 5])) == reference.decode(ids, skip_special_tokens=False)


def test_bpe_of_awkward_rows(awkward, no_rows, reference):
    rows = bpe.decode(bpe.encode(awkward, BYTE_BPE, keep=("doc_id", "text")), BYTE_BPE, keep=("doc_id", "text", "ids")).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    assert bpe.encode(no_rows, BYTE_BPE).collect() == []


def least_bins(lengths, capacity):
    """By trying all: each piece in turn into every bin that it fits or a new one."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                go(i + 1, rooms[:k] + [rooms[k] - lengths[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best


def placed(bins):
    total = Counter()
    for pattern, n in bins:
        for length, k in pattern:
            total[length] += k * n
    return total


def test_plans_place_everything_and_reductions_are_optimal():
    r = random.Random(8)
    for _ in range(200):
        capacity = r.choice([10, 20, 50])
        lengths = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 9))), reverse=True)
        counts = Counter(lengths)
        bins = plan(dict(counts), capacity)
        assert placed(bins) == counts
        assert all(sum(a * k for a, k in p) <= capacity for p, _ in bins)
        left = Counter(counts)
        fixed = packing.reduce_dominated(left, capacity)
        rest = sorted(left.elements(), reverse=True)
        assert sum(n for _, n in fixed) + (least_bins(rest, capacity) if rest else 0) == least_bins(lengths, capacity)


def test_best_fit_batches_like_one_at_a_time():
    r = random.Random(9)
    for _ in range(100):
        capacity = 40
        counts = Counter(r.randint(1, 30) for _ in range(80))
        rooms = []
        for length in sorted(counts.elements(), reverse=True):
            fit = [x for x in rooms if x >= length]
            room = min(fit) if fit else capacity
            if fit:
                rooms.remove(room)
            rooms.append(room - length)
        assert sum(n for _, n in packing.best_fit(counts, capacity)) == len(rooms)


def test_packed_pieces(awkward, no_rows):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    rows = pack_documents(awkward, WORD_BPE, capacity=64).collect()
    want = Counter()
    for r in awkward.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for i in range(0, len(ids), 64):
            want[(r.doc_id, i // 64, i, len(ids[i : i + 64]), zlib.crc32(ids[i : i + 64].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert pack_documents(no_rows, WORD_BPE).collect() == []


def test_chunks_equal_the_library():
    tokenizer, chunks = Tokenizer.from_file(WORD_BPE), packing.Chunks(WORD_BPE)
    for text in [*texts(3), "ÀÉß×÷ÿ µª² İI ﬁ é <|startoftext|>x A's B'LL"]:
        assert np.frombuffer(chunks.of(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:40]
